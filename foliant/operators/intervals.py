"""Trees as intervals: a node's descendants are the nodes after it up to its last one, so "inside of" is a range of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def open_count(nodes: DataFrame, which: Column, by: list[str], name: str, node: str = "node_id", last: str = "last_id") -> DataFrame:
    """Adds, to every node, how many of the nodes `which` it stands inside of (a node not inside of itself).

    Beginnings and ends are steps up and down at their places; one running sum counts those that are open.
    """
    opens = F.coalesce(which, F.lit(False))
    inner = nodes.select("*", F.col(node).cast("double").alias("_at"), opens.cast("int").alias("_step"), F.lit(True).alias("_own"))
    ends = nodes.filter(opens).select(*by, (F.col(last) + 0.5).alias("_at"), F.lit(-1).alias("_step"), F.lit(False).alias("_own"))
    w = W.partitionBy(*by).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    counted = inner.unionByName(ends, allowMissingColumns=True).withColumn("_sum", F.sum("_step").over(w))
    return counted.filter("_own").withColumn(name, (F.col("_sum") - F.col("_step")).cast("int")).drop("_at", "_step", "_own", "_sum")
