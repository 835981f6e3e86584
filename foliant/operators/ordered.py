"""Operators over ordered rows: islands, as-of joins, ranges, interning, closures.

All keys carry the document's, so a shuffle deals by document and every later
window or group on it finds its rows in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.session import written


def islands(df: DataFrame, by: list[str], order: list[str], same: list[str], name: str = "island") -> DataFrame:
    """Numbers runs of neighbouring rows (from 1, per group) that agree null-safely in the columns `same`."""
    w = W.partitionBy(*by).orderBy(*order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_new", (first | change).cast("int"))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merge_runs(runs: DataFrame, by: list[str], order: str, same: list[str], text: str = "text") -> DataFrame:
    """One row per run of neighbours of the same format: its text joined, its first place and its number of parts."""
    marked = islands(runs, by, [order], same)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return marked.groupBy(*by, *same, "island").agg(F.min(order).alias(order), F.array_join(F.transform(parts, lambda p: p[text]), "").alias(text), F.count("*").alias("parts"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: list[str], first_if_none: bool = False) -> DataFrame:
    """left with, per row, the columns `value` of the last row of right at or before it (column `at` of both).

    One union, one shuffle and one sort: no pairs of rows are made. With
    first_if_none, rows before every row of right take its first one.
    """
    names = [c for c in left.columns if c not in by and c != at]
    mine = left.select(*by, at, F.lit(1).alias("_side"), F.struct(*names).alias("_left") if names else F.lit(None).alias("_left"), F.lit(None).cast(right.select(F.struct(*value).alias("v")).schema["v"].dataType).alias("_value"))
    theirs = right.select(*by, at, F.lit(0).alias("_side"), F.lit(None).cast(mine.schema["_left"].dataType).alias("_left"), F.struct(*value).alias("_value"))
    w = W.partitionBy(*by).orderBy(at, "_side")
    found = F.last("_value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    if first_if_none:
        found = F.coalesce(found, F.first("_value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    out = theirs.unionByName(mine).withColumn("_found", found).filter("_side = 1")
    return out.select(*by, at, *[F.col(f"_left.{c}").alias(c) for c in names], *[F.col(f"_found.{c}").alias(c) for c in value])


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """points with the range [start, end) that holds them; the ranges of a group do not overlap.

    Ranges that do not overlap make this an as-of join on their starts, checked against their ends.
    """
    keep = [c for c in ranges.columns if c not in by]
    renamed = ranges.select(*by, F.col(start).alias(at), *[F.col(c).alias(f"_r_{c}") for c in keep])
    found = asof_join(points, renamed, by, at, [f"_r_{c}" for c in keep])
    found = found.filter(F.col(at) < F.col(f"_r_{end}"))
    return found.select(*[c for c in found.columns if not c.startswith("_r_")], *[F.col(f"_r_{c}").alias(c) for c in keep])


def intern(df: DataFrame, by: list[str], order: Column, values: list[str], name: str = "shape") -> tuple[DataFrame, DataFrame]:
    """Ids (from 0, per group, by first use) for the distinct tuples of `values`: (dimension, df with ids).

    The distinct tuples are aggregated before anything is numbered, so the window sees one row per tuple.
    """
    seen = df.groupBy(*by, *values).agg(F.min(order).alias("_first"))
    if by:
        dimension = seen.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy("_first")) - 1).drop("_first")
    else:
        dimension = ranked(seen, "_first", name).drop("_first")
    right = dimension.select(*[F.col(c).alias(f"_d_{c}") for c in (*by, *values)], name)
    on = F.lit(True)
    for c in (*by, *values):
        on = on & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    return dimension, df.join(right, on).drop(*[f"_d_{c}" for c in (*by, *values)])


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the place (from 0) of each row in the order of a column, over the whole table: ranges are sorted by tasks, and
    only their sizes are added up in one place."""
    parts = written(df.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")), "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))  # a row per task
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, (F.col("_before") + F.col("_nth")).cast("int")).drop("_part", "_nth", "_before")


def closure(seeds: DataFrame, edges: DataFrame, plain_rounds: int = 6) -> DataFrame:
    """Every (root, node) that edges (src, dst) reach from seeds (root, node), the seeds included, however long the chains.

    Semi-naive rounds: only pairs new in a round are extended, and each round is
    a written table of its own. Chains longer than plain_rounds are followed by
    doubling: every later round also joins the edges with themselves, so that a
    chain of n edges takes log2(n) rounds.
    """
    edges = edges.select("src", "dst").distinct()
    rounds = [written(seeds.select("root", "node").distinct(), "closure")]
    known = lambda: reduce(DataFrame.unionByName, rounds)
    far = lambda pairs, jump: pairs.join(jump, pairs["node"] == jump["src"]).select("root", F.col("dst").alias("node")).distinct()
    for _ in range(plain_rounds):
        new = written(far(rounds[-1], edges).join(known(), ["root", "node"], "left_anti"), "closure")
        if new.isEmpty():
            return known()
        rounds.append(new)
    front, jump = rounds[-1], written(edges, "jumps")
    while True:
        new = written(far(front, jump).join(known(), ["root", "node"], "left_anti"), "closure")
        if new.isEmpty():
            return known()
        rounds.append(new)
        front = front.unionByName(new)
        longer = jump.select(F.col("src").alias("s"), F.col("dst").alias("mid"))
        longer = longer.join(jump, longer["mid"] == jump["src"]).select(F.col("s").alias("src"), "dst")
        jump = written(jump.unionByName(longer).distinct(), "jumps")


def inherit(styles: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Styles with what they do not say taken from their nearest ancestor that does (columns style, parent).

    The style table is small beside the text that uses it, so it is resolved once per style. Each round doubles the
    distance that is known and is a written table of its own, until no style has an ancestor left to ask. A chain cannot
    be longer than its group has styles: what goes on after that is a cycle, in which every style has asked all others.
    """
    known, reach = written(styles.select(*by, "style", "parent", *values), "inherit"), 1
    most = known.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    while reach < most and not known.filter("parent is not null").isEmpty():
        up = known.select(*by, F.col("style").alias("parent"), F.col("parent").alias("_next"), *[F.col(v).alias(f"_{v}") for v in values])
        known = written(known.join(up, [*by, "parent"], "left").select(*by, "style", F.col("_next").alias("parent"), *[F.coalesce(v, f"_{v}").alias(v) for v in values]), "inherit")
        reach *= 2
    return known.drop("parent")


def orphans(refs: DataFrame, bodies: DataFrame, on: list[str]) -> DataFrame:
    """References without a body."""
    return refs.join(bodies.select(*on).distinct(), on, "left_anti")


def first_of(rows: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """(by, n, first): how many rows a group has, and its smallest `most` values, as reports show them."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(value))
    few = rows.withColumn("_nth", nth).groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_nth") <= most, F.col(value)))).alias("first"))
    return few
