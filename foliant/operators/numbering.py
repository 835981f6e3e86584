"""Derived numbers: ids, outline, lists, footnotes. Nothing of this is stored; windows count it when asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.session import written


def outline_numbers(headings: DataFrame, by: list[str], order: str, level: str = "level") -> DataFrame:
    """Adds n and label: the count of a heading among those of its level since the last shallower one, at any level.

    With `by` empty, all rows are one document: it is cut into ranges that tasks number, see _one_outline.
    """
    if by:
        nested = list_nesting(headings, by, order, level, "_above")
        w = W.partitionBy(*by, level, "_above").orderBy(order)
        out = nested.withColumn("n", F.row_number().over(w).cast("long")).drop("_above")
    else:
        out = _one_outline(headings, order, level)
    return out.withColumn("label", text.outline_label(F.col(level), F.col("n")))


def _one_outline(headings: DataFrame, order: str, level: str) -> DataFrame:
    """headings with n, where no window holds the whole document: ranges of it are nested and counted by themselves, and what
    a range needs of those before it is, by level, their last heading (a row per range and level) and, by heading, how many
    they have counted under it."""
    ranges = written(headings.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    nested = list_nesting(ranges, ["_part"], order, level, "_here")
    lasts = written(ranges.groupBy("_part", F.col(level).alias("_level")).agg(F.max(order).alias("_last")), "lasts")
    asks = lasts.select(F.col("_part").alias("_p"), F.col("_level").alias("_l"))
    before = asks.join(lasts, (F.col("_part") < F.col("_p")) & (F.col("_level") < F.col("_l"))).groupBy(F.col("_p").alias("_part"), F.col("_l").alias(level)).agg(F.max("_last").alias("_carried"))
    placed = nested.join(before, ["_part", level], "left").withColumn("_above", F.coalesce("_here", "_carried")).drop("_here", "_carried")
    placed = written(placed, "nested")
    group = [level, "_above", "_part"]
    counts = placed.groupBy(*group).agg(F.count("*").alias("_count"))
    earlier = F.coalesce(F.sum("_count").over(W.partitionBy(level, "_above").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(group)], earlier.alias("_earlier"))
    on = (F.col("_c0") == F.col(level)) & F.col("_c1").eqNullSafe(F.col("_above")) & (F.col("_c2") == F.col("_part"))
    nth = F.row_number().over(W.partitionBy("_part", level, "_above").orderBy(order))
    return placed.withColumn("_nth", nth).join(counts, on).withColumn("n", (F.col("_nth") + F.col("_earlier")).cast("long")).select(*headings.columns, "n")


def list_numbers(items: DataFrame, instance: list[str], order: str, parent: str | None = None) -> DataFrame:
    """Adds n: 1, 2, ... in every list instance, and under every parent item of nested ones."""
    w = W.partitionBy(*instance, *([parent] if parent else [])).orderBy(order)
    return items.withColumn("n", F.row_number().over(w).cast("long"))


def list_nesting(items: DataFrame, by: list[str], order: str, level: str = "level", name: str = "parent") -> DataFrame:
    """Adds parent: the place of the last item of a smaller level (null for none), however deep the levels go.

    Every item asks each smaller level of its group for the last item before it, and the latest answer is the parent:
    windows by level, without a walk over the list. `order` tells the items of a group apart.
    """
    ranks = items.select(*by, order, F.dense_rank().over(W.partitionBy(*by).orderBy(level)).alias("_rank"))
    own = ranks.select(*by, order, F.col("_rank").alias("_level"), F.lit(1).alias("_own"))
    asks = ranks.filter("_rank > 1").select(*by, order, F.explode(F.sequence(F.lit(1), F.col("_rank") - 1)).alias("_level"), F.lit(0).alias("_own"))
    w = W.partitionBy(*by, "_level").orderBy(order, "_own").rowsBetween(W.unboundedPreceding, -1)
    answers = own.unionByName(asks).withColumn(name, F.last(F.when(F.col("_own") == 1, F.col(order)), ignorenulls=True).over(w))
    parents = answers.filter("_own = 0").groupBy(*by, order).agg(F.max(name).alias(name))
    return items.join(parents, [*by, order], "left").select(*items.columns, name)


def footnote_numbers(refs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds n: references in order, from 1 in every group (a section for the viewer, a document for odt)."""
    return refs.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))


def assign_ids(blocks: DataFrame, by: list[str], order: list[str], name: str = "data_id", prefix: str = "b") -> DataFrame:
    """Blocks without an id get the numbers after the group's largest, in document order; others keep theirs."""
    number = F.regexp_extract(F.coalesce(F.col(name), F.lit("")), rf"^{prefix}(\d+)$", 1).try_cast("long")
    most = F.coalesce(F.max(number).over(W.partitionBy(*by)), F.lit(0))
    missing = F.sum(F.col(name).isNull().cast("long")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return blocks.withColumn(name, F.coalesce(F.col(name), F.concat(F.lit(prefix), most + missing)))


def duplicate_ids(blocks: DataFrame, by: list[str], order: list[str], name: str = "data_id") -> DataFrame:
    """The second and later blocks of an id."""
    w = W.partitionBy(*by, name).orderBy(*order)
    return blocks.filter(F.col(name).isNotNull()).withColumn("nth", F.row_number().over(w).cast("long")).filter("nth > 1")


def next_match(matches: DataFrame, by: list[str], order: list[str], back: bool = False) -> DataFrame:
    """Adds k, total and target: the place, from 0, of the next (or previous) match, going round at the ends."""
    k = (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("long")
    out = matches.withColumn("k", k).withColumn("total", F.count("*").over(W.partitionBy(*by)))
    return out.withColumn("target", F.pmod(F.col("k") + (-1 if back else 1), F.col("total")))
