"""Editing as patches: rows (doc_id, data_id, op, arg) joined to blocks on the id that addresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INDENT_PT = 20.0


def apply_patches(blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """Blocks (doc_id, data_id, tag, text, indent, numbered) after the last patch of each kind on each block.

    indent / outdent move by 20 pt per patch and stop at 0; text, tag and numbered set; delete removes.
    """
    p = patches.groupBy("doc_id", "data_id").agg(
        F.sum(F.when(F.col("op") == "indent", 1).when(F.col("op") == "outdent", -1).otherwise(0)).alias("_steps"),
        *[F.max_by(F.when(F.col("op") == op, F.col("arg")), F.when(F.col("op") == op, F.col("seq"))).alias(f"_{op}") for op in ("text", "tag", "numbered")],
        F.bool_or(F.col("op") == "delete").alias("_gone"),
    )
    out = blocks.join(p, ["doc_id", "data_id"], "left").filter(~F.coalesce("_gone", F.lit(False)))
    heading = F.coalesce("_tag", "tag").rlike("^h[1-6]$")
    return out.select(
        "doc_id",
        "data_id",
        F.coalesce("_tag", "tag").alias("tag"),
        F.coalesce("_text", "text").alias("text"),
        F.greatest(F.col("indent") + F.coalesce("_steps", F.lit(0)) * INDENT_PT, F.lit(0.0)).alias("indent"),
        (F.coalesce(F.col("_numbered") == "outline", F.col("numbered")) & heading).alias("numbered"),
    )


def move_block(blocks: DataFrame, by: list[str], what: str, before: str, order: str = "ord") -> DataFrame:
    """Blocks renumbered so that the block named by column `what` stands before the one named by `before`."""
    target = F.max(F.when(F.col("data_id") == F.col(before), F.col(order))).over(W.partitionBy(*by))
    place = F.when((F.col("data_id") == F.col(what)) & target.isNotNull(), target - 0.5).otherwise(F.col(order))
    moved = blocks.withColumn("_place", place)
    return moved.withColumn(order, F.row_number().over(W.partitionBy(*by).orderBy("_place")) - 1).drop("_place")


def drop_unreferenced(bodies: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    """Footnote bodies that a reference still names."""
    return bodies.join(refs.select(*on).distinct(), on, "left_semi")
