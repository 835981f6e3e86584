"""Pages: breaks by estimated heights, and paper sizes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: paper sizes in mm, upright, in catalogue order; and how far off a paper may be
PAPERS = (("a4", 210.0, 297.0), ("b5", 182.0, 257.0), ("letter", 215.9, 279.4))
TOLERANCE_MM = 3.0


def pages_of(heights, breaks, page: float) -> list[int]:
    """The page (from 0) of each block: one that ends below the page opens a new one, as does one after a forced break."""
    out, number, used, force = [], 0, 0.0, False
    for k, (h, f) in enumerate(zip(heights, breaks)):
        if k and (force or (used > 0 and used + h > page)):
            number, used = number + 1, 0.0
        used += h
        force = bool(f)
        out.append(number)
    return out


def paginate(blocks: DataFrame, by: list[str], order: str, height: str, page: Column, forced: str | None = None) -> DataFrame:
    """Adds page (from 0): a block that ends below the page opens a new one, as does one after a forced break; a block
    taller than a page does not break before itself when it is first. A sum that restarts is no window, so the heights
    of a section are folded in order, in one step a block; a section is one document's, so its array is bounded by it."""

    @F.pandas_udf("array<int>")
    def fold(heights: pd.Series, breaks: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([pages_of(h, f, p) for h, f, p in zip(heights, breaks, size)])

    w = [F.col(order), F.col(height).cast("double").alias("h"), F.coalesce(F.col(forced) if forced else F.lit(False), F.lit(False)).alias("f")]
    packed = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*w))).alias("bs"), F.first(page).cast("double").alias("page_height"))
    pages = packed.withColumn("pages", fold(F.col("bs.h"), F.col("bs.f"), F.col("page_height")))
    rows = pages.select(*by, F.explode(F.arrays_zip("bs", "pages")).alias("z")).select(*by, F.col(f"z.bs.{order}").alias(order), F.col("z.pages").cast("long").alias("page"))
    return blocks.join(rows, [*by, order])


def unpaginate(paged: DataFrame, by: list[str], order: list[str], is_clone: str = "clone", section: str = "section") -> DataFrame:
    """Without the bands that pages repeat, and with page sections numbered as the section that they were cut from."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    origin = F.last(F.when(~F.col(is_clone), F.col(section)), ignorenulls=True).over(w)
    return paged.withColumn(section, origin).filter(F.col("kind") != "band_clone").drop(is_clone)


def paper(width_mm: Column, height_mm: Column) -> Column:
    """The first paper of the catalogue within the tolerance, upright or not, else null."""
    out = F.lit(None).cast("string")
    for name, w, h in reversed(PAPERS):
        near = lambda a, b: (F.abs(width_mm - a) < TOLERANCE_MM) & (F.abs(height_mm - b) < TOLERANCE_MM)
        out = F.when(near(w, h) | near(h, w), F.lit(name)).otherwise(out)
    return out
