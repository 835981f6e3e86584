"""Character streams of binary documents: positions, pieces, fields and paragraphs by windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.ordered import asof_join, range_join

# fixed values: control characters of the word format
FIELD_BEGIN, FIELD_SEPARATOR, FIELD_END = 0x13, 0x14, 0x15
PARAGRAPH_END, CELL_END = 0x0D, 0x07


def stretches(docs: DataFrame, text: str) -> DataFrame:
    """(docs' columns but text, cp, code, shown): the text's control characters and, as one row each with code 0, what stands
    between two of them, in order. Windows over these see a few rows a paragraph and not a row a character."""
    marks = "".join(f"\\x{c:02x}" for c in (FIELD_BEGIN, FIELD_SEPARATOR, FIELD_END, PARAGRAPH_END, CELL_END))
    parts = F.regexp_extract_all(text, F.lit(f"([{marks}]|[^{marks}]+)"), F.lit(1))
    rest = [c for c in docs.columns if c != text]
    each = docs.select(*rest, F.posexplode(parts).alias("cp", "shown"))
    mark = F.col("shown").rlike(f"^[{marks}]$")
    return each.select(*rest, "cp", F.when(mark, F.ascii("shown")).otherwise(0).alias("code"), "shown")


def _upto(by: list[str], at: str, before: bool = False):
    return W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1 if before else 0)


def hide_field_codes(chars: DataFrame, by: list[str], at: str = "cp", code: str = "code") -> DataFrame:
    """Characters (by, cp, code) without field marks and what stands between a field's begin and its separator.

    A field without a separator hides all up to its end; an inner field's result
    inside an outer code stays hidden, however deep. A field's code runs from its
    begin to the first separator of its depth or to its end: as ranges these
    open and close, and a character is shown where no range is open.
    """
    marks = (FIELD_BEGIN, FIELD_SEPARATOR, FIELD_END)
    step = F.when(F.col(code) == FIELD_BEGIN, 1).when(F.col(code) == FIELD_END, -1).otherwise(0)
    depth = F.sum(step).over(_upto(by, at)) + F.when(F.col(code) == FIELD_END, 1).otherwise(0)
    marked = chars.withColumn("_mark", F.col(code).isin(*marks)).withColumn("_depth", depth)
    # of the marks of one depth: a begin opens a code, the next mark of that depth closes it
    level = W.partitionBy(*by, "_mark", "_depth").orderBy(at)
    opens = F.when(F.col("_mark") & (F.col(code) == FIELD_BEGIN), 1)
    closes = F.when(F.col("_mark") & (F.col(code) != FIELD_BEGIN) & (F.lag(code).over(level) == FIELD_BEGIN), -1)
    stepped = marked.withColumn("_step", F.coalesce(opens, closes, F.lit(0))).withColumn("_open", F.sum("_step").over(_upto(by, at)))
    return stepped.filter((F.col("_open") == 0) & ~F.col("_mark")).drop("_mark", "_depth", "_step", "_open")


def paragraphs(chars: DataFrame, by: list[str], at: str = "cp", code: str = "code") -> DataFrame:
    """(by, par, start, in_cell, text): a paragraph ends with its mark, which it does not show; a cell's end ends one too.

    Rows are characters, or stretches of them with what they show (column shown).
    """
    ends = F.col(code).isin(PARAGRAPH_END, CELL_END)
    numbered = chars.withColumn("par", F.coalesce(F.sum(ends.cast("int")).over(_upto(by, at, before=True)), F.lit(0)))
    shown = F.when(~ends, F.col("shown") if "shown" in chars.columns else F.char(F.col(code)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(at).alias("k"), F.coalesce(shown, F.lit("")).alias("c"))))
    return numbered.groupBy(*by, "par").agg(F.min(at).alias("start"), F.bool_or(F.col(code) == CELL_END).alias("in_cell"), F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("text"))


def characters(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by, cp, fc) of the pieces' positions: a piece (cp_start, cp_end, fc, compressed) holds one or two bytes a character."""
    each = pieces.withColumn("cp", F.explode(F.sequence(F.col("cp_start"), F.col("cp_end") - 1)))
    width = F.when(F.col("compressed"), 1).otherwise(2)
    return each.select(*by, "cp", (F.col("fc") + (F.col("cp") - F.col("cp_start")) * width).alias("fc"), "compressed")


def locate(points: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    """points (by, cp) with their byte positions, without listing the pieces' characters."""
    found = range_join(points, pieces, by, "cp", "cp_start", "cp_end")
    width = F.when(F.col("compressed"), 1).otherwise(2)
    return found.withColumn("fc", F.col("fc") + (F.col("cp") - F.col("cp_start")) * width).select(*points.columns, "fc", "compressed")


def char_formats(chars: DataFrame, runs: DataFrame, by: list[str], values: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Characters with the format of the last run that starts at or before their byte; defaults before the first."""
    found = asof_join(chars, runs, by, "fc", values)
    return found.select(*chars.columns, *[F.coalesce(v, defaults[v]).alias(v) for v in values])


def first_starts(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Format runs sorted and made one per start: the first of each start in page order counts (column page)."""
    return runs.groupBy(*by, "fc").agg(*[F.min_by(v, "page").alias(v) for v in values])


def floating_pictures(anchors: DataFrame, shapes: DataFrame, store: DataFrame, by: list[str]) -> DataFrame:
    """Anchors (cp, spid) to shapes (spid, pib) to the store's pictures (k from 1): three equi-joins."""
    pictures = store.select(*by, F.col("k").alias("pib"), "data", "ext")
    return anchors.join(shapes, [*by, "spid"]).join(pictures, [*by, "pib"])


def inline_pictures(places: DataFrame, store: DataFrame, by: list[str]) -> DataFrame:
    """Places (cp, own, pib): the picture's own bytes, else the store's by number, else the only one of the store."""
    only = store.groupBy(*by).agg(F.count("*").alias("_n"), F.min("data").alias("_only"))
    by_number = store.select(*by, F.col("k").alias("pib"), F.col("data").alias("_stored"))
    out = places.join(by_number, [*by, "pib"], "left").join(only, by, "left")
    return out.withColumn("data", F.coalesce("own", "_stored", F.when(F.col("_n") == 1, F.col("_only")))).drop("_stored", "_n", "_only", "own")
