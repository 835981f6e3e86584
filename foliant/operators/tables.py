"""Tables: grids, merges, widths, heights, edits. Cells are rows keyed by (table, row, cell)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

MIN_PT = 12.0


def grid_columns(cells: DataFrame, row: list[str], order: str, span: str = "col_span") -> DataFrame:
    """Adds col: the grid column of a cell, the sum of the spans before it in its row."""
    w = W.partitionBy(*row).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("col", F.coalesce(F.sum(span).over(w), F.lit(0)).cast("long"))


def common_grid(cells: DataFrame, table: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """Adds col and col_span of cells that are given by their edges: edges are ranked in their table."""
    edges = cells.select(*table, F.col(left).alias("edge")).unionByName(cells.select(*table, F.col(right).alias("edge"))).distinct()
    ranked = edges.withColumn("rank", (F.row_number().over(W.partitionBy(*table).orderBy("edge")) - 1).cast("long"))
    a = ranked.select(*table, F.col("edge").alias(left), F.col("rank").alias("col"))
    b = ranked.select(*table, F.col("edge").alias(right), F.col("rank").alias("_end"))
    return cells.join(a, [*table, left]).join(b, [*table, right]).withColumn("col_span", F.col("_end") - F.col("col")).drop("_end")


def fold_vertical_merges(cells: DataFrame, column: list[str], row: str, merge: str = "merge") -> DataFrame:
    """Anchors with row_span; merge is 'restart', 'continue' or null, and continued cells go into their anchor."""
    w = W.partitionBy(*column).orderBy(row).rowsBetween(W.unboundedPreceding, 0)
    opened = cells.withColumn("_anchor", F.sum(F.when(F.col(merge) == "continue", 0).otherwise(1)).over(w))
    counted = opened.withColumn("row_span", F.count("*").over(W.partitionBy(*column, "_anchor")))
    return counted.filter(~F.col(merge).eqNullSafe(F.lit("continue"))).drop("_anchor")


def occupy(cells: DataFrame, table: list[str]) -> DataFrame:
    """Adds col where row-spanning cells push later ones aside: a fold over a table's rows, table by table."""
    schema = StructType([*cells.schema.fields, StructField("col", IntegerType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "ord"], kind="stable")
        taken: set[tuple[int, int]] = set()
        cols = []
        for row, rs, cs in zip(pdf["row"], pdf["row_span"], pdf["col_span"]):
            col = 0
            while (row, col) in taken:
                col += 1
            cols.append(col)
            taken.update((row + i, col + j) for i in range(rs) for j in range(cs))
        return pdf.assign(col=cols)

    return cells.groupBy(*table).applyInPandas(fold, schema)


def covered(cells: DataFrame) -> DataFrame:
    """(…, r, c) of every grid place of a cell, the anchor's own included."""
    rows = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))
    cols = F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1))
    return cells.withColumn("r", rows).withColumn("c", cols)


def column_widths(cells: DataFrame, table: list[str], total: float | str = 400.0, least: float = 60.0) -> DataFrame:
    """(table, col, width): a column's first width over its rows, spans shared evenly, the rest of the total width (a
    constant, or the column that says the table's own) over columns without any, `least` where nothing is left."""
    cols = F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c")
    share = F.when(F.col("width") > 0, F.col("width") / F.col("col_span")).alias("share")
    whole = F.col(total) if isinstance(total, str) else F.lit(total)
    each = cells.select(*table, "row", share, cols, whole.alias("_total"))
    first = each.groupBy(*table, "c").agg(F.min_by("share", F.when(F.col("share").isNotNull(), F.col("row"))).alias("w"), F.max("_total").alias("_total"))
    w = W.partitionBy(*table)
    rest = F.max("_total").over(w) - F.coalesce(F.sum("w").over(w), F.lit(0.0))
    blank = F.count(F.when(F.col("w").isNull(), 1)).over(w)
    filled = F.coalesce("w", F.when(rest > 0, rest / blank), F.lit(least))
    return first.select(*table, F.col("c").alias("col"), filled.alias("width"))


def row_heights(cells: DataFrame, table: list[str], height: str = "height") -> DataFrame:
    """(table, row, height): the tallest cell of a row, those that span rows aside."""
    return cells.groupBy(*table, "row").agg(F.max(F.when(F.col("row_span") == 1, F.col(height))).alias("height"))


def insert_row(cells: DataFrame, table: list[str], after: Column) -> DataFrame:
    """A blank copy of the row `after` below it, spans removed; `after` is null for tables that stay."""
    moved = cells.withColumn("row", F.when(after.isNotNull() & (F.col("row") > after), F.col("row") + 1).otherwise(F.col("row")))
    blank = cells.filter(F.col("row") == after).withColumn("row", F.col("row") + 1).withColumn("row_span", F.lit(1)).withColumn("col_span", F.lit(1)).withColumn("text", F.lit(""))
    return moved.unionByName(blank.select(*moved.columns))


def delete_row(cells: DataFrame, table: list[str], which: Column) -> DataFrame:
    """Without a row; a table's only row stays."""
    rows = F.max("row").over(W.partitionBy(*table)) + 1
    kept = cells.withColumn("_rows", rows).filter(~((F.col("row") == which) & (F.col("_rows") > 1)) | which.isNull())
    return kept.withColumn("row", F.when((F.col("_rows") > 1) & (F.col("row") > which), F.col("row") - 1).otherwise(F.col("row"))).drop("_rows")


def merge_right(cells: DataFrame, table: list[str], row: Column, col: Column) -> DataFrame:
    """Joins the cell at (row, col) with the one that starts right of it, if both span as many rows."""
    w = W.partitionBy(*table, "row").orderBy("col")
    nxt = lambda c: F.lead(c).over(w)
    fits = (F.col("row") == row) & (F.col("col") == col) & (nxt("col") == F.col("col") + F.col("col_span")) & (nxt("row_span") == F.col("row_span"))
    marked = cells.withColumn("_grow", F.coalesce(F.when(fits, nxt("col_span")), F.lit(0))).withColumn("_add", F.when(fits, nxt("text")))
    marked = marked.withColumn("_gone", F.coalesce(F.lag("_grow").over(w), F.lit(0)) > 0).filter("not _gone")
    return marked.withColumn("col_span", F.col("col_span") + F.col("_grow")).withColumn("text", F.concat_ws("\n", F.when(F.col("text") != "", F.col("text")), F.when(F.col("_add") != "", F.col("_add")))).drop("_grow", "_add", "_gone")


def merge_down(cells: DataFrame, table: list[str], row: Column, col: Column) -> DataFrame:
    """Joins the cell at (row, col) with the one that starts below it, if both begin at one column and span as many."""
    w = W.partitionBy(*table, "col").orderBy("row")
    nxt = lambda c: F.lead(c).over(w)
    fits = (F.col("row") == row) & (F.col("col") == col) & (nxt("row") == F.col("row") + F.col("row_span")) & (nxt("col_span") == F.col("col_span"))
    marked = cells.withColumn("_grow", F.coalesce(F.when(fits, nxt("row_span")), F.lit(0))).withColumn("_add", F.when(fits, nxt("text")))
    marked = marked.withColumn("_gone", F.coalesce(F.lag("_grow").over(w), F.lit(0)) > 0).filter("not _gone")
    return marked.withColumn("row_span", F.col("row_span") + F.col("_grow")).withColumn("text", F.concat_ws("\n", F.when(F.col("text") != "", F.col("text")), F.when(F.col("_add") != "", F.col("_add")))).drop("_grow", "_add", "_gone")


def insert_column(cells: DataFrame, table: list[str], after: Column) -> DataFrame:
    """A blank copy of the `after`-th cell of every row beside it, spans removed; a shorter row takes its last cell."""
    w = W.partitionBy(*table, "row").orderBy("col")
    placed = cells.withColumn("_k", F.row_number().over(w) - 1).withColumn("_last", F.max("col").over(W.partitionBy(*table, "row")))
    placed = placed.withColumn("_n", F.count("*").over(W.partitionBy(*table, "row")))
    source = after.isNotNull() & (F.col("_k") == F.least(after, F.col("_n") - 1))
    at = F.max(F.when(source, F.col("col") + F.col("col_span"))).over(W.partitionBy(*table, "row"))
    placed = placed.withColumn("_at", at)
    moved = placed.withColumn("col", F.when(F.col("col") >= F.col("_at"), F.col("col") + 1).otherwise(F.col("col")))
    blank = placed.filter(source).withColumn("col", F.col("_at")).withColumn("row_span", F.lit(1)).withColumn("col_span", F.lit(1)).withColumn("text", F.lit(""))
    return moved.unionByName(blank).drop("_k", "_last", "_n", "_at")


def delete_column(cells: DataFrame, table: list[str], which: Column) -> DataFrame:
    """Without the `which`-th cell of every row (a shorter row: its last); the only cell of a row stays."""
    by = W.partitionBy(*table, "row")
    placed = cells.withColumn("_k", F.row_number().over(by.orderBy("col")) - 1).withColumn("_n", F.count("*").over(by))
    gone = which.isNotNull() & (F.col("_n") > 1) & (F.col("_k") == F.least(which, F.col("_n") - 1))
    placed = placed.withColumn("_gone", gone)
    edge = F.max(F.when(F.col("_gone"), F.col("col"))).over(by)
    width = F.max(F.when(F.col("_gone"), F.col("col_span"))).over(by)
    moved = placed.withColumn("_col", F.when(F.col("col") > edge, F.col("col") - width).otherwise(F.col("col")))
    return moved.filter("not _gone").withColumn("col", F.col("_col").cast("int")).drop("_k", "_n", "_gone", "_col")


def same_border(a: Column, b: Column) -> Column:
    """Whether two borders (structs, null for none) look alike."""
    return a.eqNullSafe(b)


#: What a cell has without saying it: its background, its vertical place and its border.
CELL_DEFAULTS = {"background": "#FFFFFF", "valign": "middle", "border": "0.75pt solid #555555"}


def cell_format(**values: Column) -> list[Column]:
    """The values of a cell's format that it must say: null for those that equal the defaults."""
    return [F.nullif(v, F.lit(CELL_DEFAULTS[name])).alias(name) for name, v in values.items()]


def edit_grid(cells: DataFrame, table: list[str], least: float = 60.0) -> DataFrame:
    """(table, col, width): a column is as wide as its first cell without a span says, `least` where none does."""
    cols = F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c")
    each = cells.select(*table, "row", F.when((F.col("col_span") == 1) & (F.col("width") > 0), F.col("width")).alias("own"), cols)
    out = each.groupBy(*table, "c").agg(F.min_by("own", F.when(F.col("own").isNotNull(), F.col("row"))).alias("own"))
    return out.select(*table, F.col("c").alias("col"), F.coalesce("own", F.lit(least)).alias("width"))


def move_boundary(left: Column, right: Column, by: Column) -> tuple[Column, Column]:
    """Two neighbouring columns after their boundary moved: the sum stays, neither falls under the least width."""
    total = left + right
    new = F.greatest(F.least(left + by, total - MIN_PT), F.lit(MIN_PT))
    return new, total - new


def unmerge(cells: DataFrame, table: list[str]) -> DataFrame:
    """Every place of a spanning cell as a cell of its own; the text stays in the first."""
    each = covered(cells)
    own = (F.col("r") == F.col("row")) & (F.col("c") == F.col("col"))
    return each.withColumn("text", F.when(own, F.col("text")).otherwise("")).withColumn("row", F.col("r")).withColumn("col", F.col("c")).withColumn("row_span", F.lit(1)).withColumn("col_span", F.lit(1)).drop("r", "c")


def new_table(tables: DataFrame, rows: str = "rows", cols: str = "cols") -> DataFrame:
    """Blank cells of r x c tables, 400 pt wide."""
    return tables.withColumn("row", F.explode(F.sequence(F.lit(0), F.col(rows) - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col(cols) - 1))).withColumn("width", F.lit(400.0) / F.col(cols)).withColumn("text", F.lit(""))


def resize(size: Column, factor: Column) -> Column:
    return F.greatest(size * factor, F.lit(MIN_PT))


SIDES = ("left", "top", "right", "bottom")
#: A side's border: width in points; style none is a border that is said to be absent, null one of which nothing is said.
BORDER = "struct<style:string,width:double,color:string>"


def cell_edges(cells: DataFrame, table: list[str], cell: list[str]) -> DataFrame:
    """(table, kind, along, at, cell, side, border): the unit edges of the grid that cells touch. Neighbours name an edge alike,
    so the columns up to `at` are the key of what two cells share."""
    rows, cols = (F.sequence(F.col(a), F.col(a) + F.col(f"{a}_span") - 1) for a in ("row", "col"))
    where = {"left": ("v", rows, F.col("col")), "right": ("v", rows, F.col("col") + F.col("col_span")), "top": ("h", cols, F.col("row")), "bottom": ("h", cols, F.col("row") + F.col("row_span"))}
    sides = [F.struct(F.lit(s).alias("side"), F.lit(kind).alias("kind"), along.alias("places"), at.cast("int").alias("at"), F.col(f"b_{s}").alias("border")) for s, (kind, along, at) in where.items()]
    each = cells.select(*table, *[F.col(c).alias(f"_{c}") for c in cell], F.explode(F.array(*sides)).alias("e"))
    return each.select(*table, *[F.col(f"_{c}").alias(c) for c in cell], "e.side", "e.kind", F.explode("e.places").alias("along"), "e.at", "e.border")


def shared_edges(cells: DataFrame, table: list[str], cell: list[str]) -> DataFrame:
    """cells with each side (b_left, ...) as drawn: of the two cells that own an edge the stronger border wins.

    Wider is stronger, then double, solid, dashed, dotted, then the cell on the left or above; a border that is said to be
    absent loses to any. The winners are aggregated by edge and met by an equi-join; a side takes what its first edge shows.
    """
    e = cell_edges(cells, table, cell)
    key = [*table, "kind", "along", "at"]
    rank = F.when(F.col("border.style") == "none", F.lit(-1.0)).otherwise(F.col("border.width"))
    kind = F.array_position(F.array(*map(F.lit, ("dotted", "dashed", "solid", "double"))), F.col("border.style"))
    strength = F.when(F.col("border").isNotNull(), F.struct(rank.alias("rank"), kind.alias("kind"), F.col("side").isin("right", "bottom").alias("first"), F.col("border").alias("border")))
    won = e.groupBy(*key).agg(F.max(strength).alias("won")).select(*key, F.col("won.border").alias("shown"))
    drawn = e.join(won, key).groupBy(*table, *cell).agg(*[F.min_by("shown", F.when(F.col("side") == s, F.col("along"))).alias(f"b_{s}") for s in SIDES])
    return cells.drop(*[f"b_{s}" for s in SIDES]).join(drawn, [*table, *cell])
