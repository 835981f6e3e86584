"""Registered queries of table edits, grids and heights, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import edits, tables
from foliant.plans.queries import query
from foliant.session import table

_CELLS = """n AS (SELECT n_regionkey AS t, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS row, n_name FROM nation),
c AS (SELECT t, row, k AS col, n_name || k AS text FROM n, (VALUES (0), (1), (2)) AS v(k))"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """A table of three columns for every region, a row for each of its nations."""
    row = (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("row")
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("t"), row, "n_name")
    cells = n.withColumn("col", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return cells.select("t", "row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.concat("n_name", F.col("col")).alias("text"))


@query(f"""
WITH {_CELLS}, i AS (SELECT t, CASE WHEN row > 1 THEN row + 1 ELSE row END AS row, col, text FROM c UNION ALL SELECT t, 2, col, '' FROM c WHERE row = 1)
SELECT t, (CASE WHEN t % 2 = 0 AND row > 0 THEN row - 1 ELSE row END)::INTEGER AS row, col, text FROM i WHERE NOT (t % 2 = 0 AND row = 0)""")
def table_row_edits(spark, sf):
    more = tables.insert_row(_cells(spark, sf), ["t"], F.lit(1))
    return tables.delete_row(more, ["t"], F.when(F.col("t") % 2 == 0, 0)).select("t", "row", "col", "text")


@query(f"""
WITH {_CELLS}, i AS (SELECT t, row, CASE WHEN col > 1 THEN col + 1 ELSE col END AS col, text FROM c UNION ALL SELECT t, row, 2, '' FROM c WHERE col = 1)
SELECT t, row, (CASE WHEN t % 2 = 0 AND col > 0 THEN col - 1 ELSE col END)::INTEGER AS col, text FROM i WHERE NOT (t % 2 = 0 AND col = 0)""")
def table_column_edits(spark, sf):
    more = tables.insert_column(_cells(spark, sf), ["t"], F.lit(1))
    return tables.delete_column(more, ["t"], F.when(F.col("t") % 2 == 0, 0)).select("t", "row", "col", "text")


@query(f"""
WITH {_CELLS}
SELECT a.t, a.row, a.col, CASE WHEN a.row = 0 AND a.col = 2 THEN 2 ELSE 1 END AS row_span, CASE WHEN a.row = 1 AND a.col = 0 THEN 2 ELSE 1 END AS col_span,
  CASE WHEN a.row = 1 AND a.col = 0 OR a.row = 0 AND a.col = 2 THEN a.text || chr(10) || b.text ELSE a.text END AS text
FROM c a LEFT JOIN c b ON a.t = b.t AND (a.row = 1 AND a.col = 0 AND b.row = 1 AND b.col = 1 OR a.row = 0 AND a.col = 2 AND b.row = 1 AND b.col = 2) WHERE NOT (a.row = 1 AND a.col IN (1, 2))""")
def table_merges(spark, sf):
    wide = tables.merge_right(_cells(spark, sf), ["t"], F.lit(1), F.lit(0))
    return tables.merge_down(wide, ["t"], F.lit(0), F.lit(2)).select("t", "row", "col", "row_span", "col_span", "text")


@query("SELECT n_nationkey AS t, r::INTEGER AS row, c::INTEGER AS col, CASE WHEN r = 0 AND c = 0 THEN n_name ELSE '' END AS text FROM nation, unnest(range(0, n_nationkey % 3 + 1)) AS x(r), unnest(range(0, n_nationkey % 4 + 1)) AS y(c)")
def table_unmerge(spark, sf):
    k = F.col("n_nationkey")
    spanning = table(spark, sf, "nation").select(k.alias("t"), F.lit(0).alias("row"), F.lit(0).alias("col"), (k % 3 + 1).cast("int").alias("row_span"), (k % 4 + 1).cast("int").alias("col_span"), F.col("n_name").alias("text"))
    return tables.unmerge(spanning, ["t"]).select("t", "row", "col", "text")


@query("""
WITH o AS (SELECT n_nationkey AS t, n_nationkey % 3 AS k FROM nation)
SELECT t, 0 AS row, x AS ord, (CASE WHEN x = 0 THEN 0 WHEN x = 1 THEN 1 ELSE 2 END)::INTEGER AS col FROM o, (VALUES (0), (1), (2)) AS v(x)
UNION ALL SELECT t, 1, x, (CASE k WHEN 0 THEN x + 1 WHEN 1 THEN CASE x WHEN 0 THEN 0 ELSE 2 END ELSE x END)::INTEGER FROM o, (VALUES (0), (1)) AS v(x)""")
def occupied_columns(spark, sf):
    """The first row's cell k spans two rows and pushes the second row's cells aside."""
    t = table(spark, sf, "nation").select(F.col("n_nationkey").alias("t"), (F.col("n_nationkey") % 3).cast("int").alias("k"))
    one = F.lit(1)
    top = t.withColumn("ord", F.explode(F.array(*map(F.lit, range(3))))).select("t", F.lit(0).alias("row"), "ord", F.when(F.col("ord") == F.col("k"), 2).otherwise(1).alias("row_span"), one.alias("col_span"))
    low = t.withColumn("ord", F.explode(F.array(*map(F.lit, range(2))))).select("t", F.lit(1).alias("row"), "ord", one.alias("row_span"), one.alias("col_span"))
    return tables.occupy(top.unionByName(low), ["t"]).select("t", "row", "ord", "col")


@query("""
WITH c AS (SELECT n_regionkey AS t, (n_nationkey // 4)::BIGINT AS row, n_nationkey % 4 AS col, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS rs, (n_nationkey * 3)::DOUBLE AS h FROM nation)
SELECT t, row, max(h) FILTER (rs = 1) AS height FROM c GROUP BY t, row""")
def row_heights(spark, sf):
    k = F.col("n_nationkey")
    cells = table(spark, sf, "nation").select(F.col("n_regionkey").alias("t"), F.floor(k / 4).alias("row"), F.when(k % 5 == 0, 2).otherwise(1).alias("row_span"), (k * 3).cast("double").alias("height"))
    return tables.row_heights(cells, ["t"])


@query("""
WITH c AS (SELECT n_nationkey AS k, n_nationkey % 2 + 1 AS rs, greatest(n_nationkey * 4.0, 16.0) AS need FROM nation)
SELECT k AS doc_id, r::INTEGER AS r, round(greatest(need / rs, 15) * 10)::BIGINT AS tenths FROM c, unnest(range(0, rs)) AS u(r)""")
def written_row_heights(spark, sf):
    from foliant.sinks.parts import row_heights_pt

    k = F.col("n_nationkey")
    cells = table(spark, sf, "nation").select(k.alias("doc_id"), F.lit(0).alias("table"), F.lit(0).alias("row"), (k % 2 + 1).cast("int").alias("row_span"), (k * 4).cast("double").alias("height"), F.lit(300.0).alias("width"), F.col("n_name").alias("text"))
    return row_heights_pt(cells).select("doc_id", "r", F.round(F.col("height") * 10).cast("long").alias("tenths"))


@query("""
SELECT n_nationkey AS t, r::INTEGER AS row, c::INTEGER AS col, round(400.0 / (n_nationkey % 4 + 1) * 100)::BIGINT AS width FROM nation, unnest(range(0, n_nationkey % 3 + 1)) AS x(r), unnest(range(0, n_nationkey % 4 + 1)) AS y(c)""")
def table_new(spark, sf):
    k = F.col("n_nationkey")
    asked = table(spark, sf, "nation").select(k.alias("t"), (k % 3 + 1).cast("int").alias("rows"), (k % 4 + 1).cast("int").alias("cols"))
    return tables.new_table(asked).select("t", "row", "col", F.round(F.col("width") * 100).cast("long").alias("width"))


@query("""
SELECT p_partkey, greatest(p_size * 0.5, 12)::DOUBLE AS height, greatest(least(p_size + 30.0, p_size + 100 - 12.0), 12)::DOUBLE AS left_, (p_size + 100 - greatest(least(p_size + 30.0, p_size + 100 - 12.0), 12))::DOUBLE AS right_,
 CASE WHEN p_partkey % 3 = 0 THEN '#EEEEEE' END AS background, CASE WHEN p_partkey % 2 = 0 THEN 'top' END AS valign, CASE WHEN p_partkey % 5 = 0 THEN 'none' END AS border, p_partkey % 4 < 2 AS alike FROM part""")
def table_formats(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    left, right = tables.move_boundary(s, F.lit(100.0), F.lit(30.0))
    said = tables.cell_format(background=F.when(k % 3 == 0, "#EEEEEE").otherwise("#FFFFFF"), valign=F.when(k % 2 == 0, "top").otherwise("middle"), border=F.when(k % 5 == 0, "none").otherwise("0.75pt solid #555555"))
    alike = tables.same_border(F.when(k % 4 != 1, F.struct(F.lit(1.0).alias("w"))), F.when(k % 4 == 0, F.struct(F.lit(1.0).alias("w"))))
    return table(spark, sf, "part").select("p_partkey", tables.resize(s, F.lit(0.5)).alias("height"), left.alias("left_"), right.alias("right_"), *said, alike.alias("alike"))


@query("""
WITH b AS (SELECT n_regionkey AS doc_id, 'b' || n_nationkey AS data_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation),
e AS (SELECT doc_id, max(CASE WHEN ord = 1 THEN ord END) AS target FROM b GROUP BY doc_id)
SELECT doc_id, data_id, (row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN ord = 4 THEN target - 0.5 ELSE ord END) - 1)::INTEGER AS ord FROM b JOIN e USING (doc_id)""")
def table_move(spark, sf):
    """The fifth block of each document goes before its second."""
    w = W.partitionBy("n_regionkey")
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("b"), "n_nationkey").alias("data_id"), (F.row_number().over(w.orderBy("n_nationkey")) - 1).alias("ord"))
    by = W.partitionBy("doc_id")
    named = n.withColumn("what", F.max(F.when(F.col("ord") == 4, F.col("data_id"))).over(by)).withColumn("before", F.max(F.when(F.col("ord") == 1, F.col("data_id"))).over(by))
    return edits.move_block(named, ["doc_id"], "what", "before").select("doc_id", "data_id", "ord")


@query("""
WITH c AS (SELECT n_regionkey AS t, n_nationkey // 5 AS row, (n_nationkey % 3)::INTEGER AS col, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey * 4 END AS w FROM nation)
SELECT t, col, coalesce(arg_min(w, row) FILTER (w > 0), 60)::DOUBLE AS width FROM c GROUP BY t, col""")
def edit_grid(spark, sf):
    k = F.col("n_nationkey")
    cells = table(spark, sf, "nation").select(F.col("n_regionkey").alias("t"), F.floor(k / 5).alias("row"), (k % 3).cast("int").alias("col"), F.lit(1).alias("col_span"), F.when(k % 4 != 0, k * 4).otherwise(0).cast("double").alias("width"))
    return tables.edit_grid(cells, ["t"])
