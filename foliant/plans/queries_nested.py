"""Registered round trips of what stands inside of cells, and of pictures, in three formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.plans.queries import query
from foliant.plans.queries_documents import through
from foliant.session import table, written_by_rows
from foliant.sinks.document import Document


def _nested(spark: SparkSession, sf: str) -> Document:
    """A document for every conversation: a table of one row a turn, the role in its first cell, in its second the turn's text and a
    table of one cell that says the turn's number in bold."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("doc_id"), "role", "turn", F.coalesce("text", F.lit("")).alias("text"), (F.row_number().over(w) - 1).alias("i"))
    none, base = F.lit(None).cast("int"), 1 + 4 * F.col("i")
    block = lambda df, ord_, tag, inside: df.select("doc_id", ord_.cast("int").alias("ord"), F.lit(tag).alias("tag"), inside.cast("int").alias("inside"))
    docs = t.select("doc_id").distinct()
    role, held, deep = 3 * F.col("i") + 1, 3 * F.col("i") + 2, 3 * F.col("i") + 3
    blocks = block(docs, F.lit(0), "table", none).unionByName(block(t, base, "p", role)).unionByName(block(t, base + 1, "p", held)).unionByName(block(t, base + 2, "table", held)).unionByName(block(t, base + 3, "p", deep))
    run = lambda ord_, text, bold: t.select("doc_id", ord_.cast("int").alias("ord"), F.lit(0).alias("run"), text.alias("text"), F.lit(bold).alias("bold"))
    runs = run(base, F.col("role"), False).unionByName(run(base + 1, F.col("text"), False)).unionByName(run(base + 3, F.concat(F.lit("turn "), "turn"), True))
    cell = lambda ord_, row, col, key: t.select("doc_id", ord_.cast("int").alias("ord"), row.cast("int").alias("row"), F.lit(col).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(90.0).alias("width"), F.lit("").alias("text"), key.cast("int").alias("cell"))
    cells = cell(F.lit(0), F.col("i"), 0, role).unionByName(cell(F.lit(0), F.col("i"), 1, held)).unionByName(cell(base + 2, F.lit(0), 0, deep))
    return Document(blocks, runs, cells)


_NESTED_SQL = r"""
WITH t AS (SELECT conv_id AS doc_id, role, turn, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS i FROM conversations)
SELECT doc_id, i AS row, 0 AS col, false AS inner_table, false AS bold, md5(role) AS text_md5 FROM t
UNION ALL SELECT doc_id, i, 1, false, false, md5(text) FROM t
UNION ALL SELECT doc_id, i, 1, true, true, md5('turn ' || turn) FROM t"""


def _nested_roundtrip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """What stands in the cells: of the inner tables the place of the cell that holds them."""
    back = through(_nested(spark, sf), kind)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "")
    texts = back.runs.groupBy("doc_id", "ord").agg(F.bool_and("bold").alias("bold"), text.alias("text"))
    held = back.blocks.filter("inside is not null and tag = 'p'").select("doc_id", "ord", F.col("inside").alias("cell")).join(texts, ["doc_id", "ord"], "left")
    own = held.select("doc_id", "cell", F.coalesce("bold", F.lit(False)).alias("bold"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    places = back.cells.select("doc_id", "cell", F.col("ord").alias("table_ord"), "row", "col")
    around = back.blocks.filter("tag = 'table'").select("doc_id", F.col("ord").alias("table_ord"), F.col("inside").alias("outer"))
    outer = places.select("doc_id", F.col("cell").alias("outer"), F.col("row").alias("o_row"), F.col("col").alias("o_col"))
    found = own.join(places, ["doc_id", "cell"]).join(around, ["doc_id", "table_ord"]).join(outer, ["doc_id", "outer"], "left")
    return written_by_rows(found.select("doc_id", F.coalesce("o_row", "row").cast("int").alias("row"), F.coalesce("o_col", "col").cast("int").alias("col"), F.col("outer").isNotNull().alias("inner_table"), "bold", "text_md5"), "found")


@query(_NESTED_SQL)
def nested_roundtrip_docx(spark, sf):
    return _nested_roundtrip(spark, sf, "docx")


@query(_NESTED_SQL)
def nested_roundtrip_odt(spark, sf):
    return _nested_roundtrip(spark, sf, "odt")


@query(_NESTED_SQL)
def nested_roundtrip_hwpx(spark, sf):
    return _nested_roundtrip(spark, sf, "hwpx")


def _pictured(spark: SparkSession, sf: str) -> Document:
    """A document for every ten vectors: a block with a picture (the vector's bytes) for each; every third block shows the first
    vector's picture once more, under another name, and every fifth vector's picture is shown by none."""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("doc_id"), (F.col("vec_id") % 10).cast("int").alias("k"), F.to_json(F.struct("embedding")).alias("data"))
    first = e.filter("k = 0").select("doc_id", F.col("data").alias("first"))
    e = e.join(first, "doc_id", "left")
    name = F.concat(F.lit("pic"), "k", F.lit(".png"))
    images = e.select("doc_id", name.alias("image"), F.lit("png").alias("ext"), F.when((F.col("k") % 3 == 0) & F.col("first").isNotNull(), F.col("first")).otherwise(F.col("data")).cast("binary").alias("data"))
    blocks = e.select("doc_id", F.col("k").alias("ord"), F.lit("p").alias("tag"))
    runs = e.select("doc_id", F.col("k").alias("ord"), F.lit(0).alias("run"), F.concat(F.lit("vector "), "k").alias("text"), F.lit(None).cast("string").alias("picture"))
    shown = e.filter("k % 5 <> 4").select("doc_id", F.col("k").alias("ord"), F.lit(1).alias("run"), F.lit("").alias("text"), name.alias("picture"))
    both = runs.unionByName(shown).withColumns({"pic_width": (F.col("ord") + 10).cast("double"), "pic_height": F.lit(20.0)})
    return Document(blocks, both, images=images)


_PICTURES_SQL = """
WITH e AS (SELECT vec_id // 10 AS doc_id, (vec_id % 10)::INTEGER AS ord FROM embeddings), f AS (SELECT DISTINCT doc_id FROM e WHERE ord = 0)
SELECT e.doc_id, e.ord, CASE WHEN e.ord % 3 = 0 AND f.doc_id IS NOT NULL THEN 0 ELSE e.ord END AS vector, (e.ord + 10) * 100 AS width, 2000 AS height, (SELECT count(DISTINCT CASE WHEN x.ord % 3 = 0 AND f.doc_id IS NOT NULL THEN 0 ELSE x.ord END) FROM e x WHERE x.doc_id = e.doc_id AND x.ord % 5 <> 4) AS files
FROM e LEFT JOIN f ON e.doc_id = f.doc_id WHERE e.ord % 5 <> 4"""


def _picture_roundtrip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Which vector's bytes each block shows, and the pictures that a package has."""
    back = through(_pictured(spark, sf), kind)
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("doc_id"), (F.col("vec_id") % 10).cast("int").alias("vector"), F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256).alias("sha"))
    data = back.images.select("doc_id", F.col("image").alias("picture"), F.sha2("data", 256).alias("sha"))
    files = data.groupBy("doc_id").agg(F.count("*").alias("files"))
    shown = back.runs.filter("picture is not null").select("doc_id", "ord", "picture", F.round("pic_width").cast("int").alias("width"), F.round("pic_height").cast("int").alias("height"))
    return shown.join(data, ["doc_id", "picture"]).join(e, ["doc_id", "sha"]).join(files, "doc_id").select("doc_id", "ord", "vector", "width", "height", "files")


@query(_PICTURES_SQL)
def picture_roundtrip_docx(spark, sf):
    return _picture_roundtrip(spark, sf, "docx")


@query(_PICTURES_SQL)
def picture_roundtrip_odt(spark, sf):
    return _picture_roundtrip(spark, sf, "odt")


@query(_PICTURES_SQL)
def picture_roundtrip_hwpx(spark, sf):
    return _picture_roundtrip(spark, sf, "hwpx")


@query(r"""
WITH l AS (SELECT doc_id, i, regexp_replace(lines[i], '[\s\x00-\x1F]+', '', 'g') AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d, unnest(range(1, len(lines) + 1)) AS u(i))
SELECT doc_id, count(*)::BIGINT AS paragraphs, md5(string_agg(t, '|' ORDER BY i)) AS text_md5 FROM l WHERE t <> '' GROUP BY doc_id""")
def implicit_paragraphs(spark, sf):
    """Every text as a page: every third line is a paragraph, the others stand loose between them, half of them inside a division."""
    from foliant.functions.text import escape, xml_safe
    from foliant.plans import tree
    from foliant.sources import markup

    line = escape(xml_safe(F.col("x")))
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "x"))
    cut = F.concat(F.lit("<b>"), F.substring_index(line, " ", 1), F.lit("</b>"), F.expr("substr({0}, length(substring_index({0}, ' ', 1)) + 1)".format("e")))
    shown = lines.withColumn("e", line).withColumn("h", F.when(F.col("i") % 3 == 0, F.concat(F.lit("<p>"), "e", F.lit("</p>"))).when(F.col("i") % 3 == 1, F.concat(F.lit("<div>"), cut, F.lit("</div>"))).otherwise(F.concat(F.lit("<span>"), "e", F.lit("</span>"))))
    pages = shown.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda p: p["h"]), "").alias("html"))
    nodes = tree.implicit_paragraphs(markup.html_nodes(pages, "doc_id", blocks=["p"]))
    own = nodes.filter("name = '#text'").select("doc_id", "node_id", F.coalesce("implicit", "block_id").alias("para"), F.regexp_replace("text", r"[\s\x00-\x1F]+", "").alias("t"))
    paras = own.filter("para is not null").groupBy("doc_id", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda p: p["t"]), "").alias("t")).filter("t <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "t"))), lambda p: p["t"]), "|")
    return paras.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.md5(text.cast("binary")).alias("text_md5"))


def _boxed(spark: SparkSession, sf: str) -> Document:
    """A document for every nation, a table of one row a customer: both cells of a row name their common edge, each its own width."""
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), (F.row_number().over(w) - 1).alias("row"))
    mm = lambda n: F.element_at(F.array(F.lit(0.3), F.lit(0.5), F.lit(1.0)), (n % 3 + 1).cast("int")) / 25.4 * 72
    border = lambda style, width, tint: F.struct(style.alias("style"), width.cast("double").alias("width"), tint.cast("string").alias("color"))
    none = border(F.lit("none"), F.lit(0.0), F.lit(None))
    style = F.when(F.col("k") % 2 == 0, "dashed").otherwise("solid")
    k = F.col("k")

    def cell(col: int, name, left, right):
        return c.select("doc_id", F.lit(0).alias("ord"), "row", F.lit(col).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(90.0).alias("width"), name.alias("text"), left.alias("b_left"), none.alias("b_top"), right.alias("b_right"), none.alias("b_bottom"), (k % 4 + 1).cast("double").alias("p_left"), F.lit(2.0).alias("p_top"), F.lit(2.0).alias("p_right"), F.lit(2.0).alias("p_bottom"), F.when(k % 5 == 0, "#FFEE00").alias("background"), F.lit("top").alias("valign"))

    cells = cell(0, F.col("name"), none, border(style, mm(k), F.lit("#112233"))).unionByName(cell(1, F.concat("name", F.lit(" too")), F.when(k % 7 == 0, none).otherwise(border(F.lit("dotted"), mm(k + 1), F.lit("#445566"))), border(F.lit("solid"), F.lit(0.5 / 25.4 * 72), F.lit("#000000"))))
    docs = c.select("doc_id").distinct()
    blocks = docs.select("doc_id", F.lit(0).alias("ord"), F.lit("table").alias("tag")).unionByName(docs.select("doc_id", F.lit(1).alias("ord"), F.lit("p").alias("tag")))
    return Document(blocks, docs.select("doc_id", F.lit(1).alias("ord"), F.lit(0).alias("run"), F.lit("end").alias("text")), cells)


_BOXED_SQL = """
WITH c AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey AS k, c_name, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS row FROM customer),
m AS (SELECT *, [0.3, 0.5, 1.0][k % 3 + 1] AS a, CASE WHEN k % 7 = 0 THEN -1 ELSE [0.3, 0.5, 1.0][(k + 1) % 3 + 1] END AS b FROM c),
e AS (SELECT *, CASE WHEN a > b THEN CASE k % 2 WHEN 0 THEN 'dashed' ELSE 'solid' END ELSE 'dotted' END AS style, greatest(a, b)::DOUBLE AS mm, CASE WHEN a > b THEN '#112233' ELSE '#445566' END AS color FROM m)
SELECT doc_id, row, col::INTEGER AS col, CASE col WHEN 0 THEN c_name ELSE c_name || ' too' END AS text, CASE col WHEN 0 THEN style ELSE 'solid' END AS right_style, CASE col WHEN 0 THEN mm ELSE 0.5 END AS right_mm, CASE col WHEN 0 THEN color ELSE '#000000' END AS right_color,
 CASE col WHEN 0 THEN 'none' ELSE style END AS left_style, (k % 4 + 1) * 100 AS pad_left, CASE WHEN k % 5 = 0 THEN '#FFEE00' END AS background, 'top' AS valign FROM e, (SELECT unnest([0, 1]) AS col) x"""


def _cell_format_roundtrip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    from foliant.functions import units

    cells = through(_boxed(spark, sf), kind).cells
    return cells.select("doc_id", "row", "col", "text", F.col("b_right.style").alias("right_style"), units.snap_border_mm(units.pt_to_mm(F.col("b_right.width"))).alias("right_mm"), F.col("b_right.color").alias("right_color"), F.col("b_left.style").alias("left_style"), F.col("p_left").cast("int").alias("pad_left"), "background", "valign")


@query(_BOXED_SQL)
def cell_format_roundtrip_docx(spark, sf):
    return _cell_format_roundtrip(spark, sf, "docx")


@query(_BOXED_SQL)
def cell_format_roundtrip_odt(spark, sf):
    return _cell_format_roundtrip(spark, sf, "odt")


@query(_BOXED_SQL)
def cell_format_roundtrip_hwpx(spark, sf):
    return _cell_format_roundtrip(spark, sf, "hwpx")


@query("""
SELECT 'c' || conv_id % 50 || '/' || conv_id || '.txt' AS path, strlen(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text))::BIGINT AS bytes, true AS saved, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS content_md5
FROM conversations GROUP BY conv_id""")
def saved_back(spark, sf):
    """Every conversation saved as a file of its own under its folder, by a write with a commit; files and result read again."""
    from foliant.session import scratch_path
    from foliant.sinks import saveback

    c = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "\n")
    rows = c.groupBy("conv_id").agg(whole.cast("binary").alias("content"))
    root = scratch_path(spark, "saved")
    target = F.concat(F.lit("c"), F.col("conv_id") % 50, F.lit("/"), F.col("conv_id"), F.lit(".txt"))
    result = saveback.save(rows.select(target.alias("target"), "content", F.lit(False).alias("overwrote"), F.lit(None).cast("string").alias("note")), root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    read = files.select(F.regexp_extract("path", r"(c\d+/\d+\.txt)$", 1).alias("path"), F.md5("content").alias("content_md5"))
    return result.join(read, "path", "left").select("path", "bytes", "saved", "content_md5")
