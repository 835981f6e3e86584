"""Registered round trips of whole documents: styled runs, links, lists, notes, bands, fields and tables, in three formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.plans.queries import query
from foliant.session import table
from foliant.session import written_by_rows as written
from foliant.sinks import document as sink
from foliant.sinks.document import Document
from foliant.sources import document as source

KINDS = ("docx", "odt", "hwpx")


def through(doc: Document, kind: str) -> Document:
    """A document written as packages and read back. The packages are stored between: no task has a worker that zips and
    another that parses, and pictures are read without packing again."""
    return source.read(written(sink.write(doc, kind), "packages"), kind)


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A document for every nation, a block for each of its customers (k), in order."""
    ord_ = (F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("ord")
    return table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), ord_, F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")


_B = "b AS (SELECT c_nationkey::BIGINT AS doc_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS ord, c_custkey AS k, c_name, c_mktsegment FROM customer)"


def _styled(spark: SparkSession, sf: str) -> Document:
    b, k = _blocks(spark, sf), F.col("k")
    blocks = b.select("doc_id", "ord", F.lit("p").alias("tag"), F.when(k % 3 == 0, "center").when(k % 3 == 1, "right").alias("align"), (k % 4 * 10).cast("double").alias("left"), F.when(k % 4 == 3, -5.0).otherwise(0.0).alias("first_line"), (k % 7 == 0).alias("page_break"))
    name = b.select("doc_id", "ord", F.lit(0).alias("run"), F.concat("c_name", F.lit(" <&>\t\n x")).alias("text"), (k % 2 == 0).alias("bold"), (k % 3 == 0).alias("italic"), (k % 5 == 0).alias("underline"), (k % 7 == 0).alias("strike"), F.when(k % 4 == 0, "#FF0000").otherwise("#000000").alias("color"), (k % 3 + 9).cast("double").alias("size"), F.when(k % 6 == 0, "Serif & Co").alias("font"), F.when(k % 11 == 0, "super").when(k % 11 == 1, "sub").alias("position"), F.lit(None).cast("string").alias("link"))
    link = F.when(k % 4 == 1, F.concat(F.lit("https://example.org/?a=1&b="), k % 10)).when(k % 4 == 2, F.concat(F.lit("#b"), k))
    more = b.select("doc_id", "ord", F.lit(1).alias("run"), F.col("c_mktsegment").alias("text"), F.lit(False).alias("bold"), F.lit(True).alias("italic"), F.lit(True).alias("underline"), F.lit(False).alias("strike"), F.lit("#0000FF").alias("color"), F.lit(10.0).alias("size"), F.lit(None).cast("string").alias("font"), F.lit(None).cast("string").alias("position"), link.alias("link"))
    return Document(blocks, name.unionByName(more))


_STYLED_SQL = f"""
WITH {_B}
SELECT doc_id, ord, 0 AS run, c_name || ' <&>' || chr(9) || chr(10) || ' x' AS text, k % 2 = 0 AS bold, k % 3 = 0 AS italic, k % 5 = 0 AS underline, k % 7 = 0 AS strike, CASE WHEN k % 4 = 0 THEN '#FF0000' ELSE '#000000' END AS color,
 ((k % 3 + 9) * 100)::INTEGER AS size, CASE WHEN k % 6 = 0 THEN 'Serif & Co' END AS font, CASE k % 11 WHEN 0 THEN 'super' WHEN 1 THEN 'sub' END AS position, NULL AS link FROM b
UNION ALL SELECT doc_id, ord, 1, c_mktsegment, false, true, true, false, '#0000FF', 1000, NULL, NULL, CASE k % 4 WHEN 1 THEN 'https://example.org/?a=1&b=' || k % 10 WHEN 2 THEN '#b' || k END FROM b"""


def _styled_roundtrip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    runs = through(_styled(spark, sf), kind).runs
    return runs.select("doc_id", "ord", "run", "text", "bold", "italic", "underline", "strike", "color", "size", F.nullif("font", F.lit(sink.BASE_FONT)).alias("font"), "position", "link")


@query(_STYLED_SQL)
def styled_roundtrip_docx(spark, sf):
    return _styled_roundtrip(spark, sf, "docx")


@query(_STYLED_SQL)
def styled_roundtrip_odt(spark, sf):
    return _styled_roundtrip(spark, sf, "odt")


@query(_STYLED_SQL)
def styled_roundtrip_hwpx(spark, sf):
    return _styled_roundtrip(spark, sf, "hwpx")


_SHAPES_SQL = f"""
WITH {_B}, v AS (SELECT unnest(['docx', 'odt', 'hwpx']) AS kind)
SELECT kind, doc_id, ord, CASE k % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'right' END AS align, (k % 4 * 1000)::INTEGER AS "left", CASE WHEN k % 4 = 3 THEN -500 ELSE 0 END::INTEGER AS first_line, k % 7 = 0 AS page_break FROM b, v"""


@query(_SHAPES_SQL)
def paragraph_shapes_roundtrip(spark, sf):
    out = None
    for kind in KINDS:
        one = through(_styled(spark, sf), kind).blocks.select(F.lit(kind).alias("kind"), "doc_id", "ord", "align", "left", "first_line", "page_break")
        out = one if out is None else out.unionByName(one)
    return out


def _listed(spark: SparkSession, sf: str) -> Document:
    """Headings, some numbered, two kinds of lists with levels, and plain paragraphs between them."""
    b, k = _blocks(spark, sf), F.col("ord")
    tag = F.when(k % 8 == 0, "h1").when(k % 8 == 1, "h3").when(k % 8 == 7, "p").otherwise("li")
    blocks = b.select("doc_id", "ord", tag.alias("tag"), F.when(tag == "li", (k / 8).cast("int") + 1).alias("list_id"), F.when(tag == "li", F.when(k % 8 == 2, 0).when(k % 8 == 3, 1).when(k % 8 == 4, 2).otherwise(F.lit(0))).alias("level"), ((k / 8).cast("int") % 2 == 0).alias("ordered"), F.when(tag.startswith("h"), F.lit(True)).alias("numbered"))
    return Document(blocks, b.select("doc_id", "ord", F.lit(0).alias("run"), F.col("c_name").alias("text"), F.lit(10.0).alias("size")))


_LISTS_SQL = f"""
WITH {_B}, t AS (SELECT *, CASE ord % 8 WHEN 0 THEN 'h1' WHEN 1 THEN 'h3' WHEN 7 THEN 'p' ELSE 'li' END AS tag FROM b)
SELECT doc_id, ord, tag, c_name AS text, CASE WHEN tag = 'li' THEN CASE ord % 8 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END END::INTEGER AS level, CASE WHEN tag = 'li' THEN ord // 8 % 2 = 0 END AS ordered, tag IN ('h1', 'h3') AS numbered FROM t"""


def _list_roundtrip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return through(_listed(spark, sf), kind).blocks.select("doc_id", "ord", "tag", "text", "level", "ordered", "numbered")


@query(_LISTS_SQL)
def list_roundtrip_docx(spark, sf):
    return _list_roundtrip(spark, sf, "docx")


@query(_LISTS_SQL)
def list_roundtrip_odt(spark, sf):
    return _list_roundtrip(spark, sf, "odt")


@query(_LISTS_SQL)
def list_roundtrip_hwpx(spark, sf):
    return _list_roundtrip(spark, sf, "hwpx")


def _noted(spark: SparkSession, sf: str) -> Document:
    """Every fifth block has a footnote after its text; a header line, and a footer with the page's number and their count."""
    b = _blocks(spark, sf).withColumn("note", F.when(F.col("ord") % 5 == 0, (F.col("ord") / 5).cast("int") + 1))
    body = b.select("doc_id", "ord", F.lit("p").alias("tag"), F.lit(None).cast("string").alias("band"))
    docs = b.select("doc_id").distinct()
    most = F.lit(1_000_000)
    bands = docs.select("doc_id", most.alias("ord"), F.lit("p").alias("tag"), F.lit("header").alias("band")).unionByName(docs.select("doc_id", (most + 1).alias("ord"), F.lit("p").alias("tag"), F.lit("footer").alias("band")))
    none = F.lit(None)
    text = lambda df, ord_, run, text, note=none, field=none: df.select("doc_id", ord_.alias("ord"), F.lit(run).alias("run"), text.alias("text"), note.cast("int").alias("note"), field.cast("string").alias("field"))
    runs = text(b, F.col("ord"), 0, F.col("c_name")).unionByName(text(b.filter("note is not null"), F.col("ord"), 1, F.lit(""), F.col("note"))).unionByName(text(b, F.col("ord"), 2, F.col("c_mktsegment")))
    runs = runs.unionByName(text(docs, most, 0, F.concat(F.lit("head of "), "doc_id")))
    for k, (t, f) in enumerate((("", "page"), (" of ", None), ("", "pages"))):
        runs = runs.unionByName(text(docs, most + 1, k, F.lit(t), field=F.lit(f)))
    notes = b.filter("note is not null").select("doc_id", "note", F.concat(F.lit("note on "), "c_name").alias("text"))
    return Document(body.unionByName(bands), runs, notes=notes)


_NOTES_SQL = f"""
WITH {_B}, n AS (SELECT doc_id, max(ord) AS last FROM b GROUP BY doc_id)
SELECT doc_id, 'note' AS what, ord // 5 + 1 AS place, ord AS at, 'note on ' || c_name AS text FROM b WHERE ord % 5 = 0
UNION ALL SELECT doc_id, 'body', ord, 1, c_name || c_mktsegment FROM b
UNION ALL SELECT doc_id, 'header', last + 2, 1, 'head of ' || doc_id FROM n
UNION ALL SELECT doc_id, 'footer', last + 1, 1, ' of ' FROM n
UNION ALL SELECT doc_id, 'page', last + 1, 0, '' FROM n
UNION ALL SELECT doc_id, 'pages', last + 1, 2, '' FROM n"""


def _note_roundtrip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Notes with the block of their reference, texts by their band, fields by their place."""
    back = through(_noted(spark, sf), kind)
    runs = written(back.runs.select("doc_id", "ord", "run", "note", "field"), "runs")
    refs = runs.filter("note is not null").select("doc_id", "note", F.col("ord").alias("at"))
    row = lambda df, what, place, at, text: df.select("doc_id", what.alias("what"), place.cast("int").alias("place"), at.cast("int").alias("at"), text.alias("text"))
    out = row(back.notes.join(refs, ["doc_id", "note"]), F.lit("note"), F.col("note"), F.col("at"), F.col("text"))
    out = out.unionByName(row(back.blocks, F.coalesce("band", F.lit("body")), F.col("ord"), F.lit(1), F.col("text")))
    return out.unionByName(row(runs.filter("field is not null"), F.col("field"), F.col("ord"), F.col("run"), F.lit("")))


@query(_NOTES_SQL)
def note_roundtrip_docx(spark, sf):
    return _note_roundtrip(spark, sf, "docx")


@query(_NOTES_SQL)
def note_roundtrip_odt(spark, sf):
    return _note_roundtrip(spark, sf, "odt")


@query(_NOTES_SQL)
def note_roundtrip_hwpx(spark, sf):
    return _note_roundtrip(spark, sf, "hwpx")


def _tabled(spark: SparkSession, sf: str) -> Document:
    """For every region a table: a title over both columns, then a row for each nation whose first cell spans two rows."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), "n_name", (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("i"))
    cell = lambda df, row, col, rs, cs, text: df.select("doc_id", F.lit(1).alias("ord"), row.alias("row"), F.lit(col).alias("col"), rs.alias("row_span"), F.lit(cs).alias("col_span"), F.lit(90.0).alias("width"), text.alias("text"))
    title = cell(n.filter("i = 0"), F.lit(0), 0, F.lit(1), 2, F.lit("title & more"))
    left = cell(n.filter("i % 2 = 0"), F.col("i") + 1, 0, F.lit(2), 1, F.concat(F.lit("rows from "), "i"))
    last = n.groupBy("doc_id").agg(F.max("i").alias("last"))
    left = left.join(last, "doc_id").withColumn("row_span", F.when(F.col("row") - 1 < F.col("last"), 2).otherwise(1)).drop("last")
    right = cell(n, F.col("i") + 1, 1, F.lit(1), 1, F.col("n_name"))
    docs = n.select("doc_id").distinct()
    blocks = docs.withColumn("ord", F.explode(F.array(*map(F.lit, range(3))))).withColumn("tag", F.when(F.col("ord") == 1, "table").otherwise("p"))
    runs = blocks.filter("tag = 'p'").select("doc_id", "ord", F.lit(0).alias("run"), F.concat(F.lit("par "), "ord").alias("text"))
    return Document(blocks, runs, cells=title.unionByName(left).unionByName(right))


_TABLES_SQL = """
WITH n AS (SELECT n_regionkey::BIGINT AS doc_id, n_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS i, count(*) OVER (PARTITION BY n_regionkey) AS total FROM nation)
SELECT doc_id, 0 AS row, 0 AS col, 1 AS row_span, 2 AS col_span, 'title & more' AS text FROM n WHERE i = 0
UNION ALL SELECT doc_id, i + 1, 0, CASE WHEN i < total - 1 THEN 2 ELSE 1 END, 1, 'rows from ' || i FROM n WHERE i % 2 = 0
UNION ALL SELECT doc_id, i + 1, 1, 1, 1, n_name FROM n"""


def _table_roundtrip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    cells = through(_tabled(spark, sf), kind).cells
    return cells.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("row", "col", "row_span", "col_span")], "text")


@query(_TABLES_SQL)
def table_roundtrip_docx(spark, sf):
    return _table_roundtrip(spark, sf, "docx")


@query(_TABLES_SQL)
def table_roundtrip_odt(spark, sf):
    return _table_roundtrip(spark, sf, "odt")


@query(_TABLES_SQL)
def table_roundtrip_hwpx(spark, sf):
    return _table_roundtrip(spark, sf, "hwpx")


# ---- the IR


@query(_STYLED_SQL)
def ir_document_roundtrip(spark, sf):
    """Written as IR pages and read back."""
    from foliant.plans import document_ir

    runs = document_ir.read_pieces(document_ir.emit_pieces(_styled(spark, sf))).runs
    return runs.select("doc_id", "ord", "run", "text", "bold", "italic", "underline", "strike", "color", F.round(F.col("size") * 100).cast("int").alias("size"), "font", "position", "link")


@query(_LISTS_SQL)
def ir_list_roundtrip(spark, sf):
    from foliant.plans import document_ir

    back = document_ir.read_pieces(document_ir.emit_pieces(_listed(spark, sf)))
    texts = back.runs.groupBy("doc_id", "ord").agg(F.first("text").alias("text"))
    return back.blocks.join(texts, ["doc_id", "ord"]).select("doc_id", "ord", "tag", "text", "level", "ordered", "numbered")


_TO_IR_SQL = """
SELECT c_nationkey::BIGINT AS doc_id, 0::BIGINT AS violations, md5(string_agg(c_name, '|' ORDER BY c_custkey)) AS text_md5 FROM customer GROUP BY 1"""


def _package_to_ir(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Packages of lists and headings read to IR pages: these keep every rule, and the blocks' texts in order."""
    from foliant.plans import document_ir, ir
    from foliant.sources import markup

    pages = written(document_ir.to_pieces(written(sink.write(_listed(spark, sf), kind), "packages"), kind), "pages")
    bad = ir.validate(markup.piece_nodes(pages)).groupBy("doc_id").agg(F.count("*").alias("violations"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "|")
    back = document_ir.read_pieces(pages).runs.groupBy("doc_id").agg(F.md5(text.cast("binary")).alias("text_md5"))
    return back.join(bad, "doc_id", "left").select("doc_id", F.coalesce("violations", F.lit(0)).alias("violations"), "text_md5")


@query(_TO_IR_SQL)
def docx_to_ir(spark, sf):
    return _package_to_ir(spark, sf, "docx")


@query(_TO_IR_SQL)
def odt_to_ir(spark, sf):
    return _package_to_ir(spark, sf, "odt")


@query(_TO_IR_SQL)
def hwpx_to_ir(spark, sf):
    return _package_to_ir(spark, sf, "hwpx")
