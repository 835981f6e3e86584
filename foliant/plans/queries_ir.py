"""Registered queries of IR pages: bands, outline, geometry, cleaning, comparison, and package invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans import ir, tree, verify
from foliant.plans.queries import query
from foliant.session import table
from foliant.sources import markup


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _pages(spark: SparkSession, sf: str, html: Column) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), html.alias("html"))


@query("""
SELECT n_nationkey::BIGINT AS doc_id, 'header' AS band, 'head ' || n_name AS text FROM nation UNION ALL SELECT n_nationkey, 'footer', 'foot ' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0""")
def ir_bands(spark, sf):
    """Headers and footers, without those that pages repeat."""
    foot = F.when(F.col("n_nationkey") % 2 == 0, _cat("<doc-footer><p>foot ", F.col("n_nationkey"), "</p></doc-footer>")).otherwise("")
    html = _cat('<doc-section><doc-header id="h1"><p>head ', F.col("n_name"), "</p></doc-header><p>body</p>", foot, '</doc-section><doc-section data-pg="2"><doc-header data-pg="2"><p>head again</p></doc-header><p>more</p></doc-section>')
    nodes = markup.html_nodes(_pages(spark, sf, html), "doc_id")
    texts = nodes.filter("name = '#text'").select("doc_id", "node_id", "text")
    return tree.bands(nodes).filter("name = '#text'").join(texts, ["doc_id", "node_id"]).select("doc_id", "band", "text")


@query("""
SELECT n_nationkey::BIGINT AS doc_id, n_nationkey % 3 = 0 AS outline, md5('<!DOCTYPE html><html><head><meta charset="utf-8"><style>:root{--pages:' || (n_nationkey % 2 + 1) || '}doc-section{display:block}</style></head><body>' || h || '</body></html>') AS page_md5
FROM (SELECT n_nationkey, repeat('<doc-section>' || CASE WHEN n_nationkey % 3 = 0 THEN '<table><tr><td><h2 data-num="outline">' ELSE '<table><tr><td><h2>' END || n_name || '</h2></td></tr></table></doc-section>', n_nationkey % 2 + 1) AS h FROM nation)""")
def ir_standalone(spark, sf):
    """Whether a document uses the outline, also inside cells, and the page around its sections."""
    head = F.when(F.col("n_nationkey") % 3 == 0, '<h2 data-num="outline">').otherwise("<h2>")
    pages = _pages(spark, sf, F.repeat(_cat("<doc-section><table><tr><td>", head, F.col("n_name"), "</h2></td></tr></table></doc-section>"), (F.col("n_nationkey") % 2 + 1).cast("int")))
    used = tree.uses_outline(markup.html_nodes(pages, "doc_id"))
    return pages.join(used, "doc_id").select("doc_id", "outline", F.md5(ir.standalone(F.col("html")).cast("binary")).alias("page_md5"))


@query("""
WITH g AS (SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 210.0 WHEN 1 THEN 257.0 ELSE 100.0 END AS w, CASE n_nationkey % 3 WHEN 0 THEN 297.0 WHEN 1 THEN 182.0 ELSE 100.0 END AS h FROM nation)
SELECT k::BIGINT AS doc_id, w::DOUBLE AS width_mm, h::DOUBLE AS height_mm, CASE k % 3 WHEN 0 THEN 'a4' WHEN 1 THEN 'b5' END AS paper, w > h AS landscape, (k % 5)::DOUBLE AS top_mm, 20.0::DOUBLE AS right_mm FROM g""")
def ir_geometry(spark, sf):
    k = F.col("n_nationkey")
    size = F.when(k % 3 == 0, "width:210mm;min-height:297mm").when(k % 3 == 1, "width:257mm;min-height:182mm").otherwise("width:10cm;min-height:100mm")
    nodes = markup.html_nodes(_pages(spark, sf, _cat('<doc-section style="', size, ";padding:", k % 5, 'mm 20mm"><p>x</p></doc-section>')), "doc_id")
    return tree.geometry(nodes).select("doc_id", "width_mm", "height_mm", "paper", "landscape", F.col("margins_mm")[0].alias("top_mm"), F.col("margins_mm")[1].alias("right_mm"))


@query("""
SELECT n_nationkey::BIGINT AS doc_id, 'keep ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' too' ELSE '' END AS text FROM nation""")
def ir_without_ui(spark, sf):
    """Editor nodes go with all inside them, however deep."""
    inner = F.when(F.col("n_nationkey") % 2 == 0, "<p> too</p>").otherwise('<div data-ui="x"><p> not<b><i> this</i></b></p></div>')
    nodes = markup.html_nodes(_pages(spark, sf, _cat('<div data-ui="bar">menu<span>more</span></div><p>keep ', F.col("n_name"), "</p>", inner)), "doc_id")
    left = tree.strip_ui(nodes).filter("name = '#text'")
    return left.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "").alias("text"))


@query("""
SELECT n_nationkey::BIGINT AS doc_id, 'one ' || n_name || '<br><span style="font-weight:bold">two</span><a href="https://x.org/' || n_nationkey || '">three</a><br>four' AS html FROM nation""")
def ir_pasted(spark, sf):
    """Pasted pages as the inline vocabulary: styles and scripts gone, blocks as line breaks, safe links kept."""
    html = _cat("<style>p{}</style><p>one ", F.col("n_name"), '</p><p><b>two</b><a href="https://x.org/', F.col("n_nationkey"), '">three</a></p><script>x()</script><p>four</p>')
    return tree.sanitize_paste(markup.html_nodes(_pages(spark, sf, html), "doc_id"))


@query("""SELECT n_nationkey::BIGINT AS doc_id, 250 + n_nationkey > 256 AS too_deep, least(250 + n_nationkey, 257)::BIGINT AS elements FROM nation""")
def depth_guard(spark, sf):
    """Parts that nest deeper than the guard end in a row with an error, and do not fail the query."""
    depth = (F.col("n_nationkey") + 250).cast("int")
    parts = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit("a.xml").alias("path"), _cat(F.repeat(F.lit("<a>"), depth), F.repeat(F.lit("</a>"), depth)).cast("binary").alias("data"))
    nodes = markup.xml_nodes(parts, [])
    return nodes.groupBy("doc_id").agg(F.bool_or(F.col("name") == "#error").alias("too_deep"), F.count_if(F.col("name") == "a").alias("elements"))


@query("""
SELECT n_nationkey::BIGINT AS doc_id, n_nationkey % 4 <> 0 AS same, CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS changed FROM nation""")
def structure_compared(spark, sf):
    """Two readings of a document: equal but for ids, styles and texts; and the elements whose number changed."""
    k = F.col("n_nationkey")
    a = _pages(spark, sf, _cat('<p data-id="b1" style="color:red">', F.col("n_name"), "</p><ul><li>x</li></ul>"))
    b = _pages(spark, sf, _cat('<p data-id="b', k, '">other</p><ul><li>y</li>', F.when(k % 4 == 0, "<li>z</li>").otherwise(""), "</ul>"))
    kept = verify.kept_vocabulary(markup.html_nodes(a, "doc_id"), markup.html_nodes(b, "doc_id")).groupBy("doc_id").agg(F.count("*").alias("changed"))
    return verify.same_structure(a, b).join(kept, "doc_id", "left").select("doc_id", "same", F.coalesce("changed", F.lit(0)).alias("changed"))


@query("""
SELECT n_nationkey::BIGINT AS doc_id, 'cell without a paragraph' AS rule, 1::BIGINT AS n FROM nation WHERE n_nationkey % 2 = 1
UNION ALL SELECT n_nationkey, 'list without a definition', 1 FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_nationkey, 'link without a relationship', 2 FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT n_nationkey, 'rows of different widths', 1 FROM nation WHERE n_nationkey % 7 = 0""")
def package_invariants(spark, sf):
    """Documents with faults of four kinds."""
    from foliant.sinks import packages

    k = F.col("n_nationkey")
    cell = F.when(k % 2 == 1, "<w:tc/>").otherwise("<w:tc><w:p/></w:tc>")
    wide = F.when(k % 7 == 0, "<w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr>").otherwise('<w:tr><w:tc><w:tcPr><w:gridSpan w:val="1"/></w:tcPr><w:p/></w:tc></w:tr>')
    number = F.when(k % 3 == 0, '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr></w:pPr></w:p>').otherwise("")
    link = F.when(k % 5 == 0, '<w:p><w:hyperlink r:id="rId7"/><w:hyperlink r:id="rId8"/><w:hyperlink w:anchor="b1"/></w:p>').otherwise("")
    bodies = table(spark, sf, "nation").select(k.cast("long").alias("doc_id"), _cat("<w:tbl><w:tr>", cell, "</w:tr>", wide, "</w:tbl>", number, link).alias("xml"))
    return verify.docx_invariants(packages.package_body(bodies, "docx"))


@query("""
SELECT n_regionkey::BIGINT AS doc_id, '[' || string_agg('{"ord":' || i || ',"tag":"p","text":"' || n_name || '"}', ',' ORDER BY i) || ']' AS json FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY 1""")
def model_json(spark, sf):
    """A document's blocks as JSON, in order."""
    from pyspark.sql import Window as W

    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("ord"), F.lit("p").alias("tag"), F.col("n_name").alias("text"))
    return ir.as_json(n)
