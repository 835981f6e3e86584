"""IR read-back, style tables of odt and hwpx, parts of packages, checks."""

from pyspark.sql import functions as F

from foliant.plans import tree, verify
from foliant.sinks import parts
from foliant.sinks import packages as sink
from foliant.sources import document, markup, styles
from tests.test_documents import package

PAGE = """<doc-section style="width:210mm;min-height:297mm;padding:20mm"><doc-header><p>head</p></doc-header><h1 data-num="outline">T</h1>
<ul><li>a<ol><li>b</li></ol></li><li>c</li></ul><ul><li>d</li></ul>
<table><tr><td colspan="2" style="width:50%;border:2pt dashed #C2352B;vertical-align:top">x<table><tr><td>in</td></tr></table></td><td style="border:none">y</td></tr></table>
<p style="color:#f00">r<span style="font-weight:bold">s<sup>2</sup></span></p><div data-ui="1"><b>tool</b></div></doc-section>"""


def nodes(spark, html=PAGE, **kw):
    return markup.html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"), **kw)


def test_tree(spark):
    n = nodes(spark)
    items = {r.text.split("b")[0]: r for r in tree.list_items(nodes(spark, blocks=["li"])).collect()}
    assert (items["a"].level, items["c"].level, items["d"].level) == (0, 0, 0)
    assert items["a"].instance == items["c"].instance != items["d"].instance
    nested = [r for r in tree.list_items(n).collect() if r.level == 1]
    assert len(nested) == 1 and nested[0].ordered
    cells = {r.text: r for r in tree.table_cells(n).collect()}
    assert set(cells) == {"x", "in", "y"} and cells["x"].col_span == 2 and cells["x"].width == 200 and cells["x"].valign == "top"
    assert cells["x"].border.style == "dashed" and cells["y"].border is None and cells["in"].border.width_pt == 0.75
    runs = {r.text: r for r in tree.inherited_styles(n).collect()}
    assert runs["2"].color == "#FF0000" and runs["2"].bold and runs["2"].sup and runs["r"].bold is None
    g = tree.geometry(n).first()
    assert (g.paper, g.landscape, list(g.margins_mm)) == ("a4", False, [20.0] * 4)
    assert tree.uses_outline(n).first().outline
    assert {r.band for r in tree.bands(n).collect()} == {"header"}
    assert tree.strip_ui(n).filter("name in ('b', 'div')").count() == 0
    pasted = tree.sanitize_paste(nodes(spark, "<style>x</style><div>a <b>b</b></div><p>c<a href='javascript:x'>d</a></p><script>1</script>")).first().html
    assert pasted == 'a <span style="font-weight:bold">b</span><br>c<a>d</a>'


def test_odt_styles(spark):
    ns = 'xmlns:s="s" xmlns:f="f" xmlns:t="t" xmlns:o="o"'
    content = f"""<o:c {ns}><s:style s:name="A" s:parent-style-name="B"><s:text-properties f:font-style="italic"/></s:style><s:style s:name="S"><s:text-properties f:color="#C00000" s:text-position="super 58%"/></s:style>
    <t:p t:style-name="A">one<t:span t:style-name="S">two</t:span></t:p></o:c>"""
    base = f'<o:c {ns}><s:style s:name="B"><s:text-properties f:font-weight="700" f:font-size="14pt"/><s:paragraph-properties f:text-align="center" f:margin-left="2cm"/></s:style></o:c>'
    files = spark.createDataFrame([(1, package({"content.xml": content, "styles.xml": base}))], "doc_id long, content binary")
    doc = document.read_odt(files)
    runs, block = {r.text: r for r in doc.runs.collect()}, doc.blocks.first()
    assert (runs["one"].size, runs["one"].bold, runs["one"].italic, block.align, block.left) == (1400, True, True, "center", 5669)
    assert (runs["two"].color, runs["two"].position, runs["two"].size, runs["one"].color) == ("#C00000", "super", 1400, "#000000")


def test_hwpx_shapes(spark):
    head = '<h:head xmlns:h="h"><h:charPr id="0" height="1000"/><h:charPr id="7" height="1600" textColor="#C00000"><h:bold/></h:charPr><h:paraPr id="3"><h:align horizontal="CENTER"/><h:switch><h:case><h:left value="1"/></h:case><h:default><h:left value="2000"/><h:intent value="-1500"/></h:default></h:switch></h:paraPr></h:head>'
    body = '<s:sec xmlns:s="s" xmlns:p="p"><p:p><p:run charPrIDRef="7"><p:t>big</p:t></p:run><p:run charPrIDRef="0"><p:t>small</p:t></p:run></p:p></s:sec>'
    files = spark.createDataFrame([(1, package({"Contents/header.xml": head, "Contents/section0.xml": body}))], "doc_id long, content binary")
    runs = {r.text: r for r in document.read_hwpx(files).runs.collect()}
    assert (runs["big"].size, runs["big"].bold, runs["big"].color, runs["small"].bold) == (1600, True, "#C00000", False)
    p = styles.hwpx_shapes(document.shred(files, "hwpx"))["para"].first()
    assert (p.align, p.left, p.first_line) == ("center", 2000, -1500)


def test_parts(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 2, 1, 50.0, None, "a"), (1, 0, 0, 1, 1, 1, 50.0, 40.0, "b"), (1, 0, 1, 1, 1, 1, 50.0, None, "c")], "doc_id long, table int, row int, col int, row_span int, col_span int, width double, height double, text string")
    xml = parts.docx_tables(cells).first().xml
    assert xml.count("<w:tr>") == 2 and xml.count("vMerge") == 2 and xml.count('w:val="restart"') == 1
    assert parts.odt_tables(cells).first().xml.count("covered-table-cell") == 1
    assert {r.r: r.height for r in parts.row_heights_pt(cells).collect()} == {0: 40.0, 1: 16.0}
    links = spark.createDataFrame([(1, "https://b"), (1, "https://a"), (1, "https://a"), (1, "#b7")], "doc_id long, href string")
    assert sorted((r.rid, r.href) for r in parts.docx_links(links).collect()) == [("rId100", "https://a"), ("rId101", "https://b")]
    lists = spark.createDataFrame([(1, 2, 0, True), (1, 1, 0, False), (1, 1, 1, False)], "doc_id long, list_id int, level int, ordered boolean")
    num = parts.docx_numbering(lists).first().xml
    assert num.index('abstractNumId="1"') < num.index('abstractNumId="2"') < num.index("<w:num ") and "•" in num and "%1." in num
    notes = parts.docx_footnotes(spark.createDataFrame([(1, 2, "z"), (1, 1, "y")], "doc_id long, n int, text string")).first().xml
    assert notes.index('w:id="-1"') < notes.index('w:id="1"') < notes.index('w:id="2"')
    ppr = spark.range(1).select(parts.docx_paragraph_properties(F.lit(4), F.lit(1), F.lit(12.0), F.lit(2), F.lit("center"), F.lit(20.0), F.lit(-10.0)).alias("x")).first().x
    assert ppr == '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="4"/></w:numPr><w:spacing w:line="336" w:lineRule="atLeast"/><w:jc w:val="center"/><w:ind w:left="400" w:hanging="200"/><w:outlineLvl w:val="1"/>'
    assert parts.outline_levels()[1] == (1, "ganada", "%2.")


def test_verify(spark):
    blocks = spark.createDataFrame([(1, 0, "p", "alpha beta"), (1, 1, "h2", "gamma")], "doc_id long, ord int, tag string, text string")
    files = sink.write(blocks, "odt")
    assert verify.mimetype_rule(files).first().ok and verify.broken_parts(files).count() == 0 and verify.lost_tokens(blocks, files).count() == 0
    assert not verify.mimetype_rule(sink.write(blocks, "docx")).first().ok
    other = blocks.withColumn("text", F.lit("delta"))
    assert {r.token for r in verify.lost_tokens(other, files).collect()} == {"delta"}
    a = spark.createDataFrame([(1, '<p data-id="b1">x</p>')], "doc_id long, html string")
    b = spark.createDataFrame([(1, '<p data-id="b9">y</p>')], "doc_id long, html string")
    assert verify.same_structure(a, b).first().same
    assert verify.kept_vocabulary(nodes(spark), nodes(spark, "<p>x</p>")).filter("name = 'h1'").first().before == 1
    flags = verify.style_flags(spark.createDataFrame([(1, True, False, False, "#C00000", 1200)], "doc_id long, bold boolean, italic boolean, underline boolean, color string, size int")).first()
    assert (flags.any_bold, flags.any_italic, flags.any_red, flags.any_big) == (True, False, True, False)
