"""Whole documents written and read back in every format."""

import pytest

from foliant.sinks import document as sink
from foliant.sinks.document import Document
from foliant.sources import document as source


@pytest.mark.parametrize("kind", ["docx", "odt", "hwpx"])
def test_document(spark, kind):
    rows = [(1, 0, "h2", None, None, None), (1, 1, "li", 1, 0, True), (1, 2, "li", 1, 2, True), (1, 3, "li", 1, 1, True), (1, 4, "p", None, None, None), (1, 5, "li", 2, 1, False), (1, 6, "table", None, None, None), (1, 7, "p", None, None, None), (2, 0, "p", None, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id long, ord int, tag string, list_id int, level int, ordered boolean")
    runs = [(1, k, 0, f"t{k} <&> \x0b\"é", None, k == 4) for k in (0, 1, 2, 3, 4, 5)] + [(1, 4, 1, "", 7, False), (1, 4, 2, " end", None, False)]
    runs = spark.createDataFrame(runs, "doc_id long, ord int, run int, text string, note int, bold boolean")
    cells = spark.createDataFrame([(1, 6, 0, 0, 2, 1, 80.0, "a&b"), (1, 6, 0, 1, 1, 1, 80.0, ""), (1, 6, 1, 1, 1, 1, 80.0, "c")], "doc_id long, ord int, row int, col int, row_span int, col_span int, width double, text string")
    notes = spark.createDataFrame([(1, 7, "the <note>")], "doc_id long, note int, text string")
    back = source.read(sink.write(Document(blocks, runs, cells, notes), kind), kind)
    got = [(r.doc_id, r.tag, r.level, r.ordered, r.text) for r in back.blocks.filter("inside is null and tag <> 'table'").orderBy("doc_id", "ord").collect()]
    said = lambda k: f"t{k} <&> \"é"
    want = [(1, "h2", None, None, said(0)), (1, "li", 0, True, said(1)), (1, "li", 2, True, said(2)), (1, "li", 1, True, said(3)), (1, "p", None, None, said(4) + " end"), (1, "li", 1, False, said(5)), (1, "p", None, None, ""), (2, "p", None, None, "")]
    assert got == want
    held = [(r.ord, r.tag, r.text) for r in back.blocks.filter("inside is not null or tag = 'table'").orderBy("ord").collect()]
    assert held == [(6, "table", ""), (7, "p", "a&b"), (8, "p", ""), (9, "p", "c")]  # what cells hold are blocks as well
    assert [(r.note, r.text) for r in back.notes.collect()] == [(7, "the <note>")]
    assert sorted((r.row, r.col, r.row_span, r.col_span, r.text) for r in back.cells.collect()) == [(0, 0, 2, 1, "a&b"), (0, 1, 1, 1, ""), (1, 1, 1, 1, "c")]
    four = [(r.text, r.bold, r.note) for r in back.runs.filter("doc_id = 1 and ord = 4").orderBy("run").collect()]
    assert four == [(said(4), True, None), ("", four[1][1], 7), (" end", False, None)]


def test_ir_of_mixed_lists_and_tables(spark):
    from foliant.plans import document_ir

    levels = [(0, False), (1, True), (2, False), (1, True), (0, False), (3, True), (1, False)]
    rows = [(1, k, "li", 1, level, ordered) for k, (level, ordered) in enumerate(levels)] + [(1, 7, "table", None, None, None), (1, 8, "p", None, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id long, ord int, tag string, list_id int, level int, ordered boolean")
    runs = spark.createDataFrame([(1, k, 0, f"t{k} <&>", None) for k in (*range(7), 8)] + [(1, 8, 1, "", 3)], "doc_id long, ord int, run int, text string, note int")
    cells = spark.createDataFrame([(1, 7, 0, 0, 2, 1, 80.0, "a&b"), (1, 7, 0, 1, 1, 1, 80.0, ""), (1, 7, 1, 1, 1, 1, 80.0, "c")], "doc_id long, ord int, row int, col int, row_span int, col_span int, width double, text string")
    pages = document_ir.emit_document(Document(blocks, runs, cells, spark.createDataFrame([(1, 3, "body")], "doc_id long, note int, text string")))
    html = pages.first()["html"]
    assert html.count("<ol>") == html.count("</ol>") and html.count("<ul>") == html.count("</ul>")
    back = document_ir.read_ir(pages)
    got = [(r.level, r.ordered) for r in back.blocks.filter("tag = 'li' ").orderBy("ord").collect()]
    # the jump from level 0 to 3 opens two empty items on the way
    assert got == [(0, False), (1, True), (2, False), (1, True), (0, False), (1, True), (2, True), (3, True), (1, True)]
    assert sorted((r.row, r.col, r.row_span, r.col_span, r.text) for r in back.cells.collect()) == [(0, 0, 2, 1, "a&b"), (0, 1, 1, 1, ""), (1, 1, 1, 1, "c")]
    assert [(r.note, r.text) for r in back.notes.collect()] == [(3, "body")]


def nested():
    """A table whose first cell holds a heading, a list and a table of one cell with two styled runs; a picture in another cell."""
    blocks = [(1, 0, "p", None, None, None, None), (1, 1, "table", None, None, None, None), (1, 2, "h2", None, None, None, 10), (1, 3, "li", 1, 0, True, 10), (1, 4, "li", 1, 1, True, 10), (1, 5, "table", None, None, None, 10), (1, 6, "p", None, None, None, 30), (1, 7, "table", None, None, None, 30), (1, 8, "p", None, None, None, 40), (1, 9, "p", None, None, None, 20), (1, 10, "p", None, None, None, None)]
    runs = [(1, 0, 0, "before", None, None), (1, 2, 0, "head", True, None), (1, 3, 0, "one", None, None), (1, 4, 0, "one.one", None, None), (1, 6, 0, "in ", True, None), (1, 6, 1, "the inner", False, None), (1, 8, 0, "deepest", None, None), (1, 9, 0, "", None, "a.png"), (1, 9, 1, " and text", None, None), (1, 9, 2, "", None, "b.png"), (1, 10, 0, "after", None, None), (1, 10, 1, "", None, "same-as-a.png")]
    cells = [(1, 1, 0, 0, 1, 1, 90.0, "", 10), (1, 1, 0, 1, 1, 1, 90.0, "", 20), (1, 5, 0, 0, 1, 1, 60.0, "", 30), (1, 7, 0, 0, 1, 1, 40.0, "", 40)]
    images = [(1, "a.png", "png", b"bytes of a"), (1, "b.png", "PNG", b"bytes of b"), (1, "same-as-a.png", "png", b"bytes of a"), (1, "unused.png", "png", b"nobody shows me")]
    return blocks, runs, cells, images


@pytest.mark.parametrize("kind", ["docx", "odt", "hwpx"])
def test_nested_tables_and_pictures(spark, kind):
    blocks, runs, cells, images = nested()
    doc = Document(
        spark.createDataFrame(blocks, "doc_id long, ord int, tag string, list_id int, level int, ordered boolean, inside int"),
        spark.createDataFrame(runs, "doc_id long, ord int, run int, text string, bold boolean, picture string").selectExpr("*", "72.0D AS pic_width", "36.0D AS pic_height"),
        spark.createDataFrame(cells, "doc_id long, ord int, row int, col int, row_span int, col_span int, width double, text string, cell int"),
        images=spark.createDataFrame(images, "doc_id long, image string, ext string, data binary"),
    )
    back = source.read(sink.write(doc, kind), kind)
    got = [(r.ord, r.tag, r.level, r.inside is not None, r.text) for r in back.blocks.orderBy("ord").collect()]
    texts = {0: "before", 2: "head", 3: "one", 4: "one.one", 6: "in the inner", 8: "deepest", 9: " and text", 10: "after"}
    assert got == [(b[1], b[2], b[4], b[6] is not None, texts.get(b[1], "")) for b in blocks]
    cell_of = {r.ord: r.inside for r in back.blocks.collect()}
    assert cell_of[2] == cell_of[3] == cell_of[4] == cell_of[5] and cell_of[6] == cell_of[7] and len({cell_of[k] for k in (2, 6, 8, 9)}) == 4
    table_of = {r.cell: (r.ord, r.row, r.col, r.text) for r in back.cells.collect()}
    assert table_of[cell_of[2]] == (1, 0, 0, "head\none\none.one") and table_of[cell_of[9]] == (1, 0, 1, " and text") and table_of[cell_of[6]] == (5, 0, 0, "in the inner") and table_of[cell_of[8]] == (7, 0, 0, "deepest")
    assert [(r.text, r.bold) for r in back.runs.filter("ord = 6").orderBy("run").collect()] == [("in ", True), ("the inner", False)]
    data = {r.image: bytes(r.data) for r in back.images.collect()}
    assert sorted(data.values()) == [b"bytes of a", b"bytes of b"]  # equal ones once, unused ones not at all
    shown = [(r.ord, data[r.picture], round(r.pic_width), round(r.pic_height)) for r in back.runs.filter("picture is not null").orderBy("ord", "run").collect()]
    assert shown == [(9, b"bytes of a", 7200, 3600), (9, b"bytes of b", 7200, 3600), (10, b"bytes of a", 7200, 3600)]
    assert source.orphan_images(back).count() == 0


def test_nested_tables_in_the_ir(spark):
    from foliant.plans import document_ir

    blocks, runs, cells, _ = nested()
    doc = Document(
        spark.createDataFrame(blocks, "doc_id long, ord int, tag string, list_id int, level int, ordered boolean, inside int"),
        spark.createDataFrame([r[:5] for r in runs], "doc_id long, ord int, run int, text string, bold boolean"),
        spark.createDataFrame(cells, "doc_id long, ord int, row int, col int, row_span int, col_span int, width double, text string, cell int"),
    )
    back = document_ir.read_ir(document_ir.emit_document(doc))
    got = [(r.ord, r.tag, r.level, r.inside is not None) for r in back.blocks.orderBy("ord").collect()]
    assert got == [(b[1], b[2], b[4], b[6] is not None) for b in blocks]
    inside = {r.ord: r.inside for r in back.blocks.collect()}
    place = {r.cell: (r.ord, r.row, r.col) for r in back.cells.collect()}
    assert [place[inside[k]] for k in (2, 4, 5, 6, 7, 8, 9)] == [(1, 0, 0)] * 3 + [(5, 0, 0)] * 2 + [(7, 0, 0), (1, 0, 1)]
    assert [(r.text, r.bold) for r in back.runs.filter("ord = 6").orderBy("run").collect()] == [("in ", True), ("the inner", False)]


def test_text_between_blocks_is_a_paragraph(spark):
    from foliant.plans import document_ir

    html = "<doc-section>loose <b>one</b><p>in p</p> <!-- --> \n<div>deep<div><span><i>deeper</i></span> still<br></div></div><table><tr><td>cell <b>text</b><ul><li>item</li></ul>rest</td><td> </td></tr></table>end<img src='x'></doc-section>"
    doc = document_ir.read_ir(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    texts = {r.ord: r.text for r in doc.runs.groupBy("ord").agg({"text": "max"}).withColumnRenamed("max(text)", "text").collect()}
    joined = {}
    for r in doc.runs.orderBy("ord", "run").collect():
        joined[r.ord] = joined.get(r.ord, "") + r.text
    got = [(r.tag, joined.get(r.ord, "").strip(), r.inside is not None) for r in doc.blocks.orderBy("ord").collect()]
    assert got == [("p", "loose one", False), ("p", "in p", False), ("p", "deep", False), ("p", "deeper still", False), ("table", "", False), ("p", "cell text", True), ("li", "item", True), ("p", "rest", True), ("p", "end", False)] and texts


@pytest.mark.parametrize("kind", ["docx", "odt", "hwpx"])
def test_cell_formats(spark, kind):
    """Two cells side by side name their common edge each for itself: the wider border is drawn, an absent one loses."""
    line = lambda style, mm, tint: {"style": style, "width": mm / 25.4 * 72, "color": tint}
    none = {"style": "none", "width": 0.0, "color": None}
    rows = [
        (1, 1, 0, 0, 1, 1, "a", line("solid", 0.5, "#112233"), line("dashed", 0.5, "#000000"), line("double", 1.0, "#445566"), none, 4.0, 1.0, 2.0, 3.0, "#FFEECC", "top"),
        (1, 1, 0, 1, 1, 1, "b", line("dotted", 0.5, "#FF0000"), line("solid", 0.5, "#000000"), none, line("solid", 0.5, "#00FF00"), None, None, None, None, None, "middle"),
        (1, 1, 1, 0, 1, 2, "c", none, none, none, none, None, None, None, None, None, "bottom"),
    ]
    border = "struct<style:string,width:double,color:string>"
    cells = spark.createDataFrame(rows, f"doc_id long, ord int, row int, col int, row_span int, col_span int, text string, b_left {border}, b_top {border}, b_right {border}, b_bottom {border}, p_left double, p_top double, p_right double, p_bottom double, background string, valign string")
    blocks = spark.createDataFrame([(1, 0, "p"), (1, 1, "table"), (1, 2, "p")], "doc_id long, ord int, tag string")
    runs = spark.createDataFrame([(1, 0, 0, "x")], "doc_id long, ord int, run int, text string")
    back = source.read(sink.write(Document(blocks, runs, cells), kind), kind)
    got = {r.text: r for r in back.cells.collect()}
    side = lambda r, s: (r[f"b_{s}"].style, round(r[f"b_{s}"].width * 25.4 / 72, 1), r[f"b_{s}"].color if r[f"b_{s}"].style != "none" else None)
    assert [side(got["a"], s) for s in ("left", "top", "right", "bottom")] == [("solid", 0.5, "#112233"), ("dashed", 0.5, "#000000"), ("double", 1.0, "#445566"), ("none", 0.0, None)]
    assert [side(got["b"], s) for s in ("left", "top", "right", "bottom")] == [("double", 1.0, "#445566"), ("solid", 0.5, "#000000"), ("none", 0.0, None), ("solid", 0.5, "#00FF00")]
    assert side(got["c"], "top")[0] == "none"  # its first edge is the one below a
    assert [got["a"][f"p_{s}"] for s in ("left", "top", "right", "bottom")] == [400, 100, 200, 300]
    assert (got["a"].background, got["b"].background) == ("#FFEECC", None)
    assert [got[t].valign for t in "abc"] == ["top", "middle", "bottom"]


def test_ids_in_the_order_of_ends(spark):
    """Nested content has smaller ids, a note comes before its block, bands before the body, and a table's carrier has a number."""
    import re

    from foliant.plans import document_ir

    blocks = [(1, 0, "p", None, None), (1, 1, "table", None, None), (1, 2, "p", 10, None), (1, 3, "table", 10, None), (1, 4, "p", 30, None), (1, 5, "p", None, None), (1, 6, "p", None, "header"), (1, 7, "p", None, "footer"), (1, 8, "table", None, None)]
    runs = [(1, 0, 0, "a", None), (1, 2, 0, "b", None), (1, 4, 0, "c", None), (1, 5, 0, "d", None), (1, 5, 1, "", 7), (1, 6, 0, "head", None), (1, 7, 0, "  ", None)]
    cells = [(1, 1, 0, 0, 1, 1, "", 10), (1, 3, 0, 0, 1, 1, "", 30), (1, 8, 0, 0, 1, 1, "e", None), (1, 8, 0, 1, 1, 1, "f", None)]
    doc = Document(
        spark.createDataFrame(blocks, "doc_id long, ord int, tag string, inside int, band string"),
        spark.createDataFrame(runs, "doc_id long, ord int, run int, text string, note int"),
        spark.createDataFrame(cells, "doc_id long, ord int, row int, col int, row_span int, col_span int, text string, cell int"),
        spark.createDataFrame([(1, 7, "n")], "doc_id long, note int, text string"),
    )
    html = document_ir.emit_document(doc).first().html
    got = [(name, int(k)) for name, k in re.findall(r'<([a-z-]+)[^>]* data-id="b(\d+)"', html)]
    # header 1, (footer 2 is empty and left out), a 3, b 4, c 5, inner table 6 (7 its carrier), outer 8 (9), note 10, d 11, e 12, f 13, table 14
    assert got == [("p", 1), ("p", 3), ("table", 8), ("p", 4), ("table", 6), ("p", 5), ("p", 11), ("table", 14), ("p", 12), ("p", 13), ("doc-footnote", 10)]
    assert "<doc-footer>" not in html and "<doc-header>" in html
