"""What once ended at a number: sections, anchors, list levels, style chains, outline and nesting levels."""

import io
import re
import zipfile

from pyspark.sql import functions as F

from foliant.operators import numbering, ordered
from foliant.plans import document_ir
from foliant.sinks import document as sink
from foliant.sinks import packages as packed
from foliant.sources import document as source
from foliant.sources import packages
from foliant.streaming import ingest


def hwpx_of_sections(n):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, text in packed.HWPX.items():
            z.writestr(path, text)
        for k in range(n):
            z.writestr(f"Contents/section{k}.xml", f'<hs:sec {packed.HP_NS}><hp:p paraPrIDRef="0"><hp:run charPrIDRef="0"><hp:t>part {k}</hp:t></hp:run></hp:p></hs:sec>')
    return out.getvalue()


def test_all_sections_are_read_in_their_order(spark):
    files = spark.createDataFrame([(1, hwpx_of_sections(12))], "doc_id long, content binary")
    want = [f"part {k}" for k in range(12)]
    assert [r.text for r in packages.read_text(files, "hwpx").orderBy("ord").collect()] == want
    assert [r.text for r in source.read_hwpx(files).blocks.orderBy("ord").collect()] == want
    status = ingest.status(files.withColumn("path", F.lit("a.hwpx"))).first()
    assert status.status == "ok" and status.chars == sum(map(len, want))


def test_long_anchors_keep_their_length(spark):
    anchor = "#" + "b" * 12_000
    blocks = spark.createDataFrame([(1, 0, "p")], "doc_id long, ord int, tag string")
    runs = spark.createDataFrame([(1, 0, 0, "x", anchor)], "doc_id long, ord int, run int, text string, link string")
    assert source.read_docx(sink.write(sink.Document(blocks, runs), "docx")).runs.first().link == anchor


def test_lists_of_any_depth_close_what_they_opened(spark):
    rows = [(1, k, "li", k, k % 3 == 0) for k in range(25)] + [(1, 25, "li", 3, True), (1, 26, "p", None, None), (1, 27, "li", 2, False)]
    blocks = spark.createDataFrame(rows, "doc_id long, ord int, tag string, level int, ordered boolean")
    runs = blocks.select("doc_id", "ord", F.lit(0).alias("run"), F.concat(F.lit("t"), "ord").alias("text"))
    html = document_ir.emit_document(sink.Document(blocks, runs)).first().html
    open_tags = []
    for end, name in re.findall(r"<(/?)(ol|ul|li)\b", html):
        if end:
            assert open_tags.pop() == name
        else:
            open_tags.append(name)
    assert open_tags == []
    doc = document_ir.read_ir(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    back = doc.runs.join(doc.blocks.filter("tag = 'li'"), ["doc_id", "ord"])
    assert {r.text: r.level for r in back.collect()} == {f"t{r[1]}": r[3] for r in rows if r[2] == "li"}


def test_style_chains_of_any_length_and_cycles(spark):
    chain = [(1, f"s{k}", f"s{k - 1}" if k else None, 7 if k == 0 else None) for k in range(70)]
    cycle = [(2, "a", "b", None), (2, "b", "c", 5), (2, "c", "a", None), (3, "x", "gone", None)]
    styles = spark.createDataFrame(chain + cycle, "doc long, style string, parent string, size int")
    got = {(r.doc, r.style): r["size"] for r in ordered.inherit(styles, ["size"], ["doc"]).collect()}
    assert all(got[1, f"s{k}"] == 7 for k in range(70))
    assert got[2, "a"] == got[2, "b"] == got[2, "c"] == 5 and got[3, "x"] is None


def test_numbers_at_any_level(spark):
    levels = [1, 8, 8, 12, 8, 2, 8, 1, 12]
    items = spark.createDataFrame([(1, k, x) for k, x in enumerate(levels)], "doc long, at int, level int")
    parents, counts = [], []
    for k, x in enumerate(levels):
        above = max((j for j in range(k) if levels[j] < x), default=None)
        parents.append(above)
        counts.append(sum(levels[j] == x for j in range(0 if above is None else above, k + 1)))
    assert [r.parent for r in numbering.list_nesting(items, ["doc"], "at").orderBy("at").collect()] == parents
    assert [r.n for r in numbering.outline_numbers(items, ["doc"], "at").orderBy("at").collect()] == counts
