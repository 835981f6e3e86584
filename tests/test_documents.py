"""Packages, markup, the IR and streams."""

import struct
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from foliant.plans import ir
from foliant.sinks import packages as sink
from foliant.sources import containers, document, markup, packages
from foliant.streaming import ingest, sessions

TEXTS = ["plain", "two\nlines  here ", " lead & <tag> \"q\"\n\n", "", "tab\there\u0001x", "한글 😀 text"]


@pytest.fixture(scope="module")
def blocks(spark):
    return ir.blocks_of_text(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


@pytest.mark.parametrize("kind", ["docx", "odt", "hwpx"])
def test_roundtrip(spark, blocks, kind):
    files = sink.write(blocks, kind)
    back = {}
    for r in packages.read_text(files, kind).orderBy("doc_id", "ord").collect():
        back.setdefault(r.doc_id, []).append(r.text)
    assert {k: "\n".join(v) for k, v in back.items()} == {k: t.replace("\x01", "") for k, t in enumerate(TEXTS)}
    content = bytes(files.first()["content"])
    first = zipfile.ZipFile(BytesIO(content)).infolist()[0]
    if kind != "docx":
        assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED
    assert files.transform(containers.with_format).select("format").distinct().collect()[0][0] == kind
    lost = sink.missing_text(blocks, packages.read_text(files, kind), ["doc_id"]).filter(F.size("missing") > 0)
    assert lost.count() == 0


def package(parts):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return bytearray(out.getvalue())


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOC = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="B"/></w:pPr><w:r><w:t>one</w:t></w:r><w:r><w:rPr><w:rStyle w:val="R"/><w:b w:val="0"/></w:rPr><w:t>two</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:color w:val="C00000"/><w:sz w:val="24"/><w:i/></w:rPr><w:t>red</w:t><w:br/><w:tab/><w:t>x</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl><w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>"""
STYLES = f'<w:styles {W}><w:style w:styleId="A"><w:rPr><w:sz w:val="28"/><w:b/></w:rPr></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:i/></w:rPr></w:style><w:style w:styleId="R"><w:rPr><w:u w:val="single"/></w:rPr></w:style></w:styles>'


def test_docx_formats(spark):
    files = spark.createDataFrame([(1, package({"word/document.xml": DOC, "word/styles.xml": STYLES}))], "doc_id long, content binary")
    doc = document.read_docx(files)
    runs = {r.text: r for r in doc.runs.collect()}
    assert (runs["one"].size, runs["one"].bold, runs["one"].italic) == (1400, True, True)  # inherited over two styles
    assert (runs["two"].bold, runs["two"].underline, runs["two"].size) == (False, True, 1400)
    assert (runs["red\n\tx"].color, runs["red\n\tx"].size, runs["red\n\tx"].italic, runs["red\n\tx"].bold) == ("#C00000", 1200, True, False)
    s = packages.docx_sections(files).first()
    assert (s.width, s.height, s.left) == (59530, 84190, 7200)
    cells = {(r.row, r.col): (r.row_span, r.col_span, r.text) for r in doc.cells.collect()}
    assert cells == {(0, 0): (1, 2, "wide"), (0, 2): (2, 1, "tall"), (1, 0): (1, 1, ""), (1, 1): (1, 1, "")}
    assert [r.text for r in packages.read_text(files, "docx").orderBy("ord").collect()][:2] == ["onetwo", "red\n\tx"]


def compound(streams):
    """A minimal compound file: every stream in the regular sectors."""
    size = 512
    body, entries, fat = b"", [], []
    names = list(streams)
    for n in names:
        data = streams[n].ljust(4096, b"\0")
        k = len(data) // size
        start = len(fat)
        fat += [*range(start + 1, start + k), 0xFFFFFFFE]
        body += data
        entries.append((n, start, len(data)))
    dir_at = len(fat)
    count = -(-(len(entries) + 1) // 4)
    fat += [*range(dir_at + 1, dir_at + count), 0xFFFFFFFE]
    fat_at = len(fat)
    fat += [0xFFFFFFFD]

    def node(name, kind, right, child, start, length):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", start, length)

    nodes = node("Root Entry", 5, 0xFFFFFFFF, 1, 0xFFFFFFFE, 0)
    for k, (n, start, length) in enumerate(entries):
        nodes += node(n, 2, k + 2 if k + 1 < len(entries) else 0xFFFFFFFF, 0xFFFFFFFF, start, length)
    body += nodes.ljust(count * size, b"\0") + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat)))
    head = containers.CFB_MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, 1, dir_at, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108)
    return bytearray(head + body)


def test_compound_files(spark):
    record = lambda tag, level, data: struct.pack("<I", tag | level << 10 | len(data) << 20) + data
    stream = record(66, 0, b"ab") + record(67, 1, b"c") + record(68, 2, b"") + record(67, 1, b"dd")
    files = spark.createDataFrame([(1, compound({"FileHeader": b"HWP", "Section0": stream})), (2, compound({"WordDocument": b"x"})), (3, bytearray(b"\0" * 64)), (4, bytearray(b"PK\x03\x04junk"))], "doc_id long, content binary")
    assert {r.doc_id: r.format for r in containers.with_format(files).collect()} == {1: "hwp", 2: "doc", 3: None, 4: None}
    found = containers.cfb_streams(files)
    assert {(r.doc_id, r.path) for r in found.filter("error is null").collect()} == {(1, "FileHeader"), (1, "Section0"), (2, "WordDocument")}
    records = containers.record_parents(containers.hwp_records(found.filter("path = 'Section0'"))).filter("tag > 0").orderBy("seq").collect()
    assert [(r.tag, r.level, r.parent) for r in records] == [(66, 0, None), (67, 1, 0), (68, 2, 1), (67, 1, 0)]
    assert containers.zip_entries(files.filter("doc_id = 4")).first()["error"]


def test_depth_limit(spark):
    deep = "<a>" * 2000 + "</a>" * 2000
    parts = spark.createDataFrame([(1, "x", bytearray(deep.encode())), (2, "x", bytearray(b"<a><b>")), (3, "x", bytearray(b"<a/>"))], "doc_id long, path string, data binary")
    errors = {r.doc_id: r.error for r in markup.xml_nodes(parts, []).filter("name = '#error'").collect()}
    assert "deeper" in errors[1] and 2 in errors and 3 not in errors


GOOD = '<doc-section data-ir="0.2.0"><h1 data-id="b1" data-num="outline">t</h1><p data-id="b2">x<a data-fn-ref="f1"></a></p><ul><li data-id="b3">i</li></ul><table data-id="b4"><tr><td><p data-id="b5">c</p></td></tr></table><doc-footer><p data-id="b6"><doc-field data-kind="page"></doc-field></p></doc-footer><doc-footnote data-id="b7" id="f1"><p data-id="b8">n</p></doc-footnote></doc-section>'
BAD = {
    "element-allowed": "<p data-id='b1'><font>x</font></p>",
    "attr-allowed": "<p data-id='b1' onclick='x'>x</p>",
    "style-allowed": "<p data-id='b1' style='color:red;zoom:2'>x</p>",
    "block-id": "<p>x</p>",
    "structure": "<div><tr></tr></div>",
    "link-target": "<p data-id='b1'><a href='javascript:x'>x</a></p>",
    "field-kind": "<doc-header><doc-field data-kind='z'></doc-field></doc-header>",
    "outline-scheme": "<h1 data-id='b1' data-num='3'>x</h1>",
    "eq-truth": "<doc-eq data-id='b1'></doc-eq>",
    "footnote-pair": "<p data-id='b1'><a data-fn-ref='f9'></a></p>",
}


def test_validate(spark):
    pages = spark.createDataFrame([(0, GOOD), *enumerate(BAD.values(), 1)], "page_id long, html string")
    got = {}
    for r in ir.validate(markup.html_nodes(pages)).collect():
        got.setdefault(r.doc_id, set()).add(r.rule)
    assert 0 not in got
    for k, rule in enumerate(BAD, 1):
        assert rule in got[k], (rule, got.get(k))
    twice = spark.createDataFrame([(1, "<p data-id='b1'>a</p><p data-id='b1'>b</p>")], "page_id long, html string")
    assert [r.message for r in ir.validate(markup.html_nodes(twice)).collect()] == ["data-id repeated: b1"]


def test_normalize(spark):
    pages = spark.createDataFrame([(1, "<div contenteditable='true'>a<b>c</b><font color='#c00000'>d</font></div><p data-id='b4' style='zoom:1;background-color:red'><a href='javascript:x'>l</a></p>")], "page_id long, html string")
    nodes = ir.normalize(markup.html_nodes(pages)).filter("name not like '#%'").orderBy("node_id").collect()
    assert [n.name for n in nodes] == ["p", "span", "span", "p", "a"]
    assert nodes[0].attrs == {"data-id": "b5"} and nodes[1].attrs == {"style": "font-weight:bold"} and nodes[2].attrs == {"style": "color:#c00000"}
    assert nodes[3].attrs["data-id"] == "b4" and "zoom" not in nodes[3].attrs["style"] and "background:" in nodes[3].attrs["style"]
    assert nodes[4].attrs == {}


def test_emit_reads_back(spark, blocks):
    html = ir.emit(blocks)
    assert ir.validate(markup.html_nodes(html, "doc_id")).count() == 0
    assert ir.standalone(F.lit("<doc-section></doc-section>")) is not None
    assert {r.doc_id: r.paragraphs for r in ir.stats(blocks).collect()} == {k: t.count("\n") + 1 for k, t in enumerate(TEXTS)}


def test_ingest(spark, blocks, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for r in sink.write(blocks, "odt").collect():
        (folder / f"{r.doc_id}.odt").write_bytes(bytes(r.content))
    (folder / "note.txt").write_text("hello")
    ingest.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"ok": len(TEXTS), "rejected": 1}


def test_mixed_files_hold_whole_texts(spark, tmp_path):
    from foliant.plans import queries

    texts = {k: f"{k} " + "word here\n" * 300 + "end" for k in range(5)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = ingest.status(queries._mixed_files(spark, str(tmp_path)).withColumn("path", F.lit("")))
    got = {r.doc_id: (r.status, r.paragraphs, r.chars) for r in found.collect()}
    assert got == {k: ("ok", 301, len(t.replace("\n", ""))) if k < 3 else ("rejected", None, None) for k, t in texts.items()}


def test_session_stream(spark, tmp_path):
    src = tmp_path / "ev"
    for k, (user, ts) in enumerate([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (1, "2024-01-02 01:00:00"), (2, "2024-01-05 00:00:00"), (3, "2024-01-09 00:00:00")]):
        spark.sql(f"select {user}L as user_id, timestamp '{ts}' as ts").coalesce(1).write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src)).withWatermark("ts", "1 hour")
    q = sessions.expire(stream).writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.uses) for r in spark.table("expired").collect()}
    assert (1, 2) in got


def test_registry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
