"""Documents whose size grows: parts are parsed and packed by pieces, and lists may have any number."""

import io
import zipfile

import pytest

from foliant.sinks import document as sink
from foliant.sinks import packages
from foliant.sinks.document import Document
from foliant.sources import document as source
from foliant.sources import markup


def test_nodes_leave_as_they_end():
    data = b"<r>" + b"<p a='1'>text</p>" * 50_000 + b"</r>"
    pieces = (data[at : at + markup.PIECE] for at in range(0, len(data), markup.PIECE))
    sizes = [len(some) for some in markup.xml_stream(1, "x", pieces, frozenset(["p"]))]
    assert sum(sizes) == 100_001 and max(sizes) < 20_000
    assert max(len(f) for f in markup._frames(iter([[["", "", k, None, 0, "p", None, None, None, "", None, None, k, k, None, None] for k in range(50_000)]]))) == markup.FRAME_ROWS


def test_pieces_make_the_package_of_whole_parts():
    fixed = {"mimetype": "m", "b.xml": "fixed", "d.xml": "last"}
    z = packages.Zip(fixed)
    for path, piece in (("a.xml", "<a>"), ("a.xml", "</a>"), ("b.xml", "own"), ("c.png", b"\x00\x01")):
        z.put(path, piece)
    content = z.content()
    assert content == packages.zipped({**fixed, "a.xml": "<a></a>", "b.xml": "own", "c.png": b"\x00\x01"})
    assert zipfile.ZipFile(io.BytesIO(content)).namelist() == ["mimetype", "a.xml", "b.xml", "c.png", "d.xml"]


@pytest.mark.parametrize("kind", ["docx"])
def test_lists_beside_the_number_of_the_outline(spark, kind):
    rows = [(1, 0, "h1", None, None, True)] + [(1, k, "li", 898 + k, 0, None) for k in range(1, 5)]
    blocks = spark.createDataFrame(rows, "doc_id long, ord int, tag string, list_id int, level int, numbered boolean").selectExpr("*", "list_id % 2 = 0 as ordered")
    runs = spark.createDataFrame([(1, k, 0, f"t{k}") for k in range(5)], "doc_id long, ord int, run int, text string")
    back = source.read(sink.write(Document(blocks, runs), kind), kind).blocks.orderBy("ord").collect()
    assert [(r.ord, r.tag, r.ordered, r.numbered) for r in back] == [(0, "h1", None, True), (1, "li", False, False), (2, "li", True, False), (3, "li", False, False), (4, "li", True, False)]


def test_fields_are_stretches(spark):
    from foliant.operators import streams

    docs = spark.createDataFrame([(1, "ab\x13 LINK \x13x\x14y\x15 \x14é and\x15\r\rend"), (2, "")], "doc_id long, text string")
    rows = streams.stretches(docs, "text")
    assert rows.count() == 15
    shown = streams.paragraphs(streams.hide_field_codes(rows, ["doc_id"]), ["doc_id"]).orderBy("par").collect()
    assert [(r.par, r.text) for r in shown] == [(0, "abé and"), (1, ""), (2, "end")]


def test_styles_are_inherited_without_pairs(spark):
    from foliant.plans import tree

    html = '<p style="color:#00ff00;font-size:10pt">' + "<span>" * 9 + '<span style="font-size:12pt">x</span>' + "</span>" * 9 + "y</p>z"
    nodes = markup.html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    styled = tree.inherited_styles(nodes)
    assert [(r.text, r.size_pt, r.color) for r in styled.orderBy("node_id").collect()] == [("x", 12.0, "#00FF00"), ("y", 10.0, "#00FF00")]
    assert "_top" not in styled._jdf.queryExecution().toString() and "distance" not in styled._jdf.queryExecution().toString()


def test_one_outline_in_ranges(spark):
    from foliant.operators import numbering

    levels = [1, 2, 3, 3, 2, 3, 1, 3, 2, 3, 3, 1] * 40
    rows = [(k, level) for k, level in enumerate(levels)]
    heads = spark.createDataFrame(rows, "at int, level int")
    counts, want = {}, []
    for level in levels:
        counts = {x: n for x, n in counts.items() if x <= level}
        counts[level] = counts.get(level, 0) + 1
        want.append(counts[level])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        made = numbering.outline_numbers(heads, [], "at")
        assert [r.n for r in made.orderBy("at").collect()] == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pictures_of_many_packages_are_no_frame_of_their_own():
    """Entries leave a worker by bytes, not by batches of packages."""
    from foliant.sources.containers import FRAME_BYTES, _entry_frames

    made = ((k, f"a{k}.png", 0, 8, bytes(1 << 20), None) for k in range(40))
    sizes = [(len(f), f["data"].map(len).sum()) for f in _entry_frames(made)]
    assert sum(n for n, _ in sizes) == 40
    assert max(size for _, size in sizes) <= FRAME_BYTES + (1 << 20)


def test_damaged_packages_beside_whole_ones(spark):
    """Batches are bounded by bytes; a damaged package is one row with an error, and the others are read."""
    from foliant.session import BATCH_BYTES
    from foliant.sinks.packages import zipped
    from foliant.sources.containers import zip_entries

    whole = zipped({"a.png": b"1" * 100, "b.xml": "<a/>", "c.png": b"2"})
    files = spark.createDataFrame([(1, whole), (2, whole[:-30]), (3, whole), (4, None)], "doc_id long, content binary").coalesce(1)
    got = sorted((r.doc_id, r.path or "", len(r.data or b""), r.error is None) for r in zip_entries(files, r".*\.png").collect())
    assert got == [(1, "a.png", 100, True), (1, "c.png", 1, True), (2, "", 0, False), (3, "a.png", 100, True), (3, "c.png", 1, True), (4, "", 0, False)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) == BATCH_BYTES


def test_pages_come_to_a_worker_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(markup, "PAGE_BYTES", 7)
    html = {1: "<p id='a'>가나다 &amp; é&lt;b&gt;</p><br>" * 3, 2: "", 3: "<div>" * 300 + "too deep, and more of it", 4: "x<p>😀 end"}
    pages = spark.createDataFrame([*html.items(), (5, None)], "doc_id long, html string").coalesce(1)
    pieces = markup.page_pieces(pages.fillna("")).collect()
    assert max(len(r.data) for r in pieces) == 7 and {i: b"".join(r.data for r in pieces if r.doc_id == i).decode() for i in html} == html
    got = {i: [] for i in (*html, 5)}
    for r in markup.html_nodes(pages, "doc_id").orderBy("node_id").collect():
        got[r.doc_id].append((r.node_id, r.name, r.text, r.path, r.error))
    blocks = frozenset(["p"])
    assert got == {i: [(r[2], r[5], r[7], r[9], r[11]) for r in markup.html_rows(i, text, blocks)] for i, text in {**html, 5: ""}.items()}


def test_frames_are_bounded_by_attributes_too():
    made = ([["", "", k, None, 0, "img", {"src": "x" * (1 << 20)}, None, None, "", None, None, k, k, None, None]] for k in range(40))
    sizes = [len(f) for f in markup._frames(made)]
    assert sum(sizes) == 40 and max(sizes) <= 8


def test_tables_that_a_document_lacks_start_no_worker(spark):
    blocks = spark.range(1).selectExpr("id as doc_id", "0 as ord", "'p' as tag")
    doc = Document(blocks, blocks.selectExpr("doc_id", "ord", "0 as run", "'x' as text"))
    for name, columns in (("cells", ["row", "row_span"]), ("notes", ["note", "text"]), ("images", ["ext", "data"])):
        df = getattr(doc, name)
        assert df.count() == 0 and set(columns) < set(df.columns) and "RDD" not in df._jdf.queryExecution().analyzed().toString()


def test_workers_of_packages_load_no_pandas(spark):
    """Packing and parsing are Arrow alone: a worker with pandas is half as large again."""
    blocks = spark.createDataFrame([(1, 0, "p", "one"), (1, 1, "p", "two & more"), (2, 0, "h1", "x")], "doc_id long, ord int, tag string, text string")
    files = packages.write(blocks, "docx")
    back = source.packages.nodes_of(files, "docx")
    plans = files._jdf.queryExecution().toString() + back._jdf.queryExecution().toString()
    assert "MapInArrow" in plans and "MapInPandas" not in plans and "ArrowEvalPython" not in plans
    assert "pd" not in vars(packages) and "pd" not in vars(markup)
    assert sorted((r.doc_id, r.ord, r.text) for r in source.packages.read_text(files, "docx").collect()) == [(1, 0, "one"), (1, 1, "two & more"), (2, 0, "x")]


def test_bodies_come_to_a_worker_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(markup, "PAGE_BYTES", 7)
    monkeypatch.setattr(packages, "BATCH_ROWS", 2)
    texts = {k: "가나다 & é 😀 " * k for k in range(5)}
    bodies = spark.createDataFrame([(k // 2, t.replace("&", "&amp;")) for k, t in texts.items()], "doc_id long, xml string").coalesce(1)
    made = [zipfile.ZipFile(io.BytesIO(r.content)) for r in packages.package_body(bodies, "odt").collect()]
    _, before, after, fixed = packages._BODY["odt"]
    assert [z.read("content.xml").decode() for z in made] == [before + t.replace("&", "&amp;") + after for t in texts.values()]
    assert all(set(z.namelist()) == {"content.xml", *fixed} for z in made)


def test_a_round_trip_reads_stored_packages(spark, monkeypatch):
    """No task has a worker that zips and another that parses."""
    from foliant.plans import queries_documents

    blocks = spark.range(2).selectExpr("id as doc_id", "0 as ord", "'p' as tag")
    seen, read = [], queries_documents.source.read
    monkeypatch.setattr(queries_documents.source, "read", lambda files, kind: seen.append(files) or read(files, kind))
    back = queries_documents.through(Document(blocks, blocks.selectExpr("doc_id", "ord", "0 as run", "'x' as text")), "docx")
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().toString() and seen[0].count() == 2
    assert sorted((r.doc_id, r.text) for r in back.runs.collect()) == [(0, "x"), (1, "x")]


def test_faults_are_counted_in_one_pass(spark, tmp_path):
    from __spark_entry__ import queries
    from foliant.plans import verify

    rows = [(1, 0, "all  is\there "), (1, 1, ""), (2, 0, "kept whole"), (2, 1, "kept lost lost gone"), (3, 0, "in a broken part"), (4, 0, " \t "), (5, 0, "no package")]
    blocks = spark.createDataFrame(rows, "doc_id long, ord int, text string").selectExpr("*", "'p' as tag")
    kept = blocks.filter("doc_id < 3 and not (doc_id = 2 and ord = 1)").unionByName(blocks.filter("doc_id = 4"))
    for kind in ("docx", "odt"):
        damaged = packages.zipped({"mimetype": "m", "a.xml": "<a><b>in a part", "x.rels": "<a>", "y.hpf": "<a>kept</a>", "z.png": b"<a>"})
        files = packages.write(kept, kind).unionByName(spark.createDataFrame([(3, damaged)], "doc_id long, content binary"))
        want = (verify.broken_parts(files).count(), verify.lost_tokens(blocks, files).count())
        assert want[0] == 2 and want[1] > 2
        assert tuple(verify.faults(blocks, files).first()) == want
    spark.createDataFrame([(1, "a  b\nc\td"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["package_rules"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("docx", 3, 0, 0, 0), ("hwpx", 3, 3, 0, 0), ("odt", 3, 3, 0, 0)]
    assert "MapInArrow" not in found._jdf.queryExecution().toString()  # packages are opened for the counts, and not again


def test_what_was_shuffled_for_a_written_table_is_deleted(spark, tmp_path):
    import pathlib
    import time

    from __spark_entry__ import queries
    from foliant.session import SHUFFLE_CLEANUP, scratch_made, written

    root = pathlib.Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {f.name for f in root.rglob("shuffle_*.data")}
    before = files()
    back = written(spark.range(1000).repartition(7, "id"), "dealt")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(SHUFFLE_CLEANUP, None) is None and back.count() == 1000
    spark.createDataFrame([(k, f"a {k}\nb") for k in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = scratch_made()
    found = queries()["conversion_matrix"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(kind, 30, 0) for kind in ("docx", "hwpx", "odt")]
    assert not [p for p in scratch_made(made) if "-packages-" in p]


def test_paragraphs_are_dealt_once(spark):
    from foliant.sources import packages as reader

    files = spark.createDataFrame([(1, b"")], "doc_id long, content binary")
    assert reader.read_text(files, "odt")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pages_are_pieces(spark):
    from pyspark.sql import functions as F

    from foliant.plans import document_ir

    rows = [(d, 2, "table", None) for d in (1, 2)] + [(d, k, "p", "header" if k == 0 else "footer" if k == 1 else None) for d in (1, 2) for k in (0, 1, *range(3, 60))] + [(3, 0, "p", "header")]
    blocks = spark.createDataFrame(rows, "doc_id long, ord int, tag string, band string")
    runs = blocks.filter("tag = 'p'").select("doc_id", "ord", F.lit(0).alias("run"), F.when(F.col("doc_id") < 3, F.concat(F.lit("é <text> "), "ord")).otherwise("").alias("text"), F.when((F.col("ord") == 5) & (F.col("doc_id") == 1), 1).alias("note"))
    cells = spark.createDataFrame([(d, 2, r, c, 1, 1, 50.0, f"cell {r} {c}") for d in (1, 2) for r in range(200) for c in range(2)], "doc_id long, ord int, row int, col int, row_span int, col_span int, width double, text string")
    doc = Document(blocks, runs, cells, spark.createDataFrame([(1, 1, "a note")], "doc_id long, note int, text string"))
    pieces = document_ir.emit_pieces(doc).cache()
    assert max(len(r.xml) for r in pieces.collect()) < 300  # neither a page nor a table is a string of its own
    pages = document_ir.emit_document(doc).collect()
    assert {r.doc_id: r.html for r in pages} == {d: "".join(r.xml for r in pieces.filter(f"doc_id = {d}").orderBy("seg", "at", "sub").collect()) for d in (1, 2)}
    for r in pages:
        assert r.html.startswith("<doc-section") and "><doc-header><p " in r.html and r.html.count("<tr>") == 200 and r.html.endswith("</doc-footnote></doc-section>" if r.doc_id == 1 else "</doc-footer></doc-section>")
    whole = markup.html_nodes(spark.createDataFrame(pages), "doc_id", blocks=document_ir.BLOCKS)
    assert sorted(map(str, markup.piece_nodes(pieces, blocks=document_ir.BLOCKS).collect())) == sorted(map(str, whole.collect()))
    pieces.unpersist()


def test_small_files_of_many_rows_are_not_broadcast(spark, monkeypatch):
    from foliant import session

    keys = session.written(spark.range(400_000).selectExpr("id div 1000 as doc_id", "cast(id % 1000 as int) as ord"), "keys")  # a file of 47 KB
    joined = keys.join(keys.selectExpr("doc_id", "ord", "ord * 2 as twice"), ["doc_id", "ord"])
    plans = []
    kept = session.written
    monkeypatch.setattr(session, "written", lambda df, name: (plans.append(df.select("*")._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    before = {k: spark.conf.get(k, None) for k in session.BY_ROWS}
    assert session.written_by_rows(joined, "joined").count() == 400_000
    assert len(plans) == 1 and "Broadcast" not in plans[0]
    assert {k: spark.conf.get(k, None) for k in session.BY_ROWS} == before
