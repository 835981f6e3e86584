"""Character streams."""

from pyspark.sql import functions as F

from foliant.operators import streams


def test_fields_and_paragraphs(spark):
    s = "a\x13code \x13in\x14x\x15y\x14res\x15b\rc\x13hide\x15d\x07e"
    chars = spark.createDataFrame([(1, i, ord(c)) for i, c in enumerate(s)], "doc int, cp int, code int")
    shown = streams.hide_field_codes(chars, ["doc"])
    assert "".join(chr(r.code) for r in shown.orderBy("cp").collect()) == "aresb\rcd\x07e"
    got = [(r.text, r.in_cell) for r in streams.paragraphs(shown, ["doc"]).orderBy("par").collect()]
    assert got == [("aresb", False), ("cd", True), ("e", False)]


def test_pieces_and_formats(spark):
    pieces = spark.createDataFrame([(1, 0, 3, 100, True), (1, 3, 5, 400, False)], "doc int, cp_start int, cp_end int, fc int, compressed boolean")
    each = streams.characters(pieces, ["doc"])
    assert [r.fc for r in each.orderBy("cp").collect()] == [100, 101, 102, 400, 402]
    at = streams.locate(spark.createDataFrame([(1, 4), (1, 9)], "doc int, cp int"), pieces, ["doc"]).collect()
    assert [(r.cp, r.fc) for r in at] == [(4, 402)]
    runs = streams.first_starts(spark.createDataFrame([(1, 101, 0, 12), (1, 101, 1, 99), (1, 402, 0, 16)], "doc int, fc int, page int, size int"), ["doc"], ["size"])
    sized = streams.char_formats(each.drop("compressed"), runs, ["doc"], ["size"], {"size": F.lit(10)})
    assert [r["size"] for r in sized.orderBy("cp").collect()] == [10, 12, 12, 12, 16]


def test_pictures(spark):
    store = spark.createDataFrame([(1, 1, bytearray(b"A"), "png")], "doc int, k int, data binary, ext string")
    anchors = spark.createDataFrame([(1, 5, 70)], "doc int, cp int, spid int")
    shapes = spark.createDataFrame([(1, 70, 1)], "doc int, spid int, pib int")
    assert bytes(streams.floating_pictures(anchors, shapes, store, ["doc"]).first()["data"]) == b"A"
    places = spark.createDataFrame([(1, 2, bytearray(b"own"), None), (1, 3, None, 1), (1, 4, None, 9)], "doc int, cp int, own binary, pib int")
    assert {r.cp: bytes(r["data"]) for r in streams.inline_pictures(places, store, ["doc"]).collect()} == {2: b"own", 3: b"A", 4: b"A"}


def test_field_paragraphs_of_odd_texts(spark, tmp_path):
    """Empty and null texts, control characters that texts bring themselves, and ids that are not unique, as the SQL has them."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from __spark_entry__ import oracle_sql, queries

    texts = ["", None, "\r", "\x07\r\n", "\n", "\n\nx\n", "a\x13b\x14c\x15d", "\x15\x14\x13", "\x10S\x10\x13P\x10\x10\nT", "é𝄞\x00\x0b\x85 z", "twice", "twice", "other\nof one id"]
    ids = [*range(10), 10, 10, 10]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    want = duckdb.sql(oracle_sql()["field_paragraphs"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")).fetchall()
    got = queries()["field_paragraphs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
