"""Files saved back: whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from foliant.sinks import saveback
from foliant.streaming import sessions


def files_under(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.endswith(".result.json"))


def test_saved_files_and_their_result(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "old.docx").write_bytes(b"old")
    (tmp_path / "a" / "kept.docx").write_bytes(b"kept")
    rows = [("a/old.docx", b"new", True, None), ("a/kept.docx", b"no", False, None), ("b/c/x.edited.odt", b"x" * 3000, False, "doc is saved as odt"), ("twice.odt", b"1", False, None), ("twice.odt", b"2", False, None)]
    df = spark.createDataFrame(rows, saveback.SCHEMA).repartition(3)
    got = {(r.path, r.bytes): (r.saved, r.overwrote, r.note) for r in saveback.save(df, root).collect()}
    assert got["a/old.docx", 3] == (True, True, None) and got["a/kept.docx", 2] == (False, False, "the target is there") and got["b/c/x.edited.odt", 3000] == (True, False, "doc is saved as odt")
    assert files_under(root) == ["a/kept.docx", "a/old.docx", "b/c/x.edited.odt", "twice.odt"]
    assert (tmp_path / "a" / "old.docx").read_bytes() == b"new" and (tmp_path / "a" / "kept.docx").read_bytes() == b"kept"
    again = saveback.save(spark.createDataFrame([("later.odt", b"z", False, None)], saveback.SCHEMA), root)
    assert [(r.path, r.saved) for r in again.collect()] == [("later.odt", True)]


def test_nothing_is_left_of_an_aborted_write(spark, tmp_path):
    good = spark.range(20).select(F.format_string("f%02d.odt", "id").alias("target"), F.lit(b"x").alias("content"), F.lit(False).alias("overwrote"), F.lit(None).cast("string").alias("note"))
    bad = spark.createDataFrame([("../out.odt", b"x", False, None)], saveback.SCHEMA)
    with pytest.raises(Exception, match="below the root"):
        saveback.save(good.unionByName(bad), str(tmp_path))
    assert files_under(str(tmp_path)) == [] and not (tmp_path.parent / "out.odt").exists()


def test_requests_to_files(spark, tmp_path):
    now = F.lit("2024-05-02 12:00:00").cast("timestamp")
    granted = spark.createDataFrame([("t1", "doc", "in/report.doc"), ("t2", "odt", "in/x.odt")], "token string, ext string, src string").withColumn("created_at", F.lit("2024-05-02 01:00:00").cast("timestamp"))
    asked = [("t1", "PUT", None, True, 3, "in", b"one", 1), ("t1", "PUT", None, True, 3, "in", b"two", 2), ("t2", "PUT", None, True, 5, "in", b"three", 1), ("t2", "GET", None, True, 5, "in", b"three", 9), ("t9", "PUT", None, True, 5, "in", b"three", 9)]
    requests = spark.createDataFrame(asked, "token string, method string, ext string, overwrite boolean, size int, folder string, content binary, asked_at int")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.odt").write_bytes(b"before")
    out = saveback.save(saveback.targets(sessions.decide(requests, granted, now)), str(tmp_path))
    assert {(r.path, r.saved, r.overwrote) for r in out.collect()} == {("in/report.edited.docx", True, False), ("in/x.odt", True, True)}
    assert (tmp_path / "in" / "report.edited.docx").read_bytes() == b"two" and (tmp_path / "in" / "x.odt").read_bytes() == b"three"
