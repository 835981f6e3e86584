"""Registered queries of binary records, character streams and anti-joins, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import edits, streams
from foliant.plans.queries import query
from foliant.session import table
from foliant.sources import containers, packages


def _little_endian(value: Column) -> Column:
    """Four bytes, lowest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(value, s).bitwiseAND(F.lit(255))), 2, "0")) for s in (0, 8, 16, 24)])


@query("""
WITH e AS (SELECT user_id AS u, event_id % 5 AS level, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS seq, (event_id % 3) * 2 AS size, event_id % 900 AS tag FROM events)
SELECT a.u AS doc_id, a.seq, a.tag::INTEGER AS tag, a.level::INTEGER AS level, a.size::INTEGER AS size, max(b.seq)::INTEGER AS parent FROM e a LEFT JOIN e b ON a.u = b.u AND b.level = a.level - 1 AND b.seq < a.seq GROUP BY ALL""")
def record_tree(spark, sf):
    """Record streams, a head and a payload for every event, parsed back and joined to their parents."""
    k = F.col("event_id")
    size = (k % 3) * 2
    head = _little_endian((k % 900).bitwiseOR(F.shiftleft(k % 5, 10)).bitwiseOR(F.shiftleft(size, 20)).cast("long"))
    each = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("doc_id"), "event_id", F.hex(F.concat(head, F.substring(F.lit(b"abcd"), F.lit(1), size.cast("int")))).alias("x"))
    data = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "x"))), lambda r: r["x"]), ""))
    made = each.groupBy("doc_id").agg(data.alias("data")).select("doc_id", F.lit("Section0").alias("path"), "data", F.lit(None).cast("string").alias("error"))
    found = containers.record_parents(containers.hwp_records(made))
    return found.select("doc_id", "seq", "tag", "level", F.octet_length(found.columns[5]).cast("int").alias("size"), "parent")


#: Characters of a text that a stream would take for field marks, and the one that stands before those put in their place.
_OWN_MARKS = {"\x10": "\x10P", "\x13": "\x10S", "\x14": "\x10T", "\x15": "\x10U"}


def _coded(text: Column) -> Column:
    """Text with a field in each line: its code is hidden, its result shown. Marks of the text's own are put otherwise, and
    the last paragraph ends with its mark as all others do, so that an empty text has one."""
    for own, other in _OWN_MARKS.items():
        text = F.replace(text, F.lit(own), F.lit(other))
    return F.concat(F.replace(text, F.lit("\n"), F.lit("\x13 LINK \x13x\x14y\x15 \x14 and \x15\r")), F.lit("\r"))


def _plain(text: Column) -> Column:
    """The text whose own marks were put otherwise."""
    for own, other in reversed(_OWN_MARKS.items()):
        text = F.replace(text, F.lit(other), F.lit(own))
    return text


@query(r"""
SELECT doc_id, (len(string_split(text, chr(10))))::BIGINT AS paragraphs, md5(replace(regexp_replace(text, '[\x07\r]', '', 'g'), chr(10), ' and ' || chr(10))) AS text_md5 FROM documents""")
def field_paragraphs(spark, sf):
    """A row of documents is a stream of its own, also where its id is not unique; a null text is none."""
    copy = F.row_number().over(W.partitionBy("doc_id").orderBy("text")).alias("copy")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x07\r]", "")
    by = ["doc_id", "copy", "missing"]
    docs = table(spark, sf, "documents").select("doc_id", copy, F.col("text").isNull().alias("missing"), _coded(text).alias("text"))
    found = streams.paragraphs(streams.hide_field_codes(streams.stretches(docs, "text"), by), by)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par", "text"))), lambda p: p["text"]), "\n")
    whole = found.groupBy(*by).agg(F.count("*").alias("paragraphs"), joined.alias("text"))
    there = lambda c: F.when(~F.col("missing"), c)
    return whole.select("doc_id", there(F.col("paragraphs")).alias("paragraphs"), there(F.md5(_plain(F.col("text")).cast("binary"))).alias("text_md5"))


@query("""
WITH r AS (SELECT user_id, event_id AS fc, event_type FROM events WHERE event_id % 3 = 0), c AS (SELECT user_id, event_id AS fc FROM events WHERE event_id % 3 <> 0)
SELECT c.user_id, c.fc, coalesce(r.event_type, 'none') AS format FROM c ASOF LEFT JOIN r ON c.user_id = r.user_id AND c.fc >= r.fc""")
def char_formats(spark, sf):
    """Characters with the format of the last run before them, the default before the first; runs are made one per start."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("fc"), "event_type")
    runs = e.filter("fc % 3 = 0").select("user_id", "fc", F.col("event_type").alias("format"), F.lit(0).alias("page"))
    twice = runs.unionByName(runs.withColumn("format", F.lit("later")).withColumn("page", F.lit(1)))
    return streams.char_formats(e.filter("fc % 3 <> 0").select("user_id", "fc"), streams.first_starts(twice, ["user_id"], ["format"]), ["user_id"], ["format"], {"format": F.lit("none")})


@query("""
SELECT c_custkey AS cp, o.o_orderkey AS picture FROM customer JOIN orders o ON o.o_orderkey = c_custkey * 2 AND o.o_orderkey % 3 = 0""")
def floating_pictures(spark, sf):
    anchors = table(spark, sf, "customer").select(F.lit(1).alias("doc_id"), F.col("c_custkey").alias("cp"), (F.col("c_custkey") + 1000).alias("spid"))
    shapes = table(spark, sf, "customer").select(F.lit(1).alias("doc_id"), (F.col("c_custkey") + 1000).alias("spid"), (F.col("c_custkey") * 2).alias("pib"))
    store = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.lit(1).alias("doc_id"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("data"), F.lit("png").alias("ext"))
    return streams.floating_pictures(anchors, shapes, store, ["doc_id"]).select("cp", F.col("data").alias("picture"))


@query("""
SELECT n_nationkey AS cp, CASE WHEN n_nationkey % 4 = 0 THEN 'own' || n_nationkey WHEN n_nationkey % 4 = 1 AND n_regionkey <> 0 THEN 'stored' || n_regionkey || '-1' WHEN n_regionkey = 0 THEN 'stored0-1' END AS picture FROM nation""")
def inline_pictures(spark, sf):
    """Its own bytes, else the store's by number, else the only one of the document's store (document 0 has one)."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("cp"), F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("own"), "n_nationkey")).alias("own"), F.when(F.col("n_nationkey") % 4 == 1, 1).otherwise(99).alias("pib"))
    r = table(spark, sf, "region").withColumn("k", F.explode(F.when(F.col("r_regionkey") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
    store = r.select(F.col("r_regionkey").alias("doc_id"), "k", F.concat(F.lit("stored"), "r_regionkey", F.lit("-"), "k").alias("data"))
    return streams.inline_pictures(n, store, ["doc_id"]).select("cp", F.col("data").alias("picture"))


@query("""
WITH e AS (SELECT p_partkey % 50 AS doc_id, 'bin/i' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.xml' ELSE '.PNG' END AS path FROM part), m AS (SELECT DISTINCT o_orderkey % 50 AS doc_id, 'bin/i' || o_orderkey || '.PNG' AS path FROM orders WHERE o_orderkey % 3 = 0)
SELECT e.doc_id, e.path FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = e.doc_id AND m.path = e.path) AND e.path LIKE '%.PNG'""")
def orphan_images(spark, sf):
    name = lambda k, ext: F.concat(F.lit("bin/i"), k, ext)
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    entries = table(spark, sf, "part").select((p % 50).alias("doc_id"), name(p, F.when(p % 4 == 0, ".xml").otherwise(".PNG")).alias("path"))
    manifest = table(spark, sf, "orders").filter(o % 3 == 0).select((o % 50).alias("doc_id"), name(o, F.lit(".PNG")).alias("path"))
    return packages.orphan_entries(entries, manifest)


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def referenced_notes(spark, sf):
    bodies = table(spark, sf, "orders").select("o_orderkey")
    refs = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return edits.drop_unreferenced(bodies, refs, ["o_orderkey"])


@query("""
SELECT user_id, count(*)::BIGINT AS passes FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events) WHERE new = 1 GROUP BY user_id""")
def repagination_passes(spark, sf):
    """Edits that follow each other within the pause are one pass; here the pause is six hours of events."""
    from foliant.streaming.sessions import debounced

    return debounced(table(spark, sf, "events").select("user_id", "ts"), ["user_id"], "ts", "6 hours").groupBy("user_id").agg(F.count("*").alias("passes"))


@query("""
SELECT user_id AS doc_id, count(*)::BIGINT AS violations, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (n <= 3) AS samples FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click') GROUP BY user_id""")
def limited_samples(spark, sf):
    from foliant.operators.ordered import first_of

    clicks = table(spark, sf, "events").filter("event_type = 'click'").select(F.col("user_id").alias("doc_id"), "event_id")
    return first_of(clicks, ["doc_id"], "event_id", 3).select("doc_id", F.col("n").alias("violations"), F.array_join("first", ",").alias("samples"))
