"""Operator 4, secret scans: multipart credential linking, in DataFrame functions only.

Strong patterns (assign, access, hex) are always reported. Weak ones - a user or
client name (id), a bare 40-character key (secret), an address (endpoint) - mean
little alone, so they are reported only where complementary parts stand in the
same scope: a secret near an identifier, an identifier near a secret, an
endpoint near both. "Near" is an interval join on the document: the spans of a
document are put in order, and windows over that order carry the end of the
last identifier, secret and endpoint before a span and the start of the next
one after it, so a span meets its nearest partners and no list of pairs is made.

All patterns run inside the JVM over whole texts, each only on texts that pass a
cheap test of what it needs. For each match only lengths leave the text: of the
gap before it, of itself and of the group that counts. Positions are running sums
over these, taken in a window by document and kind, so the work is linear in the
matches. These rows, never texts, are written and shuffled by a row number, so a
hot source or a repeated id is no hot key, and the numbers survive lost executors.

Positions are code points, ends exclusive. Null and empty texts have no spans;
very long texts are scanned whole; repeated rows and rows that repeat an id are
scanned one by one; null ids stay null; an empty table gives no rows; other
columns of any name are not read (redact hands them on). Spans that start at the
same place stand in the order of KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import nested, small, texts, unnested
from foliant.session import written


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key") + ")" + _SET + "([A-Za-z0-9+/_.=-]+)"
NAME = "(" + "|".join(any_case(w) for w in ("username", "user", "login")) + "|" + any_case("client") + "_?" + any_case("id") + ")" + _SET + "([A-Za-z0-9._@-]+)"
#: kind, pattern, group whose length counts, least and most length of it, role
KINDS = (
    ("assign", ASSIGN, 2, 8, None, "secret"),
    ("access", "AKIA[A-Z0-9]+", 0, 16, None, "id"),
    ("hex", "[0-9a-f]{32,}", 0, 32, None, "secret"),  # the maximal runs of 32 and more
    ("id", NAME, 2, 3, None, "id"),
    ("secret", "[A-Za-z0-9+/]{40,}", 0, 40, 40, "secret"),
    ("endpoint", r"""(https?|ftp|ssh|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", 0, 8, None, "endpoint"),
)
BASE = ("assign", "access", "hex")
ROLES = ("id", "secret", "endpoint")
#: Code points between two parts of one credential, at most.
SCOPE = 200
_PARTS = "array<struct<rank:int,nth:int,gap:int,hit:int,good:boolean>>"


def _contains(*any_of: str):
    def test(text: Column) -> Column:
        found = text.contains(any_of[0])
        for x in any_of[1:]:
            found = found | text.contains(x)
        return found

    return test


#: What a text must hold for a kind to match at all: cheaper than the pattern.
NEEDS = {
    "assign": _contains(":", "="),
    "id": _contains(":", "="),
    "access": _contains("AKIA"),
    "endpoint": _contains("://"),
    "hex": lambda text: text.rlike("[A-Za-z0-9+/]{32}"),
    "secret": lambda text: text.rlike("[A-Za-z0-9+/]{32}"),
}


def parts_of(text: Column, kind: str, pattern: str, group: int, least: int, most: int | None) -> Column:
    """(rank, nth, gap before, length, of the wanted length) of a pattern's leftmost matches that do not overlap."""
    rank = [k[0] for k in KINDS].index(kind)

    def part(x: Column, nth: Column) -> Column:
        size = F.length(x["value"])
        good = (size >= least) if most is None else size.between(least, most)
        return F.struct(F.lit(rank).alias("rank"), nth.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), good.alias("good"))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"),  # without what comes after the last match
        hits.alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    return F.when(text.rlike(pattern), F.transform(zipped, part)).otherwise(F.expr(f"cast(array() as {_PARTS})"))


def all_parts(text: Column) -> Column:
    """The parts of all kinds; kinds with the same need share its test."""
    none = F.expr(f"cast(array() as {_PARTS})")
    groups = (("assign", "id"), ("access",), ("endpoint",), ("hex", "secret"))
    by_kind = {k[0]: k for k in KINDS}
    return F.concat(*[F.when(NEEDS[g[0]](text), F.concat(*[parts_of(text, *by_kind[k][:5]) for k in g])).otherwise(none) for g in groups])


def placed(parts: DataFrame) -> DataFrame:
    """row, s (start, rank, kind, end) from columns row, p: starts are running sums over the matches of a kind; rows without a match have no s."""
    order = W.partitionBy("row", "p.rank").orderBy("p.nth")
    before = F.sum(F.col("p.gap") + F.col("p.hit")).over(order.rowsBetween(W.unboundedPreceding, -1))
    start = (F.coalesce(before, F.lit(0)) + F.col("p.gap")).cast("int")
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("p.rank") + 1)
    s = F.struct(start.alias("start"), F.col("p.rank").alias("rank"), kind.alias("kind"), (start + F.col("p.hit")).cast("int").alias("end"))
    return parts.select("row", s.alias("s"), F.col("p.good").alias("good"))


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Adds kept: base spans, and those weak ones whose complementary parts are in scope (columns row, s)."""
    before = W.partitionBy("row").orderBy("s.start", "s.rank").rowsBetween(W.unboundedPreceding, -1)
    # what comes after a span is what comes before it in the opposite order: a frame that grows costs one step a row
    after = W.partitionBy("row").orderBy(F.desc("s.start"), F.desc("s.rank")).rowsBetween(W.unboundedPreceding, -1)
    role = F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k[0], k[5])]), F.col("s.kind"))
    out = spans.withColumn("role", role).withColumn("base", F.col("s.kind").isin(*BASE))
    for r in ROLES:
        last = F.max(F.when(F.col("role") == r, F.col("s.end"))).over(before)
        nxt = F.min(F.when(F.col("role") == r, F.col("s.start"))).over(after)
        near = (F.col("s.start") - last <= scope) | (nxt - F.col("s.end") <= scope)
        out = out.withColumn(f"near_{r}", F.coalesce(near, F.lit(False)))
    inside = (F.max(F.when(F.col("base"), F.col("s.end"))).over(before) > F.col("s.start")) | (F.min(F.when(F.col("base"), F.col("s.start"))).over(after) < F.col("s.end"))
    out = out.withColumn("inside", F.coalesce(inside, F.lit(False)))
    whole = (
        F.when(F.col("s.kind") == "secret", F.col("near_id"))
        .when(F.col("s.kind") == "id", F.col("near_secret"))
        .when(F.col("s.kind") == "endpoint", F.col("near_id") & F.col("near_secret"))
    )
    return out.withColumn("kept", F.coalesce(F.col("base") | (whole & ~F.col("inside")), F.lit(False)))


def found_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text_hash) of all rows and (row, s) of the spans that are reported."""
    rows = texts(docs, text_col, id_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), all_parts(F.col("text")).alias("parts"))
    rows = written(rows, "spans")  # no texts; and the row numbers stay as they are when a task runs again
    parts = rows.select("row", F.explode("parts").alias("p")).repartition("row")
    spans = placed(parts).filter("good").drop("good")
    return rows.select("row", "doc_id", "text_hash"), linked(spans, scope).filter("kept").select("row", "s")


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash, spans (array of start, rank, kind, end in order): one row per row of docs."""
    rows, spans = found_spans(docs, text_col, id_col, scope)
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    return rows.join(per_row, "row", "left").select("doc_id", "text_hash", F.coalesce("spans", none).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every reported span replaced by a mark; n_chars follows the text where docs has it.

    Spans that overlap are merged where they lie as rows. What is joined to the
    texts, one small row per text with a secret, is broadcast while it is
    measured to be small; only beyond that are texts shuffled.
    """
    rows, spans = found_spans(docs, text_col, id_col)
    order = W.partitionBy("row").orderBy("s.start", "s.end")
    reach = F.max("s.end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.select("row", "s", F.when(F.col("s.start") < reach, 0).otherwise(1).alias("new"))
    group = fresh.select("row", "s", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("nth"))
    merged = group.groupBy("row", "nth").agg(F.struct(F.min("s.start").alias("start"), F.max("s.end").alias("end")).alias("m"))
    merged = merged.groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("cuts"))
    found = written(rows.join(merged, "row").dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "cuts"), "cuts")
    flat = nested(docs, text_col, id_col)
    joined = flat.join(small(found, "cuts"), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash")), "left")
    text = F.col("row").getField(text_col)
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda m: m["end"]))
    ends = F.concat(F.transform("cuts", lambda m: m["start"]), F.array(F.length(text)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    hit = F.col("cuts").isNotNull()
    joined = joined.select("row", hit.alias("hit"), F.when(hit, F.array_join(pieces, mark)).otherwise(text).alias("new"))
    changes = {text_col: F.col("new")}
    if "n_chars" in docs.columns and text_col != "n_chars":
        n_chars = F.col("row").getField("n_chars")
        changes["n_chars"] = F.when(F.col("hit"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(n_chars)
    return unnested(joined, docs.columns, **changes)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
