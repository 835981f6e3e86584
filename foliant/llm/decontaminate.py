"""Operator 6, benchmark decontamination by winnowing, in DataFrame functions only.

A window is 13 consecutive words of an item (a shorter item is one window). Over
texts of words the hashes of all k-word grams are taken, and of every run of w
grams the smallest hash is kept, where w + k - 1 is the window's length: two
texts that share a window share the window's smallest hash, whatever stands
around it. So the documents' fingerprints are joined with the benchmark's; only
where they meet are the windows themselves compared, word for word, and a hit
covers all words of its window.

One pass over the texts takes words: it writes each document's number of words and
its distinct fingerprints, and all else but the windows of the documents that
share a fingerprint works on that table. The benchmark's fingerprints and windows
are unique keys, so that a common passage meets one row and not one per item. A
side is broadcast only while its measured bytes are under BROADCAST_BYTES; beyond
that Spark joins by shuffling: (key, hash) pairs for fingerprints, windows of the
candidates, and only for the list of candidates itself whole texts.

Null and empty texts have no words and no hits; empty and null items have no
windows; equal items all count. Very long texts are taken whole and cost in
proportion to their words. Repeated document rows are repeated in the result, null
ids stay null, an empty table of either kind gives no rows or no hits, and other
columns of any name are not read (drop_contaminated hands them on). Documents are
keyed by id and text hash, so equal ids with other texts do not mix. Ties: of two
equal smallest grams in a window only the value counts, not the place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common
from foliant.llm.common import nested, unnested
from foliant.session import written

WINDOW, GRAM = 13, 5
#: Bytes that a broadcast side may have.
BROADCAST_BYTES = common.BROADCAST_BYTES
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))  # A-Z only
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n-1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def window_minima(found: Column, span: int, gram: int = GRAM) -> Column:
    """The smallest gram hash of every window of `span` words, in order."""
    k = min(gram, span)
    w = span - k + 1

    def minima(h: Column) -> Column:
        grams = F.transform(_upto(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])) if k > 1 else h
        if w == 1:
            return grams
        return let(grams, lambda g: F.transform(_upto(F.size(g) - (w - 1)), lambda i: F.array_min(F.slice(g, i + 1, w))))

    return let(F.transform(found, lambda x: F.xxhash64(x)), minima)


def _prints(span: int) -> Callable[[Column], Column]:
    return lambda found: F.transform(F.array_distinct(window_minima(found, span)), lambda h: F.struct(F.lit(span).alias("span"), h.alias("hash")))


def small(df: DataFrame, *sized: str) -> DataFrame:
    return common.small(df, *sized, most=BROADCAST_BYTES)


def _windows(span: int) -> Callable[[Column], Column]:
    """(span, start, window) of every run of `span` words, joined by spaces."""

    def of(found: Column) -> Column:
        run = lambda i: F.struct(F.lit(span).alias("span"), i.alias("start"), F.array_join(F.slice(found, i + 1, span), " ").alias("window"))
        return F.transform(_upto(F.size(found) - (span - 1)), run)

    return of


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array of item ids as strings): one row per row of docs."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col("text")).alias("found")).filter(F.size("found") > 0)
    items = items.withColumn("span", F.least(F.size("found"), F.lit(window)))
    spans = sorted(r["span"] for r in items.select("span").distinct().collect())  # 13 at most
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    none = F.expr("cast(array() as array<string>)")
    taken = let(words(F.col("text")), lambda f: F.struct(F.size(f).cast("long").alias("n_words"), F.concat(F.expr("cast(array() as array<struct<span:int,hash:bigint>>)"), *[_prints(s)(f) for s in spans]).alias("prints")))
    taken = written(base.select("doc_id", "text_hash", taken.alias("t")).select("doc_id", "text_hash", "t.n_words", "t.prints"), "words")
    counted = taken.select("doc_id", "text_hash", "n_words")
    if not spans:
        return counted.select("doc_id", "text_hash", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    made = [F.when(F.col("span") == s, let(F.col("found"), _windows(s))) for s in spans]
    windows = items.select("item", F.explode(F.coalesce(*made)).alias("w"))
    windows = written(windows.groupBy("w.span", "w.window").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    fps = [F.when(F.col("span") == s, let(F.col("found"), _prints(s))) for s in spans]
    prints = written(items.select(F.explode(F.coalesce(*fps)).alias("p")).select("p.span", "p.hash").distinct(), "prints")
    # documents that share a fingerprint
    mine = taken.select("doc_id", "text_hash", F.explode("prints").alias("p")).select("doc_id", "text_hash", "p.span", "p.hash")
    candidates = written(mine.join(small(prints), ["span", "hash"], "left_semi").select("doc_id", "text_hash").distinct(), "candidates")
    candidates = candidates.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"))
    key = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash"))
    # extend: the windows themselves
    near = base.join(small(candidates), key, "left_semi")
    at = near.select("doc_id", "text_hash", F.explode(let(words(F.col("text")), lambda f: F.concat(*[_windows(s)(f) for s in spans]))).alias("w"))
    hit = at.select("doc_id", "text_hash", "w.span", "w.start", "w.window").join(small(windows, "window", "items"), ["span", "window"])
    places = F.array_sort(F.collect_set(F.struct("start", "span")))
    per_doc = hit.groupBy("doc_id", "text_hash").agg(places.alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            F.greatest(acc["end"], p["start"] + p["span"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), p["start"] + p["span"] - F.greatest(acc["end"], p["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    per_doc = per_doc.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), covered.cast("long").alias("n_hit"), "items")
    out = counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; texts are not shuffled while the list of the others is small."""
    bad = decontaminate(docs, benchmark, text_col, id_col).filter(is_contaminated()).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    key = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash"))
    return unnested(nested(docs, text_col, id_col).join(small(written(bad, "contaminated")), key, "left_anti"), docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))
