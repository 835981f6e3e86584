"""Operator 12, vector code compression: product codes over deduplicated parts.

Components become integers, floor(1024 x), and vectors PARTS consecutive parts. Per
part position equal parts become one weighted row (Spark aggregation with map-side
combine, so a vector that very many rows share counts once). Over these distinct
rows weighted Lloyd runs: the tasks assign rows to the nearest entry (squared
Euclidean distance, ties to the lower index) and hand on sums and counts of each
entry, never rows; the driver sees PARTS x ENTRIES sums a round. After the last round
the distinct rows get codes and errors, which are joined back to the vectors: parts
with more than HOT rows by a broadcast of measured size, all others by a shuffle
(as are the error sums of labels).

Distances are exact: floating products where all sums stay below 2^53, integers
otherwise. Defined results: vectors that are null, hold a null or non-finite
component, are empty, of a length not divisible by PARTS or of another length than
the first one (by vec_id, nulls last, then components) of those left are dropped.
Integers saturate at +-2^24 (components beyond 16,384). Fewer than ENTRIES vectors
give fewer entries; equal vec_ids are ordered by their components, null ids come
last and stay null; repeated rows are returned each; null labels are one label.
Other columns of any name are not read; an empty table, or one without a usable
vector, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import small
from foliant.session import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 24
#: Rows of one key beyond which it is joined by broadcast.
HOT = 20_000
#: Rows whose distances are in memory at once.
BLOCK = 4096


def integers(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """(rid, vec_id, label, parts) of the kept vectors, written, and the components of a part."""
    x = F.col("x")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vec_col].cast("array<double>").alias("x"))
    rows = rows.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), c)) * SCALE))).cast("int"))
    rows = rows.select("vec_id", "label", whole.alias("x"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).select(F.size("x").alias("n")).collect()
    width = first[0]["n"] if first else parts
    rows = rows.filter(F.size(x) == width)
    # the narrowest type that holds all components: half the bytes in most tables
    most = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0] or 0
    each = width // parts
    cut = F.array(*[F.slice(x, k * each + 1, each).cast("array<smallint>" if most < 1 << 15 else "array<int>") for k in range(parts)])
    return written(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", cut.alias("parts")), "vectors"), each


def exploded(kept: DataFrame) -> DataFrame:
    return kept.select("rid", "vec_id", "label", F.posexplode("parts").alias("pos", "part"))


def distinct_parts(kept: DataFrame) -> DataFrame:
    """(pos, part, weight): equal parts of a position as one row."""
    return exploded(kept).groupBy("pos", "part").agg(F.count("*").alias("weight"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row; ties go to the lower index."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64
    book = book.astype(kind)
    square = (book * book).sum(axis=1)
    entry, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        rows = x[at : at + BLOCK].astype(kind)
        away = square - 2 * (rows @ book.T)
        best = away.argmin(axis=1)
        entry[at : at + BLOCK] = best
        error[at : at + BLOCK] = away[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
    return entry, error


def _by_position(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, indexes of its rows, their parts as a matrix)."""
    pos = pdf["pos"].to_numpy()
    for p in np.unique(pos).tolist():
        at = np.flatnonzero(pos == p)
        yield p, at, np.stack(pdf["part"].iloc[at].to_list()).astype(np.int64)


def entry_sums(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(pos, entry, dim, total): weighted sums of the parts of each entry; dim -1 is their number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((books.shape[0], books.shape[1], books.shape[2] + 1), np.int64)
        for pdf in frames:
            weight = pdf["weight"].to_numpy()
            for p, at, x in _by_position(pdf):
                entry, _ = nearest(x, books[p])
                order = np.argsort(entry, kind="stable")
                found, first = np.unique(entry[order], return_index=True)
                w = weight[at][order][:, None]
                sums[p, found] += np.add.reduceat(np.hstack([x[order] * w, w]), first, axis=0)
        p, e = np.nonzero(sums[:, :, -1])
        dims = np.r_[np.arange(books.shape[2]), -1]
        yield pd.DataFrame({"pos": np.repeat(p, len(dims)), "entry": np.repeat(e, len(dims)), "dim": np.tile(dims, len(p)), "total": sums[p, e].ravel()})

    return distinct.mapInPandas(run, "pos int, entry int, dim int, total long").groupBy("pos", "entry", "dim").agg(F.sum("total").alias("total"))


def codebooks(kept: DataFrame, distinct: DataFrame, each: int, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> np.ndarray:
    """(parts x entries x components) after weighted Lloyd."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    books = np.array([r["parts"] for r in first], np.int64).reshape(len(first), parts, each).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        got = entry_sums(distinct, books).toPandas()  # parts x entries x (components + 1) at most
        sums = np.zeros((books.shape[0], books.shape[1], each + 1), np.int64)
        sums[got["pos"], got["entry"], got["dim"]] = got["total"]
        n = sums[:, :, -1:]
        books = np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books)
    return books


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(pos, part, weight, code, part_error) of the distinct parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            code, error = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for p, at, x in _by_position(pdf):
                code[at], error[at] = nearest(x, books[p])
            yield pdf.assign(code=code, part_error=error)

    kind = distinct.schema["part"].dataType.simpleString()
    return distinct.mapInPandas(run, f"pos int, part {kind}, weight long, code int, part_error long")


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """rows with what `found` (unique by keys, with the rows of each key) holds: hot keys by broadcast, the others by shuffle."""
    values = [c for c in found.columns if c not in (*keys, weight)]
    marked = found.select(*keys, *values, F.lit(True).alias("is_hot"), weight)
    hot = small(marked.filter(F.col(weight) > HOT).drop(weight), *keys)
    seen = rows.join(hot, keys, "left")
    rest = seen.filter("is_hot is null").select(*rows.columns).join(found.filter(F.col(weight) <= HOT).select(*keys, *values), keys)
    return seen.filter("is_hot").select(*rows.columns, *values).unionByName(rest.select(*rows.columns, *values))


def compress(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes array<int>, error, label_error), one row per kept vector, and the codebooks."""
    kept, each = integers(vectors, vec_col, id_col, label_col, parts)
    distinct = written(distinct_parts(kept), "parts")
    books = codebooks(kept, distinct, each, entries, rounds, parts)
    known = written(coded(distinct, books), "codes")
    rows = looked_up(exploded(kept), known, ["pos", "part"])
    code = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda c: c["code"])  # `parts` of a row
    codes = written(rows.groupBy("rid", "vec_id", "label").agg(code.alias("codes"), F.sum("part_error").alias("error")), "coded")
    discard(kept, distinct, known)
    of_label = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("l_key"), F.col("label").isNull().alias("l_null")]
    sums = codes.groupBy(*of_label).agg(F.count("*").alias("weight"), F.sum("error").alias("label_error"))
    out = looked_up(codes.select("vec_id", "label", "codes", "error", *of_label), sums, ["l_key", "l_null"])
    return out.select("vec_id", "label", "codes", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    return f"""
near{k} AS MATERIALIZED (
  SELECT p.pos, p.part, p.weight, arg_min(b.entry, b.square - 2 * list_dot_product(p.part, b.part) + b.entry / 1024.0) AS entry
  FROM parts p JOIN book{k} b ON p.pos = b.pos GROUP BY ALL),
mean{k} AS MATERIALIZED (
  SELECT pos, entry, list(x ORDER BY i) AS part FROM (
    SELECT pos, entry, i, floor(sum(part[i] * weight) / sum(weight)) AS x FROM near{k}, (SELECT unnest(range(1, (SELECT any_value(len(part)) FROM parts) + 1)) AS i) n GROUP BY ALL) q
  GROUP BY ALL),
book{k + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part, list_dot_product(coalesce(m.part, b.part), coalesce(m.part, b.part)) AS square
  FROM book{k} b LEFT JOIN mean{k} m ON b.pos = m.pos AND b.entry = m.entry)"""


VECTOR_CODES_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS rid, * FROM v),
e AS MATERIALIZED (
  SELECT rid, vec_id, label, pos, x[pos * len(x) // {PARTS} + 1:(pos + 1) * len(x) // {PARTS}] AS part
  FROM r, (SELECT unnest(range(0, {PARTS})) AS pos) k),
parts AS MATERIALIZED (SELECT pos, part, count(*) AS weight FROM e GROUP BY ALL),
book0 AS MATERIALIZED (SELECT pos, rid - 1 AS entry, part, list_dot_product(part, part) AS square FROM e WHERE rid <= {ENTRIES}),
{",".join(_round(k) for k in range(ROUNDS))},
last AS MATERIALIZED (
  SELECT p.pos, p.part, arg_min(b.entry, b.square - 2 * list_dot_product(p.part, b.part) + b.entry / 1024.0) AS entry,
    min(b.square - 2 * list_dot_product(p.part, b.part) + list_dot_product(p.part, p.part)) AS error
  FROM parts p JOIN book{ROUNDS} b ON p.pos = b.pos GROUP BY ALL),
coded AS MATERIALIZED (
  SELECT rid, vec_id, label, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY pos) AS code, sum(error)::BIGINT AS error
  FROM e JOIN last USING (pos, part) GROUP BY ALL),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(part, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""
