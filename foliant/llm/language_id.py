"""Operator 11, language identification: bit-sliced Bloom filters over n-grams.

A text is folded to lower-case words between boundaries (everything that is no
letter parts words), and its n-grams of 2 to 4 places, none across two words, are
hashed. One table holds the Bloom filters of all languages, sliced by bit: a row
of it is a mask with one bit a language, and an n-gram belongs to the languages
whose bit is set in all of its PROBES rows, found by one AND for all languages.
For a text the bits are counted by language; from the share of set bits of a
language's slice follows how many n-grams seem known by chance, and the count is
corrected for them. The language with the highest corrected count wins, and its
part of all corrected counts is the score.

A language's filter holds the n-grams that stand in MIN_DOCS or more of its
training texts and in a share SHARE of them at least, so that single
foreign words and wrong labels leave no trace. Training reads at most SAMPLE rows of each language, of
SAMPLE_CHARS characters in all (one row always), the ones of the smallest id
hashes. N-grams are counted and the slices combined by Spark; the driver gets the
finished table of ROWS masks.

Defined results: `und` and 0 for a null text or one without a letter; a text none of
whose n-grams is known, the language of the most sampled characters and 0; ties, the
language with more of them, then the one that sorts first. Null ids stay null (and count as the empty string for the fold), rows
without a language are not learned from, repeated rows are scored one by one and
learned from once. Very long texts are worked off whole, in segments cut between
words. Other columns of any name are not read. An empty table gives no rows; with
nothing to learn from every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import crc_mod, small, small_batches, split_rows

#: Training rows of a language, at most, and their characters in all.
SAMPLE, SAMPLE_CHARS = 4_000, 8 << 20
#: Texts of a language that must hold an n-gram: at least so many, and at least this share.
MIN_DOCS, SHARE = 2, 0.05
#: Places of an n-gram; rows of the table (a power of two); rows that an n-gram probes.
SIZES, ROWS, PROBES = (2, 3, 4), 1 << 20, 3
#: Characters of a segment, and of the texts worked off at once.
SEGMENT = 1 << 20
#: Low bits of an id's hash that its range leaves out: 65,536 ranges.
RANGE_BITS = 48
_WORD_BITS = 63  # languages in one mask: Spark's long has a sign
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a worker."""
    if not _LETTERS:
        _LETTERS.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool))
    return _LETTERS[0]


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in segments cut at spaces, which part words anyway."""
    at = 0
    while len(text) - at > size and (cut := text.find(" ", at + size)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(texts: list[str], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the text) of every n-gram, and whether each text has a letter."""
    lower = [t.lower() for t in texts]
    data = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])
    letter = letters()[np.minimum(data, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first place after a word is its end
    code, owner = np.where(letter, data, 0)[keep].astype(np.uint64), owner[keep]
    code, owner = np.concatenate([[np.uint64(0)], code]), np.concatenate([[0], owner])
    has = np.zeros(len(lower), bool)
    has[owner[code > 0]] = True
    hashes, owners = [], []
    for n in sizes:
        last = len(code) - n + 1
        if last <= 0:
            continue
        h, whole = np.full(last, n, np.uint64), np.ones(last, bool)
        for j in range(n):
            part = code[j : j + last]
            h = h * np.uint64(0x100000001B3) + part
            if 0 < j < n - 1:
                whole &= part > 0
        hashes.append(_mixed(h[whole]))
        owners.append(owner[1 : 1 + last][whole])  # the second place is in the word, or its end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


def probes(h: np.ndarray, rows: int = ROWS) -> list[np.ndarray]:
    """The rows of the table that each hash probes."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(rows - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass
class LanguageFilters:
    languages: list[str]
    slices: np.ndarray  # rows x words of masks
    sampled: list[int]  # characters of each language that were learned from: they break ties

    def __post_init__(self) -> None:
        rows = len(self.slices)
        fill = [float(np.count_nonzero(self._bit(self.slices, j))) / rows for j in range(len(self.languages))]
        self.chance = np.array(fill) ** PROBES

    @staticmethod
    def _bit(masks: np.ndarray, j: int) -> np.ndarray:
        return (masks[:, j // _WORD_BITS] >> np.uint64(j % _WORD_BITS)) & np.uint64(1)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x languages) of known n-grams, n-grams of each text, and whether it has a letter."""
        known = np.zeros((len(texts), len(self.languages)))
        total, has = np.zeros(len(texts)), np.zeros(len(texts), bool)
        parts, owners, size = [], [], 0
        for k, text in enumerate(texts):
            for segment in segments(text):
                parts.append(segment)
                owners.append(k)
                size += len(segment)
                if size >= SEGMENT:
                    self._count(parts, np.array(owners), known, total, has)
                    parts, owners, size = [], [], 0
        if parts:
            self._count(parts, np.array(owners), known, total, has)
        return known, total, has

    def _count(self, parts: list[str], owners: np.ndarray, known: np.ndarray, total: np.ndarray, has: np.ndarray) -> None:
        h, at, letter = gram_hashes(parts)
        np.logical_or.at(has, owners, letter)
        if not len(h):
            return
        first, *more = probes(h, len(self.slices))
        masks = self.slices[first]
        for rows in more:
            masks &= self.slices[rows]
        total += np.bincount(owners[at], minlength=len(total))
        for j in range(len(self.languages)):
            known[:, j] += np.bincount(owners[at], weights=self._bit(masks, j), minlength=len(total))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        known, total, has = self.counts(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        sure = np.maximum((known - total[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9), 0)
        order = np.argsort(-np.array(self.sampled), kind="stable")  # of equal counts the first in this order wins
        whole, best = sure.sum(axis=1), order[sure[:, order].argmax(axis=1)]
        score = np.where(has & (whole > 0), sure[np.arange(len(texts)), best] / np.maximum(whole, 1e-300), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, has)], score


def training_sample(docs: DataFrame, modulus: int = 4, held_out: int = 2, most: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, text): of each language the rows of the smallest id hashes, repeated rows once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod("id", modulus) != held_out))
    rows = rows.select("lang", "text", F.xxhash64("id").alias("order"), F.shiftright(F.xxhash64("id"), RANGE_BITS).alias("range"), F.xxhash64("id", "text").alias("key"), F.length("text").cast("long").alias("size"))
    # whole ranges of the hash come first, by their counts, so that no task sees more of a language than the last range adds
    sized = rows.groupBy("lang", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = small(sized.select("lang", "range", before.alias("before")).filter(F.col("before") < most).drop("before"), "lang")
    by = W.partitionBy("lang").orderBy("order", "key")
    first = rows.drop("text").join(ranges, ["lang", "range"]).withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= most)
    first = first.withColumn("upto", F.sum("size").over(by.rowsBetween(W.unboundedPreceding, 0))).filter((F.col("upto") <= most_chars) | (F.col("nth") == 1))
    chosen = small(first.select("lang", "key").distinct(), "lang")  # `most` rows of each language
    return rows.join(chosen, ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text")


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, docs): texts of each language that hold a gram."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in split_rows(frames, SEGMENT):
            for lang, part in pdf.groupby("lang"):
                h, at, _ = gram_hashes(part["text"].tolist())
                order = np.lexsort((at, h))
                h, at = h[order], at[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
                gram, n = np.unique(h[fresh], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "docs": n})

    return sample.mapInPandas(run, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2, most: int = SAMPLE, most_chars: int = SAMPLE_CHARS, rows: int = ROWS) -> LanguageFilters:
    from foliant.session import discard, written

    small_batches(docs.sparkSession)
    sample = written(training_sample(docs, modulus, held_out, most, most_chars), "languages")
    sizes = {r["lang"]: (r["n"], r["size"]) for r in sample.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()}  # one row a language
    languages = sorted(sizes)
    words = max(1, -(-len(languages) // _WORD_BITS))
    slices = np.zeros((rows, words), np.uint64)
    if languages:
        needs = sample.sparkSession.createDataFrame([(x, k // _WORD_BITS, 1 << k % _WORD_BITS, float(max(min(MIN_DOCS, sizes[x][0]), SHARE * sizes[x][0]))) for k, x in enumerate(languages)], "lang string, word int, mask long, least double")
        grams = gram_counts(sample).join(F.broadcast(needs), "lang").filter(F.col("docs") >= F.col("least"))
        grams = grams.groupBy("gram", "word").agg(F.expr("bit_or(mask)").alias("mask"))

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                h = pdf["gram"].to_numpy().astype(np.int64).view(np.uint64)
                yield pd.concat([pd.DataFrame({"place": at, "word": pdf["word"], "mask": pdf["mask"]}) for at in probes(h, rows)])

        placed = grams.mapInPandas(place, "place long, word int, mask long").groupBy("place", "word").agg(F.expr("bit_or(mask)").alias("mask"))
        got = placed.toPandas()  # at most `rows` masks of each word
        slices[got["place"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().astype(np.int64).view(np.uint64)
    discard(sample)
    return LanguageFilters(languages, slices, [sizes[x][1] or 0 for x in languages])


def identify(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred, score: one row per row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS masks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in split_rows(frames, SEGMENT):
            lang, score = shared.value.predict(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": lang, "score": score})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInPandas(run, "doc_id long, lang_pred string, score double")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
