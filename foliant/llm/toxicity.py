"""Operator 2, toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps letters that look alike (accents, Cyrillic and Greek twins, wide
forms) and digits and signs that stand for letters to one class each, joins
spelled-out words (l-i-k-e t-h-i-s), and leaves words between single spaces.
The lexicon holds whole words and word beginnings with their log-odds weights,
learned from labelled rows: an entry must be frequent among toxic rows, rare
among others, and stand in several contexts, so that copies of one text do not
make its words toxic. A match inside an exception phrase does not count: a phrase
of the match and the one or two words before or after it that stands in several
rows that are not toxic and in no toxic one. The weights are summed and normalised
by length (in words, smoothed), and a logistic curve gives the score.

Training reads at most SAMPLE labelled rows of SAMPLE_CHARS characters in all, the
ones with the smallest id hashes, so its cost does not grow with the input; the
lexicon and the exceptions are all that this sample gives, without further limits.
Of rows that repeat a labelled id with other texts the one of the smallest text
hash is read, of labels that repeat an id the highest. Null and empty texts score
as texts without matches; very long texts are scored whole. Repeated rows are
scored one by one, null ids stay null, other columns of any name are not read, an
empty table gives no rows; with no labelled rows, or only one kind of them, every
score is the share of toxic rows (0 if none). Ties: of entries that begin at the
same word the longest counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import crc_mod, small_batches, texts

#: Labelled rows that training reads, at most, and their characters in all (one row is always read).
SAMPLE, SAMPLE_CHARS = 12_000, 256 << 20
#: Word beginnings have 4 to 9 letters.
PREFIXES = range(4, 10)
#: Entries that a task holds at once.
FLUSH = 200_000
#: An entry's rows with label 1, at least; its contexts, at least; and its precision.
SUPPORT, CONTEXTS, PRECISION = 5, 4, 0.6
#: What a longer entry's weight must add to a shorter beginning of it.
GAIN = 0.7
#: Rows without label 1 that make a phrase an exception; words of it on one side of the match.
EXCEPTION_ROWS, EXCEPTION_WORDS = 3, 2

# letters that look like a Latin one (fixed values: Unicode confusables of Cyrillic and Greek)
_TWINS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "η": "n", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "b", "ø": "o", "ł": "i", "đ": "d"}
_DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i", "|": "i"}
_SIGN = {"@": "a", "$": "s", "!": "i", "€": "e", "£": "i", "+": "t"}
_SIGNS = re.compile(r"(?<=\w)[@$!€£+](?=\w)|(?<!\w)[@$](?=[a-z]{2})")
_SPELLED = re.compile(r"(?<!\w)(?:\w[.\-_*· ]){3,}\w(?!\w)")
_ASCII = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(k): v for k, v in _DIGITS.items()}
_TABLE = _ASCII | {ord(k): v for k, v in _TWINS.items()} | {i: None for i in (*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)} | {i: " " for i in (*range(0x80, 0xAA), *range(0x2010, 0x2060), *range(0x3000, 0x3020))}


def fold(text: str) -> str:
    """' word word ... ' in folded letters."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = _SIGNS.sub(lambda m: _SIGN[m[0]], text)
    text = _SPELLED.sub(lambda m: re.sub(r"[.\-_*· ]", "", m[0]), text)
    return f" {' '.join(text.translate(_TABLE).split())} "


def folded_lexicon(entries: list[str]) -> list[str]:
    return [fold(e) for e in entries]


@dataclass
class Lexicon:
    """Entries (' begin' or ' word ') with weights, exceptions (entry, side, words), and the curve of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, int, str]] = frozenset()
    curve: tuple[float, float] = (-50.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry in self.weights:
            found.add_word(entry, entry)
        if self.weights:
            found.make_automaton()
        return found if self.weights else None

    def matches(self, folded: str, automaton) -> Iterator[tuple[str, str, str]]:
        """(entry, word before, word after) of each match."""
        if automaton is None:
            return
        last = None  # of the entries that begin a word the longest counts
        for end, entry in automaton.iter(folded):
            start = end - len(entry) + 1
            if last and last[0] != start:
                yield self._placed(folded, *last)
            last = start, end, entry
        if last:
            yield self._placed(folded, *last)

    @staticmethod
    def _placed(folded: str, start: int, end: int, entry: str) -> tuple[str, str, str]:
        stop = end if entry[-1] == " " else folded.find(" ", end)
        before = after = ""
        at = start
        for _ in range(EXCEPTION_WORDS):
            if at <= 0:
                break
            at = folded.rfind(" ", 0, at)
            before = folded[at + 1 : start]
        at = stop
        for _ in range(EXCEPTION_WORDS):
            if at < 0 or at + 1 >= len(folded):
                break
            at = folded.find(" ", at + 1)
            after = folded[stop + 1 : at]
        return entry, before, after

    @staticmethod
    def phrases(before: str, after: str) -> Iterator[tuple[int, str]]:
        """(side, words) of the phrases that a match may be in: its neighbour, and its two neighbours."""
        if before:
            yield 0, before
            if " " in before:
                yield 0, before[before.rfind(" ") + 1 :]
        if after:
            yield 1, after
            if " " in after:
                yield 1, after[: after.find(" ")]

    def weight(self, found: Counter) -> float:
        """The summed weights of the matches that stand in no exception phrase."""
        total = 0.0
        for (entry, before, after), n in found.items():
            if not (self.exceptions and any((entry, *p) in self.exceptions for p in self.phrases(before, after))):
                total += n * self.weights[entry]
        return total

    @staticmethod
    def normalised(total: float, words: int) -> float:
        return math.log1p(100 * total / (words + 20))

    def feature(self, folded: str, automaton) -> float:
        return self.normalised(self.weight(Counter(self.matches(folded, automaton))), folded.count(" ") - 1)

    def score(self, x: float) -> float:
        z = self.curve[0] + self.curve[1] * x
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _entries_of(word: str) -> Iterator[str]:
    yield f" {word} "
    for k in PREFIXES:
        if len(word) > k:
            yield f" {word[:k]}"


def _toxic_entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that hold an entry, and some words before it; a task keeps at most FLUSH entries at once."""
    rows: dict[str, list] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(e, r[0], list(r[1])) for e, r in rows.items()], columns=["entry", "n", "contexts"])
        rows.clear()
        return out

    for pdf in frames:
        for text in pdf["text"]:
            seen: set[str] = set()
            before = ""
            for word in fold(text).split():
                if len(word) > 2:
                    for e in _entries_of(word):
                        r = rows.setdefault(e, [0, set()])
                        if e not in seen:
                            seen.add(e)
                            r[0] += 1
                        if len(r[1]) < CONTEXTS:
                            r[1].add(before)
                before = word
            if len(rows) > FLUSH:
                yield flush()
    yield flush()


def _other_entries(wanted: frozenset[str]):
    """Rows that hold each of the wanted entries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: Counter = Counter()
        for pdf in frames:
            for text in pdf["text"]:
                rows.update({e for word in set(fold(text).split()) if len(word) > 2 for e in _entries_of(word)} & wanted)
        yield pd.DataFrame(rows.items(), columns=["entry", "n"])

    return run


def chosen_entries(sample: DataFrame, n0: int, n1: int) -> dict[str, float]:
    """The lexicon's weights: what toxic rows hold often enough, weighed against the other rows."""
    toxic = sample.filter("label = 1").mapInPandas(_toxic_entries, "entry string, n long, contexts array<string>")
    toxic = toxic.groupBy("entry").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts"))
    frequent = toxic.filter((F.col("n") >= SUPPORT) & (F.col("contexts") >= CONTEXTS))
    have = {r["entry"]: r["n"] for r in frequent.select("entry", "n").collect()}  # of the bounded sample
    others = sample.filter("label = 0").mapInPandas(_other_entries(frozenset(have)), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    other = {r["entry"]: r["n"] for r in others.collect()}  # entries of `have` only
    good = [(e, n, other.get(e, 0)) for e, n in have.items() if n >= PRECISION * (n + other.get(e, 0))]
    found: dict[str, float] = {}
    for e, a, b in sorted(good, key=lambda g: (len(g[0]), g[0])):
        weight = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        shorter = max((found[e[:k]] for k in range(5, len(e)) if e[:k] in found), default=-math.inf)
        if weight > max(shorter + GAIN, 0):
            found[e] = weight
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept first) by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, most: int, size: Column, most_size: int) -> DataFrame:
    """(text, label): at most `most` labelled ids outside the held-out fold, one text each, of `most_size` in all.

    The ids are broadcast (bounded by `most`). The sizes are added up in the order
    of the ids' hashes; rows from where the sum passes most_size are not read, but
    for the first row of each label.
    """
    train = labels.filter(F.col(column).isin(0, 1) & (crc_mod("doc_id", modulus) != held_out) & F.col("doc_id").isNotNull())
    train = train.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(column).cast("int").alias("label"))
    chosen = train.orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("l_id", "label", "text", size.cast("long").alias("size"))
    order = (F.xxhash64("l_id"), "l_id")
    sizes = rows.groupBy("l_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "size")).alias("s"))  # `most` rows
    sizes = sizes.withColumn("upto", F.sum("s.size").over(W.orderBy(*order))).withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy(*order)))
    read = sizes.filter((F.col("upto") <= most_size) | (F.col("nth") == 1)).select(F.col("l_id").alias("r_id"), F.col("s.hash").alias("r_hash"))
    once = rows.join(F.broadcast(read), (F.col("l_id") == F.col("r_id")) & (F.xxhash64("text") == F.col("r_hash")))
    return once.groupBy("l_id").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, most: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Lexicon:
    from foliant.session import written

    small_batches(docs.sparkSession)
    sample = written(labelled(docs, labels, "toxic", modulus, held_out, most, F.length("text"), most_chars), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        rate = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Lexicon(curve=(math.log(rate / (1 - rate)) if 0 < rate < 1 else 50.0 * (2 * rate - 1), 0.0))
    lexicon = Lexicon(chosen_entries(sample, n0, n1))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The matches of each sample row, as one list: exceptions and the curve both come from them."""
        automaton = lexicon.automaton()
        for pdf in frames:
            rows = []
            for t, y in zip(pdf["text"], pdf["label"]):
                folded = fold(t)
                found = Counter(lexicon.matches(folded, automaton))
                rows.append((int(y), folded.count(" ") - 1, [{"entry": e, "before": b, "after": a, "n": n} for (e, b, a), n in found.items()]))
            yield pd.DataFrame(rows, columns=["label", "words", "found"])

    seen = sample.mapInPandas(look, "label int, words int, found array<struct<entry:string,before:string,after:string,n:int>>").toPandas()  # of the bounded sample
    rows = [(y, w, Counter({(m["entry"], m["before"], m["after"]): m["n"] for m in found})) for y, w, found in zip(seen["label"], seen["words"], seen["found"])]
    near = {0: Counter(), 1: Counter()}
    for y, _, found in rows:
        near[y].update({(e, *p) for e, before, after in found for p in Lexicon.phrases(before, after)})
    lexicon.exceptions = frozenset(p for p, n in near[0].items() if n >= EXCEPTION_ROWS and p not in near[1])
    x = np.array([lexicon.normalised(lexicon.weight(found), w) for _, w, found in rows])
    lexicon.curve = tuple(logistic(x[:, None], seen["label"].to_numpy()).tolist())
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score: one row per row of docs."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": [lexicon.score(lexicon.feature(fold(t), automaton)) for t in pdf["text"]]})

    return texts(docs).mapInPandas(run, "doc_id long, score double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(docs, fit(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
