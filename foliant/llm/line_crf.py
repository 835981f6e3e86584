"""Operator 8, quality classifier: a linear-chain conditional random field over lines.

Every line of a document gets a good/bad label from features of itself and of
its neighbours; the chain's weights are learned by maximum conditional
likelihood with the document's label on each of its lines. Forward-backward
gives each line's marginal probability of being good; their mean, weighted by
length, is the document's quality, and a logistic curve fitted on the training
rows turns it into the score.

Line features are counts of character classes, taken for all lines of a batch at
once, and a few of words. Training reads at most SAMPLE labelled rows of
SAMPLE_LINES lines in all, the ones with the smallest id hashes; of rows that
repeat a labelled id with other texts the one of the smallest text hash, of labels
that repeat an id the highest. A null or empty text is one empty line; very long
texts are scored whole, and a batch is worked off in parts of about a million
characters. Repeated rows are scored one by one, null ids stay null, other columns
of any name are not read, an empty table gives no rows; with no labelled rows, or
only one kind of them, every score is the share of good rows (0 if none). Ties: a
document whose lines are as good as bad scores by the curve alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import crc_mod, small_batches, split_rows, texts
from foliant.llm.toxicity import labelled, logistic

#: Labelled rows that training reads, at most, and their lines in all (one row of each label is always read).
SAMPLE, SAMPLE_LINES = 5_000, 400_000
ROUNDS, RATE, RIDGE = 150, 0.2, 1e-3
MARKS = b"#*$%&|<>{}\\^~=_+@"
_CLASSES = np.zeros((256, 7), np.float32)
for _c in range(256):
    _ch = chr(_c)
    _CLASSES[_c] = (_c < 128 and _ch.islower(), _c < 128 and _ch.isupper(), 48 <= _c < 58, _c in MARKS, _ch in ".,;:?'\"()-" and _c < 128, _ch == "!", 128 <= _c < 192)
BASE = 12


def line_features(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (with those of its neighbours), lengths of lines, lines of each document."""
    lines = [t.split("\n") for t in docs]
    n_lines = np.array([len(x) for x in lines])
    raw = [x.encode("utf-8", "surrogatepass") + b"\n" for t in lines for x in t]
    size = np.array([len(x) for x in raw])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    data = np.frombuffer(b"".join(raw), np.uint8)
    counts = np.stack([np.add.reduceat(_CLASSES[:, k][data], starts) for k in range(7)], axis=1)
    length = (size - 1).astype(np.float64)
    share = counts / np.maximum(length, 1)[:, None]
    words = [x.split() for x in raw]
    n_words = np.array([len(w) for w in words], float)
    kinds = np.array([len(set(w)) for w in words], float)
    marked = np.array([sum(not 48 <= w[-1] < 58 and w[-1] in MARKS or w[-1] == 33 for w in ws) for ws in words], float)
    variety = np.where(n_words > 0, kinds / np.maximum(n_words, 1), 1.0)
    # long lines repeat words by chance; what a text of this length has is the scale
    expected = np.maximum(n_words, 1) ** -0.15
    base = np.column_stack([
        np.log1p(length) / 5,
        np.minimum(share[:, 3] * 10, 3),
        np.minimum(share[:, 1] * 4, 3),
        np.minimum(share[:, 2] * 8, 3),
        np.minimum(share[:, 5] * 20, 3),
        np.minimum(marked / np.maximum(n_words, 1) * 4, 4),
        np.clip(expected - variety, 0, 1) * 4,
        (variety < 0.5 * expected) & (n_words >= 8),
        share[:, 1] > 0.3,
        np.minimum(length / np.maximum(n_words, 1) / 8, 3),
        n_words < 1,
        np.minimum(share[:, 4] * 5, 2),
    ]).astype(np.float64)
    first = np.zeros(len(raw), bool)
    first[np.concatenate([[0], np.cumsum(n_lines)[:-1]])] = True
    last = np.roll(first, -1)
    before, after = np.roll(base, 1, axis=0), np.roll(base, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([np.ones(len(raw)), first, last, base, before, after]), np.maximum(length, 1), n_lines


WIDTH = 3 + 3 * BASE


def _by_step(n_lines: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Documents by falling number of lines, and how many of them have a line t."""
    order = np.argsort(-n_lines, kind="stable")
    alive = np.bincount(n_lines, minlength=n_lines.max() + 2)
    return order, (len(n_lines) - np.cumsum(alive)[:-1]).tolist()


def marginals(emit: np.ndarray, n_lines: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2 x 2) and the log of the partition functions' product.

    emit: the score of "good" over "bad" of each line; move: log weights of transitions.
    """
    order, alive = _by_step(n_lines)
    start = np.concatenate([[0], np.cumsum(n_lines)[:-1]])[order]
    steps = int(n_lines.max())
    alpha, z = np.empty((len(emit), 2)), 0.0
    weight = np.exp(move)
    # scaled forward: alpha sums to one at each line
    score = np.column_stack([np.zeros(len(emit)), emit])
    top = score.max(axis=1)
    e = np.exp(score - top[:, None])
    z += top.sum()
    scale = np.empty(len(emit))
    for t in range(steps):
        at = start[: alive[t]] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ weight) * e[at]
        s = a.sum(axis=1)
        alpha[at], scale[at] = a / s[:, None], s
    z += np.log(scale).sum()
    beta = np.ones((len(emit), 2))
    moves = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = start[: alive[t]] + t
        right = e[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = right @ weight.T
        moves += weight * (alpha[at - 1].T @ right)
    good = alpha[:, 1] * beta[:, 1]
    return good / np.maximum(good + alpha[:, 0] * beta[:, 0], 1e-300), moves, z


@dataclass
class LineCrf:
    weights: np.ndarray
    move: np.ndarray
    curve: tuple[float, float]

    def quality(self, docs: list[str]) -> np.ndarray:
        """The length-weighted mean marginal of each document."""
        x, length, n_lines = line_features(docs)
        good, _, _ = marginals(x @ self.weights, n_lines, self.move)
        first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
        return np.add.reduceat(good * length, first) / np.add.reduceat(length, first)

    def score(self, docs: list[str]) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * _logit(self.quality(docs))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(x: np.ndarray, n_lines: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient steps on the conditional likelihood, every document with the same weight."""
    y = np.repeat(label, n_lines).astype(float)
    share = np.repeat(1 / n_lines, n_lines)  # of a line in its document
    weights, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    inner = np.ones(len(y), bool)
    inner[first] = False
    seen = np.zeros((2, 2))
    for s in (0, 1):
        seen[s, s] = (inner & (y == s)).sum()
    for r in range(1, rounds + 1):
        good, moves, _ = marginals(x @ weights, n_lines, move)
        g = np.concatenate([x.T @ ((y - good) * share) / len(label) - RIDGE * weights, (seen - moves).ravel() / max(inner.sum(), 1) - RIDGE * 10 * move.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8) * min(1.0, 4 * (1 - r / (rounds + 1)))
        weights += step[: len(weights)]
        move += step[len(weights) :].reshape(2, 2)
        move = np.clip(move, -1.5, 1.5)  # labels hold for whole documents: keep the chain from sticking
    return weights, move


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, most: int = SAMPLE, most_lines: int = SAMPLE_LINES) -> LineCrf:
    small_batches(docs.sparkSession)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sample = labelled(docs, labels, "quality", modulus, held_out, most, lines, most_lines)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in split_rows(iter([pdf]), 1 << 20):
                x, _, n_lines = line_features(part["text"].tolist())
                end = np.cumsum(n_lines)
                cut = [x[e - n : e].astype(np.float32).tobytes() for e, n in zip(end, n_lines)]
                yield pd.DataFrame({"label": part["label"].to_numpy(), "x": cut})

    # `most` rows of `most_lines` lines at most; copies, which have the same features, count once
    got = sample.mapInPandas(run, "label int, x binary").toPandas()
    got = got.drop_duplicates("x").sort_values("x", kind="stable")
    label = got["label"].to_numpy()
    if not len(got) or label.min() == label.max():
        rate = float(label.mean()) if len(got) else 0.0
        return LineCrf(np.zeros(WIDTH), np.zeros((2, 2)), (50.0 * (2 * rate - 1), 0.0))
    parts = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]]
    n_lines = np.array([len(p) for p in parts])
    x = np.concatenate(parts).astype(float)
    weights, move = train(x, n_lines, label)
    good, _, _ = marginals(x @ weights, n_lines, move)
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    size = np.maximum(np.expm1(x[:, 3] * 5), 1)
    mean = np.add.reduceat(good * size, first) / np.add.reduceat(size, first)
    return LineCrf(weights, move, tuple(logistic(_logit(mean)[:, None], label).tolist()))


def score_quality(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id, score: one row per row of docs."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in split_rows(frames, 1 << 20):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": model.score(pdf["text"].tolist())})

    return texts(docs).mapInPandas(run, "doc_id long, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, fit(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
