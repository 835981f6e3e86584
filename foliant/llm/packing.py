"""Operator 9, best-fit packing: a configuration linear program, rounded.

1. Every text is tokenized and given its end id; only a document longer than a
   sequence is cut, so that all its pieces but the first are full.
2. The pieces' lengths form a histogram (at most `capacity` rows, whatever the
   input). Over it the configuration program - least number of sequences, each
   filled by one configuration of lengths, all lengths covered - is solved by
   multiplicative weights: each round prices the lengths, an unbounded knapsack
   by dynamic programming finds the configuration worth most through each
   length, and the lengths that a used one covers lose weight. It goes on until
   all lengths are covered; the prices give a lower bound on the sequences.
   The program is told of the lengths above an eighth of a sequence; shorter pieces are kept to fill gaps.
3. Of the fractional solution the configurations that fill a sequence to the last
   token are rounded, fractions adding up from one to the next. A further program over what is left
   follows until one places little more; then the rest goes by best fit, longest
   first. A program that takes too much of what fills gaps would cost sequences: where the
   result has more of them than best fit alone, lengths above a fourth, a third and
   half of a sequence are tried, and the least is taken. All this works on counts, not on pieces.
4. Each piece gets its rank among the pieces of its length (a prefix sum over
   the counts of the tasks, so a length that holds a third of all pieces needs
   no task of its own), and the rank gives sequence and offset.

Null and empty texts are one piece with the end id alone; repeated rows are
packed one by one; an empty table gives no rows. The pieces are written to the
shared folder, so that counts and ranks speak of the same rows after a loss.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, split_rows, texts
from foliant.llm.tokens import encoder, vocabulary
from foliant.session import written

CAPACITY = 1024
END_ID = 2
#: Multiplicative weights: the share that lowers a price e times, the slack of a configuration that is used,
#: the distance from the dual bound that ends the program, and the pricings after which full cover does.
RATE, SLACK, GAP, ROUNDS = 0.4, 0.05, 0.01, 100
#: The parts of a sequence above which lengths are the program's; the share of what is left that a program must place
#: for another one to follow.
FILLERS, PLACED = (8, 4, 3, 2), 0.1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The pieces, with the task that made each and its place among that task's pieces of its length."""
    small_batches(docs.sparkSession)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, encode, nth = TaskContext.get().partitionId(), encoder(vocab).encode, Counter()
        for pdf in split_rows(frames, 1 << 21):
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], encode(pdf["text"].tolist())):
                ids = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), task, nth[n]))
                    nth[n] += 1
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return texts(docs, text_col, id_col).mapInPandas(make, PIECES)


def priced(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity the highest worth that fits and the last length taken: an unbounded knapsack (lengths ascend)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := upto[c]:
            gains = worth[:k] + value[c - lengths[:k]]
            if gains[i := int(gains.argmax())] > value[c]:
                value[c], choice[c] = gains[i], i
    return value, choice


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[Counter, float]], float]:
    """Configurations and how often each is used, covering the whole demand, and the dual bound on their number.

    A length's price is its size, lowered as its share of the demand is covered.
    One pricing gives the best configuration through every length; those that
    are still within SLACK of the best, at the prices that have fallen
    meanwhile, are used. It ends when every share has reached 1 after ROUNDS
    pricings, or every share is above 0 and the number is within GAP of the bound.
    """
    used: dict[tuple, float] = {}
    covered, total, bound, rounds = np.zeros(len(lengths)), 0.0, 0.0, 0
    while True:
        share = covered / demand
        price = lengths * np.exp(-(share - share.min()) / RATE)
        value, choice = priced(lengths, price, capacity)
        rounds += 1
        bound = max(bound, float(demand @ price / value[capacity]))  # prices over the best worth are a dual solution
        least, worth = (1 - SLACK) * value[capacity], price + value[capacity - lengths]
        for i in np.argsort(-worth, kind="stable").tolist():
            if worth[i] < least:
                break
            found, c = Counter([i]), capacity - int(lengths[i])
            while c > 0:
                if choice[c] < 0:
                    c -= 1
                else:
                    found[int(choice[c])] += 1
                    c -= int(lengths[choice[c]])
            items, amounts = np.fromiter(found, int), np.fromiter(found.values(), float)
            if price[items] @ amounts < least * (1 - 1e-12):
                continue
            step = RATE / 2 * float((demand[items] / amounts).min())
            covered[items] += step * amounts
            price[items] *= np.exp(-step * amounts / demand[items] / RATE)
            key = tuple(sorted(found.items()))
            used[key] = used.get(key, 0.0) + step
            total += step
        low = float((covered / demand).min())
        if low > 0 and (total / low <= bound * (1 + GAP) or (low >= 1 and rounds >= ROUNDS)):
            return [(Counter(dict(key)), x / low) for key, x in used.items()], bound


def rounded(solution: list[tuple[Counter, float]], demand: np.ndarray) -> tuple[list[tuple[Counter, int]], np.ndarray]:
    """Whole numbers of the configurations, none above the demand, and the demand that is left.

    Fractions add up from one configuration to the next, and what one cannot use goes to those after it.
    """
    left, carry, made = demand.astype(np.int64), 0.0, Counter()
    solution = sorted(solution, key=lambda p: -p[1])
    for turn in range(2):  # what is carried over at the end goes round once more
        for found, x in solution:
            carry += 0.0 if turn else x
            items, amounts = np.fromiter(found, int), np.fromiter(found.values(), np.int64)
            if times := min(int(carry + 1e-9), int((left[items] // amounts).min())):
                left[items] -= times * amounts
                carry -= times
                made[tuple(sorted(found.items()))] += times
    return [(Counter(dict(key)), times) for key, times in made.items()], left


Packed = list[tuple[list[int], int]]  # (lengths in one sequence, number of such sequences)


def best_fit(left: dict[int, int], capacity: int = CAPACITY) -> Packed:
    """The pieces (length -> number), longest first, each into the least gap that takes it."""
    left, open_bins = dict(left), {}  # gap -> [[lengths, count], ...]

    def add(filled: list[int], gap: int, count: int) -> None:
        open_bins.setdefault(gap, []).append([filled, count])

    for n in sorted(left, reverse=True):
        while left[n]:
            gap = min((g for g, bins in open_bins.items() if g >= n and bins), default=None)
            if gap is None:
                each = capacity // n
                whole, rest = divmod(left[n], each)
                if whole:
                    add([n] * each, capacity - each * n, whole)
                if rest:
                    add([n] * rest, capacity - rest * n, 1)
                left[n] = 0
                continue
            filled, count = open_bins[gap][-1]
            fit = gap // n  # pieces of this length that one such gap takes
            if count > left[n] // fit and left[n] >= fit:
                take, each = left[n] // fit, fit
            elif left[n] < fit:
                take, each = 1, left[n]
            else:
                take, each = count, fit
            open_bins[gap][-1][1] -= take
            if not open_bins[gap][-1][1]:
                open_bins[gap].pop()
            add(filled + [n] * each, gap - each * n, take)
            left[n] -= take * each
    return [(filled, count) for bins in open_bins.values() for filled, count in bins]


def programmed(lengths: np.ndarray, demand: np.ndarray, capacity: int, above: int) -> tuple[Packed, np.ndarray]:
    """Full sequences of lengths over `above`, by one program after another, and the demand that is left."""
    left, made = demand.astype(np.int64), []
    while (mine := np.flatnonzero((left > 0) & (lengths > above))).size:
        solution, _ = fractional(lengths[mine], left[mine].astype(float), capacity)
        full = [(found, x) for found, x in solution if sum(int(lengths[mine[i]]) * a for i, a in found.items()) == capacity]
        before, (placed, rest) = left[mine], rounded(full, left[mine])
        left[mine] = rest
        made += [([int(lengths[mine[i]]) for i, a in sorted(found.items(), reverse=True) for _ in range(a)], times) for found, times in placed]
        if before.sum() - rest.sum() < PLACED * before.sum():
            break
    return made, left


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Packed:
    """Packs the histogram exactly, in no more sequences than best fit alone."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), int)
    demand = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    number = lambda packed: sum(count for _, count in packed)
    least, found = number(best_fit(histogram, capacity)), []
    for part in FILLERS:
        made, left = programmed(lengths, demand, capacity, capacity // part)
        made += best_fit({n: k for n, k in zip(lengths.tolist(), left.tolist()) if k}, capacity)
        found.append(made)
        if number(made) <= least:
            break
    return min(found, key=number)


def slots(configurations: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, pieces of it in one sequence, their offset)."""
    rows: dict[int, list[tuple]] = {}
    ranks, sequence = Counter(), 0
    for filled, count in configurations:
        offset = 0
        for n, a in sorted(Counter(filled).items(), reverse=True):
            rows.setdefault(n, []).append((ranks[n], sequence, a, offset))
            ranks[n] += a * count
            offset += a * n
        sequence += count
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places written pieces (as of pieces_of) into sequences."""
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)))
    base = base.select("length", "task", F.coalesce("base", F.lit(0)).alias("base"))
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # the table's size follows the rounds and lengths of the program, not the input
    table = pieces.sparkSession.sparkContext.broadcast(slots(solve(histogram, capacity)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            length = pdf["length"].to_numpy()
            rank = (pdf["base"] + pdf["nth"]).to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), table.value[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * n
            yield pdf.assign(sequence_id=sequence, offset=offset)[[x.split()[0] for x in PACKED.split(", ")]]

    return pieces.join(base, ["length", "task"]).mapInPandas(place, PACKED)


def best_fit_packing(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each row of docs."""
    made = pieces_of(docs, vocab or vocabulary(), capacity, end_id, text_col, id_col)
    return pack(written(made, "pieces"), capacity)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
