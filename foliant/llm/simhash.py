"""Operator 10, SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits; two link if they differ in at most `radius` bits. The
bits are grouped into partitions, correlated bits together, so that the other
partitions stay selective. Partition i gets a threshold t_i >= -1 with
sum(t_i + 1) = radius + 1; two linked fingerprints must then differ in at most
t_i bits of some partition i (t_i = -1: the partition is not probed). For every
number of partitions a dynamic program over the partitions picks the thresholds
of the least estimated cost (signatures sent plus candidates met), and the
cheapest plan is taken. Correlations and the chance that two fingerprints share a
partition's value are counted over all distinct fingerprints, by Spark. Each fingerprint sends its own value of a partition and,
where t_i = 1 or 2, the values with so many bits flipped; those that meet are
verified on all 64 bits.

Skew: copies share a fingerprint, and only distinct fingerprints take part. A
task verifies its groups in blocks and emits the links of a spanning forest of
each group, never all pairs. Groups over GROUP_ROWS are cut into pairs of blocks
that go to different tasks; every pair of members still meets.

Components come from hash-to-min rounds with pointer jumping over the forest's
links, each round a written table in the shared folder; a round's table goes when
the next one stands.

Null texts count as empty; a text with no words has fingerprint zero and is
linked like any other. Very long texts are read whole. Repeated rows give repeated
rows. An empty table gives no rows. Null ids get the component's smallest id that
is not null. Other columns of any name are not read (keep_one hands them on).
Ties: equal fingerprints are one; of rows that could stay the one of the smallest
id does, then of the smallest text hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import nested, small, small_batches, texts, unnested
from foliant.session import discard, written

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Distinct fingerprints of one signature that one task compares.
GROUP_ROWS = 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, hash (of the text), fp: one row per row of docs."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "hash": pdf["hash"], "fp": np.array([fingerprint(t) for t in pdf["text"]], np.int64)})

    return texts(docs, text_col, id_col).withColumn("hash", F.xxhash64("text")).mapInPandas(run, "doc_id long, hash long, fp long")


# ---- the plan -----------------------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j, for all pairs: one row per pair and task is summed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS, BITS), np.int64)
        for pdf in frames:
            bits = np.unpackbits(np.ascontiguousarray(pdf["fp"].to_numpy(np.int64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": i, "j": j, "n": both[i, j]})

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 2,080 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["n"]
    return out


def correlations(both: np.ndarray, n: int) -> np.ndarray:
    """The absolute correlation of each two bits, from their joint counts over n fingerprints."""
    p = np.diag(both) / n
    spread = np.sqrt(p * (1 - p))
    spread = np.where(spread > 0, spread, 1)
    return np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))


def correlated_groups(near: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of about equal size, each grown from a bit by what correlates with it most."""
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        seed = max(sorted(free), key=lambda b: near[b, sorted(free)].sum())
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: near[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def shared_values(fps: DataFrame, masks: list[int], n: int) -> dict[int, float]:
    """For each mask the chance that two of the n fingerprints agree on its bits, counted over all of them."""
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for k, m in enumerate(masks)])).alias("m")
    counts = fps.select(value).groupBy("m.k", "m.v").agg(F.count("*").cast("double").alias("c"))
    pairs = counts.groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs")).collect()  # a row per mask
    return {masks[r["k"]]: r["pairs"] / max(n * (n - 1), 1) for r in pairs}


def estimated_cost(same: float, n: int, width: int, t: int) -> float:
    """Signatures of a partition of `width` bits at threshold t, and the candidates that they meet, for n fingerprints."""
    if t < 0:
        return 0.0
    signatures = sum(math.comb(width, k) for k in range(t + 1))
    same = max(same, 2.0**-width)
    near = same * (1 + (signatures - 1) * 0.5)
    return n * signatures * 4.0 + n * n / 2 * near * 0.02


def choose(groupings: list[list[list[int]]], same: dict[int, float], n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition of the grouping with the least estimated cost."""
    best = (math.inf, [])
    for groups in groupings:
        need = radius + 1  # sum of (t_i + 1)
        table = {0: (0.0, [])}
        for g in groups:
            nxt: dict[int, tuple[float, list]] = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, min(3, need - spent)):
                    c = cost + estimated_cost(same.get(mask_of(g), 0.0), n, len(g), t)
                    if spent + t + 1 <= need and c < nxt.get(spent + t + 1, (math.inf,))[0]:
                        nxt[spent + t + 1] = (c, [*chosen, (g, t)])
            table = nxt
        if need in table and table[need][0] < best[0]:
            best = table[need]
    return [(g, t) for g, t in best[1] if t >= 0]


def plan(fps: DataFrame, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The partitions and thresholds for these n distinct fingerprints."""
    near = correlations(bit_counts(fps), n)
    groupings = [correlated_groups(near, parts) for parts in range(2, radius + 3)]
    masks = sorted({mask_of(g) for groups in groupings for g in groups})
    return choose(groupings, shared_values(fps, masks, n), n, radius)


# ---- probe and verify ---------------------------------------------------------------------------


def signatures(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, own (false: a probe with flipped bits), fp."""
    options = []
    for p, (bits, t) in enumerate(chosen):
        mask = _signed(mask_of(bits))
        value = F.col("fp").bitwiseAND(F.lit(mask))
        options.append(F.array(F.struct(F.lit(p).alias("part"), value.alias("key"), F.lit(True).alias("own"))))
        flips = [_signed(mask_of(list(c))) for k in range(1, t + 1) for c in combinations(bits, k)]
        if flips:
            options.append(F.transform(F.array(*map(F.lit, flips)), _probe(p, value)))
    return fps.select("fp", F.explode(F.flatten(F.array(*options))).alias("s")).select("s.part", "s.key", "s.own", "fp")


def _probe(part: int, value: Column):
    return lambda flip: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(flip).alias("key"), F.lit(False).alias("own"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _links_of_group(fp: np.ndarray, own: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a group's members (across its two sides, where there are two)."""
    found, left = [], np.arange(len(fp))
    two = side.min() != side.max()
    while len(left):
        todo = [left[0]]
        left = left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = np.bitwise_count(fp[left] ^ fp[i]) <= radius
            if not own[i]:
                hit &= own[left]  # two probes that meet here need not be near in this partition
            if two:
                hit &= side[left] != side[i]
            near = left[hit]
            found += [(fp[i], fp[j]) for j in near if fp[i] != fp[j]]
            todo += near.tolist()
            left = left[~hit]
    return found


def links(fps: DataFrame, chosen: list[tuple[list[int], int]], radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """a, b: links between distinct fingerprints, enough of them to keep every component together."""
    sig = written(signatures(fps, chosen), "signatures")
    sizes = sig.groupBy("part", "key").agg(F.count("*").alias("size"))
    large = sizes.filter(F.col("size") > group_rows).withColumn("blocks", F.ceil(F.col("size") / group_rows).cast("int")).drop("size")
    # members of a large group go to every pair of blocks that holds their own
    sig = sig.join(large, ["part", "key"], "left").withColumn("block", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda x: F.struct(F.least(x, "block").alias("lo"), F.greatest(x, "block").alias("hi")))
    sig = sig.select("part", "key", "own", "fp", "block", F.explode(pair).alias("pair")).select("part", "key", "own", "fp", "block", "pair.lo", "pair.hi")
    ordered = sig.repartition("part", "key", "lo", "hi").sortWithinPartitions("part", "key", "lo", "hi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf.iloc[-1]
            tail = (pdf["part"] == last["part"]) & (pdf["key"] == last["key"]) & (pdf["lo"] == last["lo"]) & (pdf["hi"] == last["hi"])
            rest = pdf[tail]
            if len(done := pdf[~tail]):
                yield _verify(done, radius)
        if rest is not None:
            yield _verify(rest, radius)

    return ordered.mapInPandas(run, "a long, b long")


def _verify(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    names = ("part", "key", "lo", "hi")
    columns = [pdf[c].to_numpy() for c in names]
    fp, own, block = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy(), pdf["block"].to_numpy()
    new = np.ones(len(pdf), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    a, b = [], []
    # small groups: all rows at once, each with the d-th row after it
    small = np.flatnonzero(size[group] <= 64)
    for d in range(1, 64):
        small = small[small + d < len(fp)]
        small = small[group[small] == group[np.minimum(small + d, len(fp) - 1)]]
        if not len(small):
            break
        hit = (np.bitwise_count(fp[small] ^ fp[small + d]) <= radius) & (own[small] | own[small + d]) & (fp[small] != fp[small + d])
        a.append(fp[small[hit]])
        b.append(fp[small[hit] + d])
    starts = np.append(np.flatnonzero(new), len(fp))
    for g in np.flatnonzero(size > 64):
        s = slice(starts[g], starts[g + 1])
        lo, hi = columns[2][s.start], columns[3][s.start]
        found = _links_of_group(fp[s], own[s], block[s] if lo != hi else np.zeros(s.stop - s.start), radius)
        if found:
            x = np.array(found, np.uint64)
            a.append(x[:, 0])
            b.append(x[:, 1])
    if not a:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


# ---- components ---------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component, for every node that has a link (columns a, b of edges)."""
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    label = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        # the smallest root among the neighbours, then the root's own root
        around = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("seen"))
        low = label.join(around, label["node"] == around["a"], "left").select("node", "root", F.least("root", "seen").alias("low"))
        # a root learns the smallest root that its members have seen
        told = low.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("told"))
        moved = written(low.join(told, low["root"] == told["r"], "left").select("node", F.col("root").alias("old"), F.least("low", "told").alias("root")), "moved")
        jump = moved.select(F.col("node").alias("r"), F.col("root").alias("up"))
        nxt = written(moved.join(jump, moved["root"] == jump["r"], "left").select("node", "old", F.least("root", "up").alias("root")), "roots")
        changed = nxt.filter("root <> old").limit(1).count()
        discard(label, moved)
        label = nxt
        if not changed:
            discard(both)
            return label.select("node", "root")


def grouped_fingerprints(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root, first: the component of every distinct fingerprint, and the smallest id of the fingerprint."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    n = distinct.count()
    if n < 2:
        return distinct.select("fp", F.col("fp").alias("root"), "first")
    edges = written(links(distinct.select("fp"), plan(distinct, n, radius), radius).distinct(), "links")
    root = components(edges)
    return distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: one row per row of docs."""
    marked = written(fingerprints(docs, text_col, id_col), "fingerprints")
    rooted = grouped_fingerprints(marked, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all columns: one of each component.

    It is the row of the smallest id, then of the smallest text hash; of equal
    rows any. Rows without an id cannot be named as copies, so they stay. Texts
    are not shuffled while the list of the rows that go is small.
    """
    numbered = docs.filter(F.col(id_col).isNotNull())
    marked = written(fingerprints(numbered, text_col, id_col), "fingerprints")
    rooted = grouped_fingerprints(marked).select("fp", "root")
    each = marked.groupBy("doc_id", "hash", "fp").agg(F.count("*").alias("rows")).join(rooted, "fp")
    each = written(each.select("doc_id", "hash", "rows", "root"), "rooted")
    stays = each.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("s"))
    kinds = each.join(stays, "root").select("doc_id", "hash", "rows", (F.struct("doc_id", "hash") == F.col("s")).alias("stays"))
    kinds = written(kinds.select(F.col("doc_id").alias("k_id"), F.col("hash").alias("k_hash"), "rows", "stays"), "kinds")
    key = (F.col("id") == F.col("k_id")) & (F.col("hash") == F.col("k_hash"))
    left = nested(numbered, text_col, id_col).join(small(kinds.filter("not stays")), key, "left_anti")
    repeated = kinds.filter("stays and rows > 1")
    if repeated.limit(1).count():  # rows that repeat an id and its text: only they meet to leave one
        few = small(repeated)
        once = left.join(few, key, "left_semi").dropDuplicates(["id", "hash"])
        left = left.join(few, key, "left_anti").unionByName(once)
    return unnested(left, docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
