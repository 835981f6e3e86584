"""Operator 5, exact substring dedup by a hash-compared suffix sort.

Bytes are removed that a string of LENGTH bytes covers which also starts in a
document of a smaller id. No table of all suffixes is shuffled:

1. Equal texts become one row of the smallest id; a later copy of LENGTH bytes
   or more is removed whole, whatever else holds.
2. Anchors: every LENGTH-byte window holds W grams of GRAM bytes, and the one of
   the smallest hash is its anchor, so equal windows have equal anchors at the
   same place. Only anchors that stand in two texts or more go on. Occurrences
   that share an anchor inside one batch are known to go on there; the buckets
   that compare batches get two of them at most, so a common passage is no hot key.
3. Contexts: of such an anchor, the bytes of the windows that it anchors. Equal
   contexts are aggregated to their smallest id, first inside a task.
4. In a bucket of contexts by anchor, the suffixes at which windows start are
   sorted by mergesort. Two suffixes are compared by their longest common
   extension, found by binary search over prefix polynomial hashes, and equal
   neighbours are verified byte by byte. A run of equal suffixes is a class; its
   smallest id decides. An anchor with very many different contexts (a common
   phrase with ever new surroundings) is hot: its windows go to buckets one by
   one, by anchor, place and window hash, so that only equal windows must meet.
5. The removed ranges go back to the texts, in blocks per document bucket.

A text is known inside the workers by a 63-bit key that is checked to be unique
(keys that two texts share are drawn anew), and results meet their rows by the
texts' SHA-256.

Null texts count as empty; texts under LENGTH bytes lose nothing and remove
nothing; very long texts are taken whole. Equal ids do not remove each other;
rows that repeat an id and a text give equal results. Null ids come after all
others: their texts are removed by numbered ones but never the other way round.
Ties of equal ids are no earlier and no later. An empty table gives no rows, and
other columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import release, small, small_batches, split_rows
from foliant.session import discard, written

LENGTH, GRAM = 50, 27
W = LENGTH - GRAM + 1
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text behind one bucket of a shuffle; characters of a batch; suffixes sorted at once.
BUCKET_BYTES, BATCH_CHARS, SORT_ROWS = 12 << 20, 1 << 20, 200_000
CACHE_BYTES = 1 << 16
#: Buckets at least, so that a small table is spread too.
BUCKETS = 24
#: Contexts of one anchor from which it may be hot (twice as many always are), and bytes of text that raise it by one,
#: so that hot anchors stay a list of a million at most, whatever the input.
HOT_CONTEXTS, HOT_BYTES = 20_000, 1 << 24
NO_ID = (1 << 63) - 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i < n, kept in the worker."""
    own = sys.modules.setdefault("_foliant_worker", types.ModuleType("_foliant_worker"))
    if len(getattr(own, "powers", ((),))[0]) < n:
        made = []
        for x in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 18), x, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        own.powers = tuple(made)
    return own.powers[0][:n], own.powers[1][:n]


class PrefixHash:
    """Polynomial hashes of all substrings of a byte array, modulo 2^64: collisions are possible and get verified."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        power, self.inverse = powers(n)
        self.prefix = np.zeros(n, U)
        np.cumsum((data.astype(U) + U(1)) * power[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def all(self, length: int) -> np.ndarray:
        return (self.prefix[length:] - self.prefix[:-length]) * self.inverse[:-length]

    def common(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Longest common extension of the suffixes at i and j, up to `most`, by binary search over prefix hashes."""
        pi, pj, vi, vj = self.prefix[i], self.prefix[j], self.inverse[i], self.inverse[j]
        equal = lambda rows, n: (self.prefix[i[rows] + n] - pi[rows]) * vi[rows] == (self.prefix[j[rows] + n] - pj[rows]) * vj[rows]
        e = np.full(len(i), most)
        todo = np.flatnonzero(~equal(slice(None), most))  # equal suffixes need one comparison
        low, high = np.zeros(len(todo), np.int64), np.full(len(todo), most - 1)
        while len(todo) and (low < high).any():
            mid = (low + high + 1) // 2
            fits = equal(todo, mid)
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        e[todo] = low
        return e


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width]; the last width - 1 entries see what is left."""
    x, done = x.copy(), 1
    while done < width:
        step = min(done, width - done)
        x[:-step] = op(x[:-step], x[step:])
        done += step
    return x


class Anchors:
    """The anchors of texts laid end to end: places, hashes, and the windows (first, last start) of each."""

    def __init__(self, raw: list[bytes]):
        size = np.array([len(r) for r in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(size)])
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(self.data)
        self.gram = np.full(n, U(0xFFFFFFFFFFFFFFFF))
        found, k = [], 0
        while k < len(raw):  # whole texts, about CACHE_BYTES at a time: the arrays stay in the CPU's cache
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + CACHE_BYTES)))
            end = min(end, len(raw))
            found.append(self._scan(k, end, size))
            k = end
        self.at = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.hash = mix(self.gram[self.at] ^ U(0x5851F42D4C957F2D))
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1

    def _scan(self, k: int, end: int, size: np.ndarray) -> np.ndarray:
        low, high = int(self.starts[k]), int(self.starts[end])
        if high - low < LENGTH:
            return np.zeros(0, np.int64)
        gram = self.gram[low:high]
        gram[: high - low - GRAM + 1] = mix(PrefixHash(self.data[low:high]).all(GRAM))
        least = sliding(gram, W, np.minimum)
        valid = np.zeros(high - low + 1, np.int8)  # windows inside one text
        long = size[k:end] >= LENGTH
        np.add.at(valid, self.starts[k:end][long] - low, 1)
        np.add.at(valid, self.starts[k + 1 : end + 1][long] - low - LENGTH + 1, -1)
        least[np.cumsum(valid[:-1]) == 0] = 0
        most = sliding(least[::-1], W, np.maximum)[::-1]  # over the windows that hold a gram
        return np.flatnonzero((most == gram) & (gram > 0)) + low

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows that the anchors in rows own (in the joined data)."""
        at, n = self.at[rows], len(self.data)
        own = self.gram[at]
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        going_l, going_r = np.ones(len(at), bool), np.ones(len(at), bool)
        for d in range(1, W):
            going_l &= (at - d >= 0) & (self.gram[np.maximum(at - d, 0)] >= own)
            going_r &= (at + d < n) & (self.gram[np.minimum(at + d, n - 1)] >= own)
            left += going_l
            right += going_r
        doc = self.doc[rows]
        first = np.maximum(at - left, self.starts[doc])
        last = np.minimum(np.minimum(at, at + right - W + 1), self.starts[doc + 1] - LENGTH)
        return first, last


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of whole numbers, place by place: equal high bytes stand together and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(b: bytes, width: int) -> np.ndarray:
    x = np.zeros((len(b) // width, 8), np.uint8)
    x[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return x.view("<u8").ravel()


def _cat(parts, dtype) -> np.ndarray:
    parts = [np.frombuffer(p, dtype) for p in parts]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


ANCHOR_ROWS = "bucket int, keys binary, counts binary, hashes binary, places binary"
PLACE_ROWS = "block int, keys binary, places binary"
CONTEXT_ROWS = "bucket int, block int, hashes binary, docs binary, keys binary, firsts binary, spans binary, leads binary, bytes binary, sizes binary"
RANGE_ROWS = "block int, keys binary, firsts binary, ends binary"


def _raw(part: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in part["text"]]


def _anchor_rows(buckets: int, shared_here: bool, blocks: int):
    """Either the anchors for the buckets, or the places of anchors that two texts of a batch share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in split_rows(frames, BATCH_CHARS):
            a, keys = Anchors(_raw(part)), part["key"].to_numpy()
            order = np.lexsort((a.doc, a.hash))
            h, doc = a.hash[order], a.doc[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            group = np.cumsum(new) - 1
            firsts = np.flatnonzero(new)
            other = np.zeros(len(h), bool)  # in another text than the group's first
            other[:] = doc != doc[firsts][group] if len(h) else False
            shared = np.bincount(group, other, minlength=len(firsts)) > 0
            if shared_here:
                rows = order[shared[group]]
                yield from _place_rows(keys[a.doc[rows]], a.at[rows] - a.starts[a.doc[rows]], blocks)
                continue
            first_other = np.zeros(len(h), bool)
            at = np.flatnonzero(other)
            first_other[at[np.unique(group[at], return_index=True)[1]]] = True
            # an anchor of this batch's own text goes with all its places, a shared one with two texts
            rows = np.sort(order[np.where(shared[group], new | first_other, True)])
            bucket = (a.hash[rows] >> U(40)) % U(buckets)
            out = []
            turn = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[turn])) + 1
            for some in np.split(turn, cuts) if len(turn) else []:
                r = rows[some]
                docs, counts = np.unique(a.doc[r], return_counts=True)
                out.append((int(bucket[some[0]]), keys[docs].tobytes(), counts.astype("<u4").tobytes(), _planes(a.hash[r], 5), _planes(a.at[r] - a.starts[a.doc[r]], 4)))
            yield pd.DataFrame(out, columns=["bucket", "keys", "counts", "hashes", "places"])

    return run


def _place_rows(keys: np.ndarray, places: np.ndarray, blocks: int) -> Iterator[pd.DataFrame]:
    block = keys % blocks
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    rows = [(int(block[r[0]]), keys[r].tobytes(), _planes(places[r], 4)) for r in np.split(order, cuts)] if len(keys) else []
    yield pd.DataFrame(rows, columns=["block", "keys", "places"])


def _shared(blocks: int):
    """The places of a bucket's anchors that stand in two texts or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([_from_planes(b, 5) for b in pdf["hashes"]])
        places = np.concatenate([_from_planes(b, 4) for b in pdf["places"]]).astype(np.int64)
        keys = np.repeat(_cat(pdf["keys"], "<i8"), _cat(pdf["counts"], "<u4"))
        order = np.argsort(h, kind="stable")
        h, k = h[order], keys[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        shared = np.bincount(group, k != k[np.flatnonzero(new)][group]) > 0
        rows = order[shared[group]]
        return next(_place_rows(keys[rows], places[rows], blocks))

    return run


def later_copies(data: np.ndarray, first: np.ndarray, span: np.ndarray, lead: np.ndarray, anchor: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose context equals one of a smaller id (all their windows are removed), and the rows that are left."""
    p = PrefixHash(data)
    same = mix(p.of(first, span) ^ mix(anchor ^ (lead * 1000 + span).astype(U)))
    order = np.lexsort((docs, same))
    new = np.ones(len(order), bool)
    new[1:] = same[order][1:] != same[order][:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of each its class's smallest id
    # equal hashes are verified: the bytes must agree
    alike = (head != order) & (span[head] == span[order]) & (lead[head] == lead[order]) & (docs[head] < docs[order])
    k = np.flatnonzero(alike)
    for d in range(int(span[order[k]].max()) if len(k) else 0):
        k = k[d < span[order[k]]]
        k_bad = data[first[order[k]] + d] != data[first[head[k]] + d]
        alike[k[k_bad]] = False
    return order[alike], order[~alike]


def _contexts(buckets: int, often: int):
    """The contexts of a block's shared anchors, equal ones as one; a later copy's windows are removed at once.

    Rows of bucket -1 are removed ranges, rows of bucket -2 anchors (hashes) with at least `often` contexts here (how many: docs).
    """

    def run(_, texts: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in CONTEXT_ROWS.split(", ")]
        if not len(texts) or not len(places):
            return pd.DataFrame(columns=names)
        wanted_key = _cat(places["keys"], "<i8")
        wanted_at = np.concatenate([_from_planes(b, 4) for b in places["places"]]).astype(np.int64)
        out, seen, block = [], [], int(texts["block"].iloc[0])
        for part in split_rows(iter([texts]), BATCH_CHARS):
            a, keys, docs = Anchors(_raw(part)), part["key"].to_numpy(), part["doc"].to_numpy()
            order = np.argsort(keys)
            near = np.minimum(np.searchsorted(keys[order], wanted_key), len(keys) - 1)
            mine = keys[order][near] == wanted_key
            at = np.unique(a.starts[order[near[mine]]] + wanted_at[mine])
            rows = np.searchsorted(a.at, at)
            first, last = a.windows(rows)
            good = last >= first
            rows, first, last = rows[good], first[good], last[good]
            if not len(rows):
                continue
            end, doc = last + LENGTH, a.doc[rows]
            lead, span = a.at[rows] - first, end - first
            gone, kept = later_copies(a.data, first, span, lead, a.hash[rows], docs[doc])
            if len(gone):
                out.append(_range_row(-1, keys[doc[gone]], first[gone] - a.starts[doc[gone]], end[gone] - a.starts[doc[gone]], names, int(part["block"].iloc[0])))
            r = np.sort(kept)
            seen.append(a.hash[rows[r]])
            out += _packed((a.hash[rows[r]] >> U(40)) % U(buckets), a.hash[rows[r]], docs[doc[r]], keys[doc[r]], first[r] - a.starts[doc[r]], lead[r], span[r], a.data, first[r])
        anchors, counts = np.unique(np.concatenate(seen) if seen else np.zeros(0, U), return_counts=True)
        if (many := counts >= often).any():
            out.append(tuple((dict.fromkeys(names, b"") | {"bucket": -2, "block": block, "hashes": anchors[many].tobytes(), "docs": counts[many].astype("<i8").tobytes()}).values()))
        return pd.DataFrame(out, columns=names)

    return run


def _packed(bucket, anchor, docs, keys, firsts, lead, span, data, at) -> list[tuple]:
    """Rows of CONTEXT_ROWS, one per bucket; the contexts' bytes are data[at : at + span]."""
    out, turn = [], np.argsort(bucket, kind="stable")
    for s in np.split(turn, np.flatnonzero(np.diff(bucket[turn])) + 1) if len(turn) else []:
        text = np.repeat(at[s] - np.concatenate([[0], np.cumsum(span[s])[:-1]]), span[s]) + np.arange(span[s].sum())
        out.append((int(bucket[s[0]]), -1, anchor[s].tobytes(), docs[s].tobytes(), keys[s].tobytes(), _planes(firsts[s], 4), b"", _planes(lead[s], 1), data[text].tobytes(), _planes(span[s], 1)))
    return out


def _unpacked(pdf: pd.DataFrame) -> tuple:
    """Anchor hashes, ids, keys, places, leads, lengths, joined bytes of the contexts in rows of CONTEXT_ROWS."""
    whole = lambda c, width: np.concatenate([_from_planes(b, width) for b in pdf[c]]).astype(np.int64)
    return _cat(pdf["hashes"], "<u8"), _cat(pdf["docs"], "<i8"), _cat(pdf["keys"], "<i8"), whole("firsts", 4), whole("leads", 1), whole("sizes", 1), np.frombuffer(b"".join(pdf["bytes"]), np.uint8)


def _hot_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"anchor": _cat(pdf["hashes"], "<i8"), "n": _cat(pdf["docs"], "<i8")})


def _split(buckets: int, hot: np.ndarray, wanted: bool):
    """The contexts of anchors that are not hot (wanted: false), or the single windows of the hot ones, equal ones as one."""

    names = [x.split()[0] for x in CONTEXT_ROWS.split(", ")]

    def split(pdf: pd.DataFrame) -> list[tuple]:
        h, docs, keys, firsts, lead, span, data = _unpacked(pdf)
        at = np.cumsum(span) - span
        rows = np.flatnonzero(np.isin(h, hot) == wanted)
        if not wanted:
            bucket = np.repeat(pdf["bucket"].to_numpy(), [len(b) // 8 for b in pdf["hashes"]])
            return _packed(bucket[rows], h[rows], docs[rows], keys[rows], firsts[rows], lead[rows], span[rows], data, at[rows])
        if not len(rows):
            return []
        here = np.cumsum(span[rows]) - span[rows]  # the hot contexts' own bytes
        view = data[np.repeat(at[rows] - here, span[rows]) + np.arange(span[rows].sum())]
        n = span[rows] - LENGTH + 1
        row = np.repeat(rows, n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, shift = np.repeat(here, n) + off, off - lead[row]
        own = PrefixHash(view).of(start, LENGTH)
        anchor = mix(h[row] ^ mix(own + shift.astype(U)))
        gone, kept = later_copies(view, start, np.full(len(row), LENGTH), -shift, anchor, docs[row])
        out = []
        if len(gone):
            places = firsts[row[gone]] + off[gone]
            out.append(_range_row(-1, keys[row[gone]], places, places + LENGTH, names, -1))
        k = np.sort(kept)
        return out + _packed((anchor[k] >> U(40)) % U(buckets), anchor[k], docs[row[k]], keys[row[k]], firsts[row[k]] + off[k], -shift[k], np.full(len(k), LENGTH), view, start[k])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:  # in parts of about BATCH_CHARS bytes
            part = np.cumsum([len(b) for b in pdf["bytes"]]) // BATCH_CHARS
            for _, some in pdf.groupby(part, sort=True):
                yield pd.DataFrame(split(some), columns=names)

    return run


def _range_row(bucket: int, keys, firsts, ends, names: list[str], block: int) -> tuple:
    row = dict.fromkeys(names, b"") | {"bucket": bucket, "block": block, "keys": keys.tobytes(), "firsts": _planes(firsts, 4), "spans": _planes(ends, 4)}
    return tuple(row[n] for n in names)


def suffix_order(data: np.ndarray, at: np.ndarray, group: np.ndarray, p: PrefixHash, length: int = LENGTH) -> np.ndarray:
    """The order of the suffixes data[at:], compared on `length` bytes, inside each group (at sorted by group)."""

    def compared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        e = p.common(i, j, length)
        short = e < length
        k = np.where(short, e, 0)
        return np.where(short, data[i + k].astype(np.int16) - data[j + k], 0)

    n = len(at)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    starts = np.flatnonzero(new)
    gid = np.cumsum(new) - 1
    size = np.diff(np.append(starts, n))[gid]
    base = starts[gid]
    order, slots, width = np.arange(n), np.arange(n), 1
    while True:
        slots = slots[size[slots] > width]  # of groups with a run of this width and more
        if not len(slots):
            return order
        b = base[slots]
        place = slots - b
        run = place // width
        sibling = b + (run ^ 1) * width
        low, high = np.zeros(len(slots), np.int64), np.clip(b + size[slots] - sibling, 0, width)
        mine, left = order[slots], run % 2 == 0
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) // 2
            c = compared(at[order[sibling[todo] + mid]], at[mine[todo]])
            before = np.where(left[todo], c < 0, c <= 0)  # equal ones of the left run stay first
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        order[b + (run // 2) * 2 * width + (place - run * width) + low] = mine
        width *= 2


def _decide(blocks: int):
    """The removed ranges that a bucket's contexts give."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, docs, keys, firsts, lead, span, data = _unpacked(pdf)
        start = np.concatenate([[0], np.cumsum(span)[:-1]])
        gone_k, gone_a, gone_b = [], [], []
        order = np.argsort(h, kind="stable")
        same = np.append(np.flatnonzero(np.diff(h[order])) + 1, len(h))
        begin = 0
        while begin < len(h):  # whole anchors, about SORT_ROWS suffixes at a time
            weight = np.cumsum(span[order[begin:]] - LENGTH + 1)
            reach = begin + int(np.searchsorted(weight, SORT_ROWS)) + 1
            end = int(same[np.searchsorted(same, min(reach, len(h)))])
            rows = order[begin:end]
            begin = end
            rows = rows[np.isin(h[rows], _repeated(h[rows]))]
            if not len(rows):
                continue
            here = np.cumsum(span[rows]) - span[rows]  # where each context begins in the chunk's own bytes
            view = data[np.repeat(start[rows] - here, span[rows]) + np.arange(span[rows].sum())]
            gone, kept = later_copies(view, here, span[rows], lead[rows], h[rows], docs[rows])
            gone_k.append(keys[rows[gone]])
            gone_a.append(firsts[rows[gone]])
            gone_b.append(firsts[rows[gone]] + span[rows[gone]])
            kept = kept[np.isin(h[rows[kept]], _repeated(h[rows[kept]]))]
            rows, here = rows[kept], here[kept]
            if not len(rows):
                continue
            p = PrefixHash(view)
            n = span[rows] - LENGTH + 1  # windows of each
            row = np.repeat(rows, n)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shift = off - lead[row]  # of the window's start to the anchor: equal windows have it equal
            turn = np.lexsort((shift, h[row]))
            row, off, shift = row[turn], off[turn], shift[turn]
            at = np.repeat(here, n)[turn] + off
            group = np.ones(len(row), bool)
            group[1:] = (h[row][1:] != h[row][:-1]) | (shift[1:] != shift[:-1])
            group = np.cumsum(group)
            some = np.bincount(group)[group] > 1
            row, off, at, group = row[some], off[some], at[some], group[some]
            if not len(row):
                continue
            ranked = suffix_order(view, at, group, p)
            row, off, at, group = row[ranked], off[ranked], at[ranked], group[ranked]
            equal = np.zeros(len(row), bool)
            equal[1:] = (group[1:] == group[:-1]) & (p.of(at[1:], LENGTH) == p.of(at[:-1], LENGTH))
            k = np.flatnonzero(equal)
            for d in range(LENGTH):  # verify
                equal[k] &= view[at[k] + d] == view[at[k - 1] + d]
            cls = np.cumsum(~equal) - 1
            least = np.full(cls[-1] + 1, NO_ID)
            np.minimum.at(least, cls, docs[row])
            hit = least[cls] < docs[row]
            gone_k.append(keys[row[hit]])
            gone_a.append(firsts[row[hit]] + off[hit])
            gone_b.append(firsts[row[hit]] + off[hit] + LENGTH)
        k, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gone_k, gone_a, gone_b))
        return _range_rows(k, a, b, blocks)

    return run


def _repeated(h: np.ndarray) -> np.ndarray:
    values, counts = np.unique(h, return_counts=True)
    return values[counts > 1]


def _merged(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that overlap or touch inside one text, as one."""
    if not len(k):
        return k, a, b
    order = np.lexsort((a, k))
    k, a, b = k[order], a[order], b[order]
    new_text = np.ones(len(k), bool)
    new_text[1:] = k[1:] != k[:-1]
    text = np.cumsum(new_text)
    shift = text * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + shift) - shift
    new = new_text.copy()
    new[1:] |= a[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return k[at], a[at], np.maximum.reduceat(b, at)


def _range_rows(k, a, b, blocks: int) -> pd.DataFrame:
    k, a, b = _merged(k, a, b)
    block = k % blocks
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    rows = [(int(block[r[0]]), k[r].tobytes(), _planes(a[r], 4), _planes(b[r], 4)) for r in np.split(order, cuts)] if len(k) else []
    return pd.DataFrame(rows, columns=["block", "keys", "firsts", "ends"])


RESULT = "doc long, sha binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(keep_text: bool):
    def run(_, texts: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
        k, a, b = _cat(ranges["keys"], "<i8"), *(np.concatenate([_from_planes(x, 4) for x in ranges[c]] or [np.zeros(0, np.uint64)]).astype(np.int64) for c in ("firsts", "ends"))
        k, a, b = _merged(k, a, b)
        out = []
        for doc, key, sha, text in zip(texts["doc"], texts["key"], texts["sha"], texts["text"]):
            raw = text.encode("utf-8", "surrogatepass")
            lo, hi = np.searchsorted(k, key, "left"), np.searchsorted(k, key, "right")
            kept, at = [], 0
            for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist()):
                kept.append(raw[at:x])
                at = y
            kept = b"".join((*kept, raw[at:]))
            out.append((doc, sha, len(raw), len(raw) - len(kept), int(hi - lo), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return run


def _by_block(blocks: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            a, b = (np.concatenate([_from_planes(x, 4) for x in pdf[c]] or [np.zeros(0, U)]).astype(np.int64) for c in ("firsts", "ends"))
            yield _range_rows(_cat(pdf["keys"], "<i8"), a, b, blocks)

    return run


#: Bits of a text's key; fewer in tests, so that keys collide.
KEY_BITS = 63


def text_key(*salt: object):
    return F.xxhash64("text", *map(F.lit, salt)).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def keyed(texts: DataFrame) -> DataFrame:
    """Texts with unique keys: where two have the same, both draw new ones of 63 bits from their SHA-256 until all differ."""
    for turn in range(1, 100):
        twice = texts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")  # reads the keys alone
        if not twice.limit(1).count():
            return texts
        twice = small(written(twice.withColumn("twice", F.lit(True)), "twice"))
        new = F.xxhash64("sha", F.lit(turn)).bitwiseAND(F.lit(NO_ID))
        again = texts.join(twice, "key", "left").select("doc", F.when(F.col("twice"), new).otherwise(F.col("key")).alias("key"), "sha", "text")
        texts, old = written(again, "texts"), texts
        discard(old)
    raise ValueError("no unique keys were found")


def dedup_substrings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left): one row per row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = blocks = max(BUCKETS, -(-size // BUCKET_BYTES))
    sha = F.unhex(F.sha2("text", 256))
    once = source.groupBy("text").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc"))
    texts = keyed(written(once.select("doc", text_key().alias("key"), sha.alias("sha"), "text"), "texts"))
    texts = texts.withColumn("block", (F.col("key") % blocks).cast("int"))
    release(spark)
    places = texts.mapInPandas(_anchor_rows(buckets, True, blocks), PLACE_ROWS)
    among = texts.mapInPandas(_anchor_rows(buckets, False, blocks), ANCHOR_ROWS).groupBy("bucket").applyInPandas(_shared(blocks), PLACE_ROWS)
    places = written(places.unionByName(among), "places")
    release(spark)
    limit = max(HOT_CONTEXTS, size // HOT_BYTES)
    contexts = texts.groupBy("block").cogroup(places.groupBy("block")).applyInPandas(_contexts(buckets, max(1, limit // blocks)), CONTEXT_ROWS)
    contexts = written(contexts, "contexts")
    discard(places)
    release(spark)
    at_once, compared = contexts.filter("bucket = -1"), contexts.filter("bucket >= 0")
    found = contexts.filter("bucket = -2").mapInPandas(_hot_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = found.filter(F.col("n") > limit).select("anchor").toPandas()  # contexts / limit at most: some million
    if len(found):
        hot = np.sort(found["anchor"].to_numpy(np.int64).view(U))
        windows = written(compared.mapInPandas(_split(buckets, hot, True), CONTEXT_ROWS), "windows")
        at_once = at_once.unionByName(windows.filter("bucket = -1"))
        compared = compared.mapInPandas(_split(buckets, hot, False), CONTEXT_ROWS).unionByName(windows.filter("bucket >= 0"))
    at_once = at_once.select("block", "keys", "firsts", F.col("spans").alias("ends"))
    if len(found):  # the windows of a batch belong to texts of any block
        at_once = at_once.mapInPandas(_by_block(blocks), RANGE_ROWS)
    ranges = written(at_once.unionByName(compared.groupBy("bucket").applyInPandas(_decide(blocks), RANGE_ROWS)), "ranges")
    discard(contexts, *([windows] if len(found) else []))
    release(spark)
    done = texts.groupBy("block").cogroup(ranges.groupBy("block")).applyInPandas(_apply(keep_text), RESULT)
    # the copies of a text: their ids meet the one row of the text
    each = source.select("doc_id", sha.alias("sha"), F.octet_length("text").cast("long").alias("bytes"))
    out = each.join(done, "sha")
    later = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("doc")) & (F.col("bytes") >= LENGTH)
    columns = {
        "doc_id": F.col("doc_id"),
        "n_bytes": F.col("bytes"),
        "n_removed": F.when(later, F.col("bytes")).otherwise(F.col("n_removed")),
        "n_spans": F.when(later, F.lit(1)).otherwise(F.col("n_spans")).cast("long"),
        "kept_sha256": F.when(later, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")),
    }
    if keep_text:
        columns["kept"] = F.when(later, F.lit(b"")).otherwise(F.col("kept"))
    return out.select(*[c.alias(n) for n, c in columns.items()])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
