"""Operators 1, 7, 9 and 10 against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from foliant.llm import packing, quality_rules, simhash, token_records
from foliant.llm.tokens import Encoder, vocabulary

WORDS = "the of and thion ered blesh onda re1 Ünder ça 世界 x-y z".split()


def make_texts(seed=1, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        words = rng.choice(WORDS, int(rng.integers(0, 400)))
        out.append("".join(w + rng.choice([" ", " ", " ", "\n", "  ", " \n", "\t", "  ", "  "]) for w in words))
    return [*out, "", None, " ", "\n\n", "a", "the end", out[3], out[3], "ab " * 300, "x" * 5000, "<|endoftext|> y", "'s don't  we'll \x1c q", "one two three four five six " * 9 + "\n" + "dup\n" * 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "clash", 1.0) for i, t in enumerate(make_texts())]
    return spark.createDataFrame([*rows, (None, "a b c", None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, length double")


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit), failed


def test_quality_rules(docs):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for r in docs.collect():
        assert tuple(got[r.doc_id])[1:7] == plain_rules(r.text), r
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)
    assert sorted(quality_rules.keep_quality(docs).columns) == sorted(docs.columns)
    assert {r.doc_id for r in quality_rules.keep_quality(docs).collect()} == {k for k, r in got.items() if r.kept}


def test_bands_reject_repetition_and_noise():
    import zstandard

    z = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    rng = np.random.default_rng(2)
    line = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(60))
    assert not quality_rules.measure(" ".join([line] * 40), z)[6]
    noise = " ".join(rng.bytes(9).hex().translate(str.maketrans("0123456789abcdef", "q0Z-w#r9vxYk$M_7")) + chr(int(c)) for c in rng.integers(0x4E00, 0x9FFF, 400))
    assert not quality_rules.measure("".join(chr(int(c)) + (" " if k % 5 == 4 else "") for k, c in enumerate(rng.integers(0x4E00, 0x9FFF, 4000))), z)[6]
    assert len(noise) > 0


def plain_verdict(text):
    """The bands by definition: straight lines between knots, chunks of 2048 bytes, a short rest with the chunk before."""
    import math

    import zstandard

    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))

    def inside(b):
        knots = quality_rules.BANDS
        x = min(max(len(b), knots[0][0]), knots[-1][0])
        k = max(k for k in range(len(knots) - 1) if knots[k][0] <= x)
        part = math.log2(x / knots[k][0]) / math.log2(knots[k + 1][0] / knots[k][0])
        low, high = (knots[k][c] + part * (knots[k + 1][c] - knots[k][c]) for c in (1, 2))
        return low - 1e-12 <= ratio(b) <= high + 1e-12

    raw, chunks = (text or "").encode(), []
    rest = raw
    while rest:
        n = 2048 if len(rest) >= 2048 + 512 else len(rest)
        chunks.append(rest[:n])
        rest = rest[n:]
    assert b"".join(chunks) == raw
    return bool(raw) and not plain_rules(text)[5] and inside(raw) and 4 * sum(len(c) for c in chunks if not inside(c)) <= len(raw)


def test_verdict(spark):
    rng = np.random.default_rng(8)
    vocab = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    line = prose(30)
    texts = [prose(int(n)) for n in rng.integers(40, 3000, 40)]
    texts += [" ".join(f"{line} {prose(k)}" for _ in range(20)) for k in (5, 10, 15, 25, 40)]  # more and more repetitive
    texts += [prose(300) + " " + " ".join(["ab"] * 900), prose(900) + " " + "".join(chr(int(c)) + " " for c in rng.integers(0x4E00, 0x9FFF, 900))]
    texts += [prose(330), prose(365), prose(380), prose(80_000), "", None]  # around the first cut; about half a MB
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = [plain_verdict(t) for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    assert 0 < sum(want) < len(texts) - 4


def test_every_byte_is_in_a_chunk():
    for n in (0, 1, 511, 2048, 2048 + 511, 2048 + 512, 4096, 5000, 9999):
        raw = bytes(k % 251 for k in range(n))
        chunks = quality_rules.chunks_of(raw)
        assert b"".join(chunks) == raw and all(len(c) >= 512 for c in chunks[1:])


def whole(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    texts = [x or "" for x in make_texts(5)] + ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", " <|endoftext|>  c <|endof text|>"]
    for text, ids in zip(texts, Encoder(vocabulary()).encode(texts)):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert Encoder(vocabulary()).encode(["<|endoftext|> y"])[0].tolist() == [50256, 331]


def test_encoder_of_other_vocabularies(tmp_path):
    """A file with another pre-tokenizer or normalizer is used on whole texts."""
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json",):
        t = Tokenizer.from_file(vocabulary(name))
        texts = [x or "" for x in make_texts(6, 20)]
        for text, ids in zip(texts, Encoder(vocabulary(name)).encode(texts)):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_token_records(spark, docs, tmp_path):
    path = f"file://{tmp_path}/rec"
    index = token_records.write_records(docs, path, vocabulary(), shard_bytes=20_000)
    assert index.select("shard").distinct().count() > 1
    got = token_records.token_starts(token_records.read_records(spark, path, index)).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = whole(r.text, 0)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), crc(ids))
        at += len(ids)
    for i in index.limit(5).collect():
        doc_id, ids = token_records.read_record(path, i.shard, i.offset)
        assert doc_id == i.doc_id and len(ids) == i.n_tokens
    assert token_records.read_records(spark, path, index, summary=False).count() == len(rows)
    import glob

    damaged = sorted(glob.glob(f"{tmp_path}/rec/data/*.rec"))[0]
    data = bytearray(open(damaged, "rb").read())
    data[30] ^= 1
    open(damaged, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        token_records.read_records(spark, path, index).collect()


def test_records_of_ties(spark, tmp_path, monkeypatch):
    """Repeated and null ids: the same starts whatever the order of the input, and no shard for one id alone."""
    monkeypatch.setattr(token_records, "BLOCK", 3)
    rows = [(1, f"text number {k} " * 5) for k in range(60)] + [(None, f"words {k % 7} " * 9) for k in range(60)] + [(2, "same row " * 20)] * 60 + [(3, "x" * 30_000)]
    starts = []
    for turn, docs in enumerate((spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5))):
        path = f"file://{tmp_path}/{turn}"
        index = token_records.write_records(docs, path, vocabulary(), shard_bytes=3000)
        assert index.filter("doc_id = 2").select("shard").distinct().count() > 1 and index.filter("doc_id is null").select("shard").distinct().count() > 1
        got = token_records.token_starts(token_records.read_records(spark, path, index)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        starts.append(sorted(map(str, got)))
    assert starts[0] == starts[1] and len(starts[0]) == len(rows)


def test_packing(spark, docs):
    capacity = 64
    got = packing.best_fit_packing(docs, capacity=capacity).collect()
    by_doc, by_seq = {}, {}
    for g in got:
        by_doc.setdefault(g.doc_id, []).append(g)
        by_seq.setdefault(g.sequence_id, []).append(g)
    for r in docs.collect():
        ids, parts = whole(r.text, 2), sorted(by_doc[r.doc_id], key=lambda g: g.piece)
        assert [g.piece for g in parts] == list(range(len(parts))) and sum(g.length for g in parts) == len(ids)
        at = 0
        for g in parts:
            assert g.start == at and g.ids_crc32 == crc(ids[at : at + g.length])
            at += g.length
        assert all(g.length == capacity for g in parts[1:])
    for parts in by_seq.values():
        at = 0
        for g in sorted(parts, key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= capacity
    least = -(-sum(g.length for g in got) // capacity)
    assert len(by_seq) <= least * 1.02 + 2


@pytest.mark.parametrize("seed", range(8))
def test_solve_packs_exactly(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 129, 40), rng.integers(1, 60, 40))}
    made = packing.solve(histogram, 128)
    total = Counter()
    for filled, count in made:
        assert sum(filled) <= 128 and count > 0
        for n in filled:
            total[n] += count
    assert total == Counter(histogram)
    bins = []
    for n in sorted(total.elements(), reverse=True):  # plain best fit
        k = max((k for k, b in enumerate(bins) if b + n <= 128), key=lambda k: bins[k], default=None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    assert sum(c for _, c in made) <= len(bins)
    assert sum(c for _, c in packing.best_fit(histogram, 128)) == len(bins)


def test_program_covers_and_places_the_demand():
    lengths = np.arange(1, 257)
    demand = np.random.default_rng(3).integers(1, 12, len(lengths)).astype(float)  # rare lengths everywhere
    solution, bound = packing.fractional(lengths, demand, 256)
    covered = np.zeros(len(lengths))
    for found, x in solution:
        assert sum(int(lengths[i]) * a for i, a in found.items()) <= 256
        for i, a in found.items():
            covered[i] += a * x
    assert (covered >= demand * (1 - 1e-9)).all()
    assert demand @ lengths / 256 * (1 - 1e-9) <= bound <= sum(x for _, x in solution) <= bound * 1.1
    made, left = packing.rounded(solution, demand)
    assert (left >= 0).all() and left.sum() < 0.15 * demand.sum()
    for found, times in made:
        for i, a in found.items():
            left[i] += a * times
    assert (left == demand).all()


def test_components_leave_nothing_behind(spark):
    from foliant.session import scratch_made

    before = scratch_made()
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60) if k % 20 != 19], "a long, b long")
    roots = simhash.components(edges)
    assert {r.node: r.root for r in roots.collect()} == {k: k // 20 * 20 for k in range(60)}
    assert len(scratch_made(before)) == 1  # the result alone


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs):
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    root = plain_components(fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    least = {}
    for r, c in zip(rows, root):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    for r, f, c in zip(rows, fps, root):
        assert got[r.doc_id].fp & (1 << 64) - 1 == f
        assert got[r.doc_id].component_id == least.get(c)
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in simhash.keep_one(docs).select("doc_id").collect())
    assert kept == [(False, 0)] + [(True, i) for i in sorted(set(least.values()))]  # rows without an id stay
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chosen", [None, [(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(21)), 1), (list(range(21, 42)), 0), (list(range(42, 64)), 0)]])
def test_links_find_every_component(spark, chosen):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set()
    for b in base.tolist():
        x = b
        for _ in range(int(rng.integers(1, 25))):
            for k in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.links(rows, chosen or simhash.plan(rows, len(fps)), group_rows=16)
    root = {r.node: r.root for r in simhash.components(found).collect()}
    want = plain_components(fps)
    groups, mine = {}, {}
    for f, c in zip(signed, want):
        groups.setdefault(c, set()).add(f)
    for f in signed:
        mine.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_plan_counts_all_fingerprints(spark):
    rng = np.random.default_rng(5)
    fps = rng.integers(-(1 << 63), 1 << 63, 900, dtype=np.int64)
    fps[:400] &= ~np.int64(0xFFFF)  # one value of the low bits in many
    rows = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(7)
    both = simhash.bit_counts(rows)
    bits = (fps.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(float)
    assert (both == bits.T @ bits).all()
    assert np.allclose(simhash.correlations(both, len(fps)), np.abs(np.corrcoef(bits.T)))
    for mask, got in simhash.shared_values(rows, [0xFFFF, 0xFF << 56], len(fps)).items():
        _, c = np.unique(fps.view(np.uint64) & np.uint64(mask), return_counts=True)
        assert np.isclose(got, (c * (c - 1)).sum() / (900 * 899))
    chosen = simhash.plan(rows, len(fps))
    assert sum(t + 1 for _, t in chosen) == simhash.RADIUS + 1
    assert len({b for g, _ in chosen for b in g}) == sum(len(g) for g, _ in chosen)


def test_keep_one_of_each_component(spark):
    words = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(1, words), (1, other), (2, words), (3, other), (1, words), (4, ""), (5, None), (6, "alone here")]
    docs = spark.createDataFrame([(*r, *"abcd") for r in rows], "doc_id long, text string, id string, hash string, row string, stays string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert got == sorted([(1, words), (1, other), (4, ""), (6, "alone here")])
