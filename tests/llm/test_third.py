"""Operators 11 to 13 against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import fill_middle, language_id, vector_codes

# --- 13: fill in the middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return doc_id, n, form, *sizes, out, text


ODD = st.text(alphabet="ab<PSM>é😀 \n\x00", max_size=60)


@settings(max_examples=150, deadline=None)
@given(ODD, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 3, 5, 16]))
def test_cuts_of_chunks(text, h1, h2, chunk):
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    want = n, bool(re.search("<[PSM]>", text)), len("".join(units[:a])), len("".join(units[:b]))
    assert fill_middle.cuts(np.frombuffer(text.encode(), np.uint8), h1, h2, chunk) == want


@settings(max_examples=100, deadline=None)
@given(*[st.binary(max_size=9).map(lambda b: np.frombuffer(bytes(b"ab<PSM> \xc3\xa9"[x % 10] for x in b), np.uint8)) for _ in range(3)])
def test_composition_is_associative(a, b, c):
    one = [fill_middle.tree(x)[-1] for x in (a, b, c)]
    left = fill_middle.compose(fill_middle.compose(one[0], one[1]), one[2])
    right = fill_middle.compose(one[0], fill_middle.compose(one[1], one[2]))
    whole = fill_middle.tree(np.concatenate([a, b, c]))[-1]
    for x, y, z in zip(left, right, whole):
        assert x.tolist() == y.tolist() == z.tolist()


def test_fim_rows(spark):
    texts = ["", None, "one two  three", "a <P> mark", "über <P und M>", "x" * 5000, "word 12 " * 3000, "<" * 700 + "P>", "é" * 900, "same", "same"]
    rows = [(k if k != 4 else None, t, "n", "f") for k, t in enumerate(texts)] + [(2, "one two  three", "n", "f"), (6, "word 12 " * 3000, "n", "f"), (None, "word 12 " * 3000, "n", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, form string")
    want = sorted((plain_fim(i, t) for i, t, *_ in rows), key=str)
    for spread, chunk in ((1 << 16, 1 << 14), (0, 7), (64, 33)):  # in place, all spread, both
        got = [tuple(r) for r in fill_middle.fill_middle(docs, spread=spread, chunk=chunk).collect()]
        assert sorted(got, key=str) == want
    assert fill_middle.fill_middle(docs.limit(0)).collect() == []
    forms = spark.range(300).selectExpr("id AS doc_id", "'some text <S and more words' AS text")
    got = sorted((tuple(r) for r in fill_middle.fill_middle(forms).collect()))
    assert got == [plain_fim(k, "some text <S and more words") for k in range(300)]
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


# --- 12: vector codes


def plain_codes(rows, entries, rounds, parts=4):
    kept = []
    for vec_id, x, label in rows:
        if x is None or not len(x) or len(x) % parts or any(c is None or not np.isfinite(c) for c in x):
            continue
        whole = [int(np.floor(min(max(c * 1024, -(2.0**24)), 2.0**24))) for c in map(float, x)]
        kept.append((vec_id is None, vec_id, whole, label))
    kept.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    if not kept:
        return [], []
    each = len(kept[0][2]) // parts
    cut = [[tuple(r[2][k * each : k * each + each]) for k in range(parts)] for r in kept]
    books = [[list(r[k]) for r in cut[:entries]] for k in range(parts)]

    def near(p, book):
        far = [sum((a - b) ** 2 for a, b in zip(p, e)) for e in book]
        return min(range(len(far)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        for k in range(parts):
            of = [near(r[k], books[k])[0] for r in cut]
            for e in set(of):
                mine = [r[k] for r, o in zip(cut, of) if o == e]
                books[k][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for (_, vec_id, _, label), r in zip(kept, cut):
        found = [near(r[k], books[k]) for k in range(parts)]
        out.append((vec_id, label, [f[0] for f in found], sum(f[1] for f in found)))
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    return [(v, x, c, e, total[x]) for v, x, c, e in out], books


def test_vector_codes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(np.float32(c)) for c in rng.normal(size=8) / 4], int(k % 3) if k % 7 else None) for k in rng.permutation(90)]
    rows += [(200 + k, [0.25] * 8, 1) for k in range(60)]  # one very common vector
    rows += [(300 + k, [0.25, -0.5] + [float(k)] * 6, 2) for k in range(20)]  # and one common part
    rows += [(5, rows[0][1], 0), (5, [9.5] * 8, 0), (None, [0.1] * 8, None), (None, [0.1] * 8, None)]  # repeated and null ids
    rows += [(400, None, 1), (401, [0.1] * 7 + [None], 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, 1), (404, [0.5] * 4, 1), (405, [], 1), (406, [0.5] * 6, 1)]
    table = spark.createDataFrame([(*r, 0.0, "x") for r in rows], "vec_id long, embedding array<float>, label int, error double, codes string").repartition(5)
    want, books = plain_codes(rows, 16, 4)
    for hot in (20_000, 10):  # by shuffle, and with broadcasts of the common parts
        monkeypatch.setattr(vector_codes, "HOT", hot)
        out, got = vector_codes.compress(table, entries=16)
        assert got.tolist() == books
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    none, _ = vector_codes.compress(table.filter("vec_id >= 400"), entries=16)
    assert none.filter("vec_id != 404").count() == 0
    assert vector_codes.compress(table.limit(0))[0].count() == 0


def test_nearest_stays_exact_for_large_components():
    x = np.array([[1 << 24, -(1 << 24)] * 8, [(1 << 24) - 1, -(1 << 24)] * 8], np.int64)
    entry, error = vector_codes.nearest(x, np.vstack([-x[:1], x[1:], x[1:]]))
    assert entry.tolist() == [1, 1] and error.tolist() == [8, 0]


# --- 11: language identification


def plain_grams(text, sizes=language_id.SIZES):
    words = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in text.lower()))
    return [f"\0{w}\0"[k : k + n] for w in words for n in sizes for k in range(len(w) + 3 - n)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abÉß9 .\nж", max_size=25), min_size=1, max_size=5))
def test_grams(texts):
    h, at, has = language_id.gram_hashes(texts)
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]
    for k, text in enumerate(texts):
        grams = plain_grams(text)
        mine = h[at == k]
        assert len(mine) == len(grams) and len(set(mine.tolist())) == len(set(grams))


def test_filters_hold_each_gram_of_each_language(spark):
    words = {"aa": ["bana", "lupo", "tiri"], "bb": ["krast", "welm", "tiri"], "cc": ["ноло", "ведра"]}
    rows = [(100 * k + i, " ".join([w[i % len(w)], w[(i + 1) % len(w)], "tiri"]), lang) for k, (lang, w) in enumerate(words.items()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["aa", "bb", "cc"]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    for j, lang in enumerate(model.languages):
        held = {}
        for _, text, own in learned:
            if own == lang:
                for g in set(plain_grams(text)):
                    held[g] = held.get(g, 0) + 1
        n = sum(own == lang for _, _, own in learned)
        grams = [g for g, k in held.items() if k >= max(2, language_id.SHARE * n)]
        known, total, _ = model.counts([g.strip("\0") for g in grams if len(g) == 4 and g[0] == g[-1] == "\0"])
        assert (known[:, j] == total).all()  # no n-gram of a language is missed
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 for i, _, lang in rows)


def test_counts_are_corrected_for_chance():
    slices = np.zeros((64, 1), np.uint64)
    slices[:32, 0] = 1  # the first language's slice is half full
    slices[:, 0] |= np.uint64(2)  # the second one's is full: it knows everything by chance
    model = language_id.LanguageFilters(["x", "y"], slices, [5, 9])
    assert model.chance.tolist() == [0.125, 1.0]
    known, total, _ = model.counts(["some longer words of no language at all"])
    lang, score = model.predict(["some longer words of no language at all"])
    sure = max(known[0, 0] - total[0] * 0.125, 0) / 0.875
    assert known[0, 1] == total[0] and lang == (["x"] if sure > 0 else ["y"]) and score.tolist() == [1.0 if sure > 0 else 0.0]


def test_languages_of_odd_rows(spark):
    rows = [(k, "le petit chat dort " * 3, "fr") for k in range(40)] + [(100 + k, "der kleine hund schläft " * 3, "de") for k in range(20)]
    rows += [(300, None, "fr"), (301, "", "de"), (302, "123 !?", "de"), (303, "ψψψψ", None), (304, "ein hund", None), (None, "le chat", "fr"), (0, "le petit chat dort " * 3, "fr"), (305, "der hund " * 400_000, "de"), (306, "x" * 3_000_000, None)]
    docs = spark.createDataFrame([(*r, 0.5, "n") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    model = language_id.fit(docs)
    out = language_id.identify(docs, model)
    got = {(r.doc_id): (r.lang_pred, r.score) for r in out.collect()}
    assert out.count() == len(rows) and out.columns == ["doc_id", "lang_pred", "score"]
    assert got[300] == got[301] == got[302] == ("und", 0.0)
    assert got[303] == ("de", 0.0)  # nothing is known: the language with the most characters
    assert got[304][0] == "de" and got[None][0] == "fr" and got[305][0] == "de"
    assert language_id.identify(docs.limit(0), model).count() == 0
    nothing = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_sample_is_bounded_by_language(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('word number ', id) AS text", "if(id % 100 = 0, 'rare', 'often') AS lang")
    sizes = {r["lang"]: r["count"] for r in language_id.training_sample(docs, most=50).groupBy("lang").count().collect()}
    assert sizes["often"] == 50 and 5 <= sizes["rare"] <= 20
    assert language_id.training_sample(docs, most_chars=100).groupBy("lang").agg(F.sum(F.length("text")).alias("n")).filter("n > 100").count() == 0


def test_segments_are_cut_between_words():
    text = "abc def ghi " * 50
    assert "".join(language_id.segments(text, 20)) == text
    h, _, _ = language_id.gram_hashes(list(language_id.segments(text, 20)))
    assert sorted(h.tolist()) == sorted(language_id.gram_hashes([text])[0].tolist())


@pytest.mark.parametrize("n", [1, 63, 64, 130])
def test_masks_of_many_languages(spark, n):
    docs = spark.createDataFrame([(16 * k + i, " ".join([chr(0x4E00 + 7 * k + j) * 3 for j in range(3)]), f"l{k:03d}") for k in range(n) for i in range(4)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    out = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert model.slices.shape[1] == -(-len(model.languages) // 63)
    learned = set(model.languages)
    assert all(out[r.doc_id] == r.lang for r in docs.collect() if r.lang in learned)
