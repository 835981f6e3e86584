"""Empty tables, null ids, repeated ids and rows for every operator."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import decontaminate, html_text, line_crf, packing, quality_rules, secrets, simhash, suffix_dedup, token_records, toxicity
from foliant.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, kept boolean, score double, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "a b c " * 30), (None, None), (1, "a b c " * 30), (1, "a b c " * 30), (1, "other words here"), (2, ""), (3, "ü" * 4000)]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def runs(docs, benchmark, labels, tmp):
    path = f"file://{tmp}/rec"
    yield "quality", quality_rules.quality_rules(docs)
    yield "toxicity", toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    yield "secrets", secrets.scan_secrets(docs)
    yield "dedup", suffix_dedup.dedup_substrings(docs)
    yield "decontaminate", decontaminate.decontaminate(docs, benchmark)
    yield "records", token_records.token_starts(token_records.read_records(docs.sparkSession, path, token_records.write_records(docs, path, vocabulary())))
    yield "crf", line_crf.score_quality(docs, line_crf.fit(docs, labels))
    yield "simhash", simhash.near_duplicates(docs)


@pytest.mark.parametrize("empty", [True, False])
def test_rows(spark, odd, tmp_path, empty):
    docs = odd.limit(0) if empty else odd
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, out in runs(docs, benchmark, labels, tmp_path):
        ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.select("doc_id").collect())
        want = [] if empty else [(False, 0), (False, 0), (True, 1), (True, 1), (True, 1), (True, 2), (True, 3)]
        assert ids == want, name
    assert packing.best_fit_packing(docs).filter("piece = 0").count() == (0 if empty else 7)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == (0 if empty else 2 + 4)  # the two texts of id 1, ids 2 and 3, and the rows without one
    assert secrets.redact(docs).columns == docs.columns
    assert decontaminate.drop_contaminated(docs, benchmark).count() == (0 if empty else 4)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(pages).count() == 0


def test_null_ids_lose_to_numbered_ones(spark):
    text = "the very same sixty bytes of text, which stand in two rows at once"
    docs = spark.createDataFrame([(None, text + " x"), (5, text + " y")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert got[5] == 0 and got[None] >= len(text)
    assert suffix_dedup.dedup_substrings(docs.filter("doc_id is null")).agg(F.sum("n_removed")).first()[0] == 0


def test_words_of_letters_go_to_the_model_alone():
    """Ids are those of the library for whole texts, and the pre-tokenizer is not asked about words of Latin letters."""
    from foliant.llm.tokens import Encoder, vocabulary

    e = Encoder(vocabulary())
    texts = ["Über größere Wörter, señor\nThe same\n\nȺll ɏ", "ÀÖØöøÿ Àé×é ÷é éÞ é.é it's éͰ", *[f"{chr(c)} a{chr(c)}b {chr(c)}\n{chr(c)}z" for c in range(0x20, 0x300)]]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in e.encode(texts)] == want
    asked = []
    encode = e._encode
    e._encode = lambda units: (asked.extend(units), encode(units))[1]
    e.tokenizer = None  # words of letters need it no more
    assert [len(ids) > 0 for ids in e.encode(["naïve Straße", "mañana"])] == [True, True]
    assert asked == []
