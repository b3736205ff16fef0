"""Language identification: Viterbi against brute force, accuracy on held-out texts, spans, odd tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import SF, odd_documents
from tessera.llm.langid import identify, learn, query, viterbi


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    length = np.array([5, 1, 3])
    first = np.cumsum(length) - length
    scores = rng.normal(size=(9, 3)).astype(np.float32) * 3
    labels = viterbi(scores.copy(), first, length, 2.0)
    for f, n in zip(first, length):
        value = lambda p: sum(scores[f + k, x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
        assert value(labels[f : f + n]) == pytest.approx(best, abs=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = query(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs)
    en = docs.where("lang = 'en'").orderBy("doc_id").first().text.replace("\n", " ")[:200]
    de = docs.where("lang = 'de'").orderBy("doc_id").first().text.replace("\n", " ")[:400]
    mixed = spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string")
    r = identify(mixed, model, spans=True).first()
    assert r.lang_pred == "de" and 0.5 < r.score < 0.8
    assert [s.lang for s in r.lang_spans] == ["en", "de"]
    assert abs(r.lang_spans[1].start - len(en)) < 12


def test_scripts(spark):
    rows = [("en", "the quick brown fox"), ("ru", "быстрая лиса прыгает"), ("ja", "日本語のテキスト"), ("xx", "123 !!")]
    model = learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == ["en", "ja", "ru"]
    got = identify(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "ru", "ja", "und"]


def test_odd_tables(spark):
    model = learn(spark.read.parquet(f"{SF}/documents.parquet"))
    got = identify(odd_documents(spark), model, spans=True)
    rows = got.collect()
    assert len(rows) == 11 and {c for c in odd_documents(spark).columns} <= set(got.columns)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 8} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert identify(odd_documents(spark, empty=True), model).count() == 0
    nothing = learn(odd_documents(spark, empty=True))
    assert {r.lang_pred for r in identify(odd_documents(spark), nothing).collect()} == {"und"}
    assert identify(odd_documents(spark), learn(odd_documents(spark).where(F.col("doc_id") == 9))).where("lang_pred = 'de'").count() == 7


def test_marks_alone_are_no_text(spark):
    model = learn(spark.createDataFrame([("ordinary words of a text", "en"), ("wörter eines textes", "de")], "text string, lang string"))
    rows = identify(spark.createDataFrame([(1, "́́ ̀"), (2, "́wordś ́"), (3, "a")], "doc_id long, text string"), model, spans=True).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in rows] == [True, False, False] and rows[0].score == 0 and rows[0].lang_spans == []
    assert [(s.start, s.end) for s in rows[1].lang_spans] == [(1, 7)]


def test_many_languages(spark):
    rows = [(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" * 4, f"l{k:03}") for k in range(600)]
    model = learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.langs) == 600 and model.scores.size <= 1 << 23
    got = identify(spark.createDataFrame(rows, "text string, truth string"), model).collect()
    assert sum(r.lang_pred == r.truth for r in got) > 590


def test_trigram_scores_by_hand(spark):
    labelled = [("abc abd", "x"), ("zzz abd", "y")]
    model = learn(spark.createDataFrame(labelled, "text string, lang string"))
    assert model.langs == ["x", "y"]
    # Every letter is one trigram, so a language's table adds up to its letters, and scores to one.
    assert np.allclose(np.exp(model.scores.astype(float)).sum(0), 1, atol=1e-3)
    assert identify(spark.createDataFrame([("abc",), ("zzz",)], "text string"), model).collect()[1].lang_pred == "y"
