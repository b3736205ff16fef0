"""The pipeline stage by stage against brute force, on the small tables."""

import re

import corpus_pipeline as P
from tessera.llm.storage import materialize
from common import odd_documents
from test_decontaminate import brute_force as leaks
from test_ngram_join import brute_force as near
from test_pii import brute_force as personal

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    steps = {}
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
        steps[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {n: {r.doc_id: r for r in d.collect()} for n, d in steps.items()}
    first = {d for d, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    assert set(rows["language ID"]) == first
    groups = near([(d, texts[d]) for d in first])
    second = {g[3] for g in groups.values()}
    assert set(rows["n-gram Jaccard join"]) == second
    hit = {d for d, _ in leaks([(d, texts[d]) for d in second], bench)}
    third = second - hit
    assert set(rows["benchmark decontamination"]) == third and hit
    for d, r in rows["personal data"].items():
        assert r.n_chars == len(r.text) and not personal(r.text)
        if not personal(texts[d]):
            assert r.text == texts[d]
    assert set(rows["personal data"]) == set(rows["BPE encoding and decoding"]) == third
    assert {r.doc_id: r.ids_sha256 for r in P.run(spark, SF).collect()} == {d: r.ids_sha256 for d, r in rows["BPE encoding and decoding"].items()}


def test_stages_on_odd_tables(spark):
    """Nulls in all columns, empty and long texts, repeated rows, clashing columns, no rows."""
    for empty in (False, True):
        docs = odd_documents(spark, empty)
        for name, stage in P.STAGES:
            out = materialize(stage(spark, docs, SF), "odd")
            if name != P.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = out
        rows = out.collect()
        assert sorted((r.doc_id for r in rows), key=str) == ([] if empty else [4, 4, 6, 9, None])
    repeated = spark.createDataFrame([(k, "Ann writes from ann@mail.org to all", "en", "s", 35) for k in (1, 1, 2)], "doc_id long, text string, lang string, source string, n_chars long")
    clean = [r.text for r in P.personal_data(spark, repeated, SF).collect()]
    assert clean == ["Ann writes from <EMAIL> to all"] * 3
