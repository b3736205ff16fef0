"""Weights, scores and ranks against plain Python, and odd tables."""

import hashlib
import math
import re
import zlib

from common import SF, odd_documents

from tessera.llm import resampling


def plain(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """docs: (id, text). Rows (id, n_features, weight, score, rank); documents that tie come in the order of their ids."""

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    of, to = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in features(text):
            of[b] += 1
    for text in target:
        for b in features(text):
            to[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(of) + buckets) / ((s + 1) * (sum(to) + buckets)))) for s, t in zip(of, to, strict=True)]
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features(text))
        rows.append((i, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    out = [(*r[:4], k if k <= len(enough) * percent // 100 else None) for k, r in enumerate(enough, 1)]
    return sorted([*out, *((*r[:4], None) for r in rows if r[4] < least)], key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(resampling.query(spark, SF)) == plain(docs, target)


def test_runs_of_two_words_and_few_buckets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = rows_of(resampling.resample(docs.repartition(5), target, percent=33, buckets=97, longest=2, least_words=1, seed=7))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 2, 97, 33, 1, 7)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    for target in (docs.where("doc_id >= 6").select("text"), docs.select("text").where("false")):
        got = rows_of(resampling.resample(docs, target, percent=50, least_words=2))
        assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent=50, least=2)
    assert resampling.resample(odd_documents(spark, empty=True), docs).count() == 0


def test_blocks_hold_every_row(spark):
    docs = odd_documents(spark).selectExpr("doc_id id", "text")
    blocks = resampling.count_blocks(docs.repartition(3), 50, 1).collect()
    assert sorted(map(str, (i for b in blocks for i in b.ids))) == sorted(str(r.id) for r in docs.collect())
    assert all(len(b.ids) == len(b.n_words) == len(b.ends) and len(b.buckets) == len(b.counts) == 4 * b.ends[-1] for b in blocks)
