"""Quality rules: statistics against brute force, and what weak supervision makes of votes."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from common import SF, odd_documents
from tessera.llm import quality as Q
from tessera.llm.quality import expectation_maximisation, judge, statistics

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = statistics(docs).collect()
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in rows} == {d: brute_force(t) for d, t in texts.items()}


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a a a a a a", "a b c d e f a b c d e f g", "a b c d", "x\x0by\x0cz\r\n\n\ta", "l1\nl2\nl1 \nl1\n \n ", "a b c d e b c d e a b c d e b c d e x a b c d e"])
def test_small_texts(spark, text):
    r = statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(r[n] for n in NAMES) == brute_force(text)


def test_expectation_maximisation_finds_the_reliable_rule(spark):
    # 70 % good; rule a is right in 95 % of cases, b in 60 %, d and e in 85 %; c abstains always.
    rows, rng = [], random.Random(4)
    for _ in range(3000):
        good = rng.random() < 0.7
        a, b, d, e = (good if rng.random() < right else not good for right in (0.95, 0.6, 0.85, 0.85))
        rows.append((1 if a else -1, 1 if b else -1, 0, 1 if d else -1, 1 if e else -1))
    w = expectation_maximisation(spark.createDataFrame(rows, "a int, b int, c int, d int, e int"), ["a", "b", "c", "d", "e"], rounds=40)
    assert w.of["a", 1] > w.of["d", 1] > w.of["b", 1] >= 0 and w.of["a", -1] < w.of["d", -1] < w.of["b", -1] <= 0 and abs(w.of["c", 0]) < 0.1


def test_verdicts(spark):
    judged = judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = judged.join(labels, "doc_id").groupBy(labels["quality"].alias("label")).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {x.label: x.k for x in r}
    assert rate[1] > 0.97 and rate[0] < 0.2


def test_odd_tables(spark):
    got = judge(odd_documents(spark)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert all(by[d].base_failed and not by[d].kept and by[d].n_words == by[d].n_repeat_words == 0 for d in (1, 2, 3))
    assert judge(odd_documents(spark, empty=True)).count() == 0
    assert statistics(spark.read.parquet(f"{SF}/documents.parquet").limit(3)).columns[:1] == ["doc_id"]


def test_kept_against_plain_expectation_maximisation(spark):
    """The same estimate text by text in plain Python, from the votes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    votes = Q.rules()
    rows = {r.doc_id: r for r in Q.statistics(docs).withColumns(votes).collect()}
    names, weight, prior = list(votes), 20.0, 0.8
    bias, of = math.log(prior / (1 - prior)), {(r, v): math.log(Q._GOOD[v] / Q._BAD[v]) if v else 0.0 for r in names for v in (-1, 0, 1)}
    good = lambda r: 1 / (1 + math.exp(-(bias + sum(of[n, r[n]] for n in names))))
    for _ in range(12):
        p = {d: good(r) for d, r in rows.items()}
        all_good, all_bad = sum(p.values()), sum(1 - x for x in p.values())
        new = {}
        for n in names:
            for v in (-1, 0, 1):
                own = [d for d, r in rows.items() if r[n] == v]
                on_good = (sum(p[d] for d in own) + weight * Q._GOOD[v]) / (all_good + weight)
                on_bad = (sum(1 - p[d] for d in own) + weight * Q._BAD[v]) / (all_bad + weight)
                odds = math.log(on_good / on_bad)
                new[n, v] = max(odds, 0.0) if v > 0 else min(odds, 0.0) if v < 0 else odds
        share = (all_good + prior * weight) / (all_good + all_bad + weight)
        bias, of = math.log(share / (1 - share)), new
    got = Q.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.quality == pytest.approx(good(rows[r.doc_id]), abs=1e-9)
        assert r.kept == (not r.base_failed and good(rows[r.doc_id]) >= 0.5)


def test_columns_named_like_helpers(spark):
    names = ["_words", "_hashes", "_windows", "_sorted", "_at", "_lines", "_twice", "row", "votes", *Q.rules()]
    docs = spark.createDataFrame([(1, "some words of a plain text that is long enough to be kept here", *names), (2, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    rows = Q.judge(docs).collect()
    assert len(rows) == 2 and all(r[n] == n for r in rows for n in names) and {r.doc_id: r.n_words for r in rows} == {1: 14, 2: 0}
    assert [r.n_words for r in Q.judge(docs.withColumn("n_words", docs["text"]), carry=["doc_id", "n_words"]).orderBy("doc_id").collect()] == [14, 0]
