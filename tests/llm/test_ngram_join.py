"""The n-gram Jaccard join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import SF, odd_documents
from tessera.llm import ngram_join as N
from tessera.llm.components import components


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(rows, t=0.8):
    sets = {d: shingles(x) for d, x in rows}
    near = defaultdict(set)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                near[a].add(b), near[b].add(a)
    classes = {}
    for d in ids:
        classes[d] = next((e for e in ids if sets[e] == sets[d] and sets[d]), d)
    group = {}
    for d in ids:
        if d not in group:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = d
                    todo += near[x]
    return {d: (classes[d], len({classes[x] for x in near[d]} - {classes[d]}), len(near[d]), group[d]) for d in ids}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_similar_docs, r.group_id) for r in df.collect()}


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(N.ngram_join(docs)) == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_large_cluster_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "_BLOCK_DOCS", 16)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for d in range(150):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(150)] = rng.choice(words)
        rows.append((d * 7 % 150, " ".join(own)))
    rows += [(1000 + d, " ".join(rng.choice(words) for _ in range(80))) for d in range(40)]
    assert result(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)


def test_keep_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = N.keep_one(docs)
    want = {g for *_, g in brute_force([(r.doc_id, r.text) for r in docs.collect()]).values()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_prefix_length():
    assert N.prefix_lengths(20, 0.999, 0.8) == [8, 6, 5] and N.prefix_lengths(20, 0.5, 0.8) == [8]
    assert N.prefix_length(20, 0.999, 0.8) == 5 and N.prefix_length(1, 0.999, 0.8) == 1 and N.prefix_length(20, 0.5, 0.8) == 8


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(500, 560)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_tables(spark):
    rows = N.ngram_join(odd_documents(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10  # the row without an id is left out; the repeated row stays
    assert by[5].class_id == 4 and by[5].n_links == 0 and by[5].n_similar_docs == 2 and by[7].class_id == 6
    assert all(by[d].class_id == d and by[d].n_similar_docs == 0 for d in (1, 2, 3, 8, 9))
    assert N.ngram_join(odd_documents(spark, empty=True)).count() == 0
    assert N.keep_one(odd_documents(spark)).count() == 9  # both rows of the kept id 4, and the row without an id


def test_prefixes_are_shortened_where_needed(spark, monkeypatch):
    """A group far above the threshold is done at the longest prefix; pairs just above it are found at shorter ones."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows, levels = [], []
    base = [rng.choice(words) for _ in range(400)]
    for d in range(60):
        own = list(base)
        own[rng.randrange(400)] = rng.choice(words)
        rows.append((d, " ".join(own)))
    for d in range(120):
        own = [rng.choice(words) for _ in range(400)]
        rows.append((1000 + 2 * d, " ".join(own)))
        for _ in range(7):  # up to 35 of 396 shingles differ
            own[rng.randrange(400)] = rng.choice(words)
        rows.append((1001 + 2 * d, " ".join(own)))
    verify = N._verify

    def watched(sets, now, *args):
        out = verify(sets, now, *args)
        levels.append((args[-1], {r.digest for r in now.where(F.col("active").bitwiseAND(1 << args[-1]) != 0).select("digest").collect()}, {r.digest for r in out.collect()}))
        return out

    monkeypatch.setattr(N, "_verify", watched)
    assert result(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)
    assert [x[0] for x in levels] == [0, 1, 2]
    assert len(levels[0][2]) >= 60 and len(levels[1][1]) <= len(levels[0][1]) - 60  # the group is done
    assert levels[1][2] or levels[2][2]


def test_only_pairs_that_met_are_compared(spark):
    """A chain of texts that each share much with the next, and nothing with the one after some more."""
    rng = random.Random(1)
    long = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    rows = [(d, " ".join(long[d * 8 : d * 8 + 200])) for d in range(300)]
    assert result(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)


def test_two_texts_of_one_id(spark):
    rng = random.Random(3)
    a, b = (" ".join(f"w{rng.randrange(500)}" for _ in range(90)) for _ in range(2))
    docs = spark.createDataFrame([(3, a), (1, b), (1, a), (2, b), (4, b + " more"), (4, "quite another text of its own here")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in N.keep_one(docs).collect())
    assert got == sorted([(1, b), (1, a), (4, "quite another text of its own here")])


def test_a_class_that_searches_again(spark):
    """Two equal prefixes at both lengths: who searched at the first is not compared again, whoever didn't is."""
    shingles = np.arange(10, dtype=np.uint64)
    for masks, found in (((0b10, 0b00), 2), ((0b11, 0b00), 0), ((0b01, 0b10), 0), ((0b00, 0b10), 2), ((0b00, 0b01), 0)):
        rows = [(1, 1, 1, f"d{k}", 1, 10, [5, 6], mask, bytearray((shingles + np.uint64(k)).tobytes())) for k, mask in enumerate(masks)]
        table = spark.createDataFrame(rows, "i long, j long, block long, digest string, n_docs long, n_shingles long, keys array<long>, active int, shingles binary")
        assert N._compare(table.coalesce(1), 0.8, 1, [2, 1], 1).count() == found
        under = spark.createDataFrame([(k, [5, 6], mask) for k, mask in enumerate(masks)], "node long, keys array<long>, active int")
        assert N._shared_prefixes(under, 1, 1).count() == (2 if found else 0) or masks == (0b01, 0b10)


def test_columns_named_like_helpers(spark):
    names = ["doc", "row", "digest", "_id", "_hash", "node", "h", "id", "class_doc", "group_doc"]
    docs = spark.createDataFrame([(1, "one two three four five six", *names), (2, "one two three four five six", *names), (3, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted([(1, "one two three four five six", *names), (3, None, *names)])
    assert N.ngram_join(docs).count() == 3
