"""Fingerprints against plain Python, components against all pairs, and odd tables."""

import itertools
import random
import re

import pytest
import xxhash
from common import SF, odd_documents

from tessera.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(bits, distance):
    """bits: fingerprints by id."""
    parent = {b: b for b in bits.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= distance:
            parent[root(a)] = root(b)
    least = {}
    for i in sorted(bits):
        least.setdefault(root(bits[i]), i)
    return {i: least[root(b)] for i, b in bits.items()}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bits = {i: plain_fingerprint(t) for i, t in docs.items()}
    rows = simhash.query(spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{b:016x}" for i, b in bits.items()} and len(rows) == len(docs)
    assert {r.doc_id: r.component_id for r in rows} == plain_components(bits, 2)


@pytest.mark.parametrize(("distance", "segments"), [(0, 2), (1, 1), (2, 2), (2, 4), (3, 3), (4, 2)])
def test_components_of_made_fingerprints(spark, distance, segments):
    from tessera.llm.components import components

    rng = random.Random(distance)
    bits = {rng.getrandbits(64) for _ in range(6)} | {0, (1 << 64) - 1}
    for _ in range(70):  # chains whose steps are about as long as the distance
        b = rng.choice(sorted(bits))
        for _ in range(rng.choice([1, distance, distance, distance + 1])):
            b ^= 1 << rng.randrange(64)
        bits.add(b)
    signed = {b: b - (1 << 64) if b >> 63 else b for b in bits}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "bits long")
    reached = {r.id: r.component for r in components(simhash.links(nodes, distance, segments)).collect()}
    mine = {b: reached.get(s, s) for b, s in signed.items()}
    want = plain_components({b: b for b in bits}, distance)
    same = lambda of: sorted(sorted(b for b in bits if of[b] == k) for k in set(of.values()))
    assert same(mine) == same(want)


def test_balls_are_whole():
    assert len(simhash.segment_balls(1)) == 65 and all(len(simhash.segment_balls(2, s)) == 1 + 64 + 64 * 63 // 2 for s in (1, 2, 3))
    with pytest.raises(ValueError):
        simhash.links(None, 5)


def test_large_group_of_copies_stays_linear(spark):
    near = [(k, 5 ^ (1 << k % 32) ^ (1 << 32 + k // 32 % 32)) for k in range(1024)]
    nodes = spark.createDataFrame([(b if b < 1 << 63 else b - (1 << 64),) for b in {b for _, b in near}], "bits long")
    assert simhash.links(nodes).count() <= 65 * 1024


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(str(k % 977) for k in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = simhash.near_copies(docs).collect()
    assert sorted((str(r.doc_id), r.bits % (1 << 64)) for r in rows) == sorted((str(i), plain_fingerprint(t)) for i, t in texts)
    by_bits = {}
    for r in rows:
        by_bits.setdefault(r.bits, []).append(r)
    assert all(r.n_same == len(rs) and (r.component_id is None or r.component_id <= r.doc_id if r.doc_id is not None else True) for rs in by_bits.values() for r in rs)
    assert {r.component_id for r in rows if r.bits == 0} == {1} and {r.component_id for r in rows if r.doc_id is None} == {None}
    assert simhash.near_copies(odd_documents(spark, empty=True)).count() == 0


def test_components_that_do_not_end_raise(spark):
    from tessera.llm.components import components

    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"), most_rounds=1)
