"""The cache bounded by bytes against one that runs, and numbers of rows in one order."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import byte_cache
from tessera.operators.order import numbered


def plain(log, most, ttl):
    """(hits by id, outcomes by id, evictions) of a cache that is run."""
    held, total, seen, evictions, outcomes = OrderedDict(), 0, set(), 0, {}
    for i, key, t, size in sorted(log, key=lambda r: (r[2], r[0])):
        size = size or 0
        if key in held and t < held[key][1]:
            outcomes[i] = "hit"
            held.move_to_end(key)
            held[key] = (held[key][0], t + ttl)
            continue
        outcomes[i] = "oversize" if size > most else "expired" if key in held else "evicted" if key in seen else "first"
        seen.add(key)
        if key in held:
            total -= held.pop(key)[0]
        if size > most:
            continue
        held[key] = (size, t + ttl)
        total += size
        while total > most:
            total -= held.popitem(last=False)[1][0]
            evictions += 1
    return outcomes, evictions


def table(spark, log):
    return spark.createDataFrame(log, "id long, key string, t double, size long")


@pytest.mark.parametrize(("keys", "most", "ttl", "ranges"), [(30, 600, 1e9, 1000), (30, 600, 40.0, 70), (200, 900, 300.0, 37), (5, 10_000, 5.0, 100), (60, 50, 1e9, 55)])
def test_equals_a_cache_that_runs(spark, keys, most, ttl, ranges):
    rng = random.Random(keys + ranges)
    sizes = {k: rng.choice([0, rng.randrange(1, 100), rng.randrange(1, 100), 2 * most]) for k in range(keys)}
    # A third of all requests are for one key; times repeat, and ids settle them.
    log = [(d * 7 % 701, f"k{k}", float(rng.randrange(400)), sizes[k] or None) for d in range(701) for k in [0 if rng.random() < 0.33 else rng.randrange(keys)]]
    found = byte_cache.byte_lru(table(spark, log), most, ttl, rows_per_range=ranges)
    rows = found.collect()
    outcomes, evictions = plain(log, most, ttl)
    assert {r.id: r.outcome for r in rows} == outcomes and all(r.hit == (r.outcome == "hit") for r in rows)
    total = byte_cache.lru_totals(found, most).first()
    hits = sum(v == "hit" for v in outcomes.values())
    assert (total.requests, total.hits, total.misses, total.evictions) == (701, hits, 701 - hits, evictions)


def test_nulls_and_no_requests(spark):
    log = [(1, None, 1.0, 5), (2, "a", 2.0, None), (3, None, 3.0, 5), (4, "a", 4.0, None)]
    rows = {r.id: r.outcome for r in byte_cache.byte_lru(table(spark, log), 10, 100.0).collect()}
    assert rows == {1: "first", 2: "first", 3: "hit", 4: "hit"}
    none = byte_cache.byte_lru(table(spark, []), 10, 100.0)
    assert none.count() == 0
    total = byte_cache.lru_totals(none, 10).first()
    assert (total.requests, total.hits, total.misses, total.evictions) == (0, 0, 0, 0)


def test_dominated_sums():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 64, 200):
        value, weight = rng.integers(0, max(1, n // 2), n), rng.integers(0, 50, n)
        want = [int(weight[:i][value[:i] < value[i]].sum()) for i in range(n)]
        assert byte_cache.dominated(value, weight).tolist() == want


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_numbers_and_running_sums(spark, ranges):
    rows = [(d, d * 37 % 100 // 3) for d in range(500)]
    found = numbered(spark.createDataFrame(rows, "id long, v long").repartition(5), [F.col("v").desc(), F.col("id")], {"sofar": "v"}, ranges).orderBy("position").collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.v) for r in found] == order and [r.position for r in found] == list(range(1, 501))
    assert [r.sofar for r in found] == np.cumsum([v for _, v in order]).tolist()
    assert [r["range"] for r in found] == sorted(r["range"] for r in found)
    assert numbered(spark.createDataFrame([], "id long, v long"), [F.col("id")]).count() == 0
