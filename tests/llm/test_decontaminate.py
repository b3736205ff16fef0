"""Decontamination: every benchmark passage is found, also with substituted words; clean texts are left alone."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import SF, odd_documents
from tessera.llm import decontaminate as D
from tessera.llm.decontaminate import MASKS, SHORT, SHORT_MASKS, SHORTEST, best_overlap, best_stretch, decontaminate, differences

words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_force(docs, bench, min_tokens=12, identity=0.8):
    """Every diagonal of every pair, every stretch."""
    out = set()
    for d, text in docs:
        a = words(text)
        for i, item in bench:
            b = words(item)
            if len(b) < 8 or not set(zip(a, a[1:])) & set(zip(b, b[1:])):
                continue
            for shift in range(-len(b), len(a)):
                low, high = max(0, shift), min(len(a), shift + len(b))
                same = np.array([a[k] == b[k - shift] for k in range(low, high)], bool)
                if same.sum() < 6:
                    continue
                s, e = best_stretch(same, identity)
                if e - s >= min(min_tokens, len(b)) and same[s:e].sum() >= 8:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_best_stretch(seed):
    same = np.random.default_rng(seed).random(14) < 0.7
    s, e = best_stretch(same, 0.8)
    best = max((same[a:b].sum() for a in range(14) for b in range(a, 15) if same[a:b].sum() - 0.8 * (b - a) >= -1e-9), default=0)
    assert same[s:e].sum() == best and same[s:e].sum() >= 0.8 * (e - s) - 1e-9


def test_documents_against_brute_force(spark):
    docs, bench = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.createDataFrame(docs.orderBy("doc_id").collect(), docs.schema)
    got = {(r.doc_id, r.item_id) for r in decontaminate(docs, bench).collect()}
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got == want


def test_substitutions_and_offsets(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rng = np.random.default_rng(1)
    rows, want = [], set()
    for i, t in items.items():
        w = t.split()
        if len(w) < 15:
            continue
        for k in range(2, len(w) - 2, 7):  # a word in seven
            w[k] = f"other{rng.integers(99)}"
        rows.append((100 + i, "Ünrelated words before. " + " ".join(w) + " And words after."))
        want.add((100 + i, i))
    rows.append((1, "Nothing of the kind stands in this text, which is long enough to hold a passage of twelve words or more."))
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = dict(rows)
    for r in got:
        found = text[r.doc_id][r.start : r.end]
        assert len(words(found)) == r.n_aligned and r.start >= len("Ünrelated words before. ") and not found.endswith("after")


def test_odd_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "no id at all here today"), (None, "x y z x y z x y z x y z x y z")], "item_id long, text string")
    got = decontaminate(odd_documents(spark), bench)
    assert got.columns == ["doc_id", "item_id", "start", "end", "n_aligned", "n_same", "item_tokens"] and got.count() == 0
    assert decontaminate(odd_documents(spark, empty=True), bench).count() == 0
    assert decontaminate(odd_documents(spark), bench.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "so one two three four five six seven eight " * 3)] * 2, "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.start) for r in decontaminate(twice, bench).collect()] == [(1, 1, 3)]


def test_masks_fit_every_pattern():
    """All places of one substitution in five tokens; of 24 tokens or more, one of two halves has such a pattern."""
    for n in range(SHORTEST, 24):
        seen = [sum(1 << (at + k) for k in m) for m in (MASKS + SHORT_MASKS if n < SHORT else MASKS) for at in range(n - m[-1])]
        for bad in itertools.combinations(range(n), n // 5):
            hidden = sum(1 << k for k in bad)
            assert any(not hidden & m for m in seen), (n, bad)


def test_every_place_of_substitutions(spark):
    rows, bench, want = [], [], set()
    for n in (6, 10, 12):
        for k, bad in enumerate(itertools.combinations(range(n), n // 5)):
            item = 1000 * n + k
            tokens = [f"w{item}x{j}" for j in range(n)]
            bench.append((item, " ".join(tokens)))
            rows.append((item, "some words before " + " ".join("other" if j in bad else t for j, t in enumerate(tokens)) + " and after it"))
            want.add((item, item, n - len(bad)))
    # Twelve aligned tokens of a longer item, of which the last one differs; one more is too many.
    long = [f"long{j}" for j in range(40)]
    bench.append((1, " ".join(long)))
    rows += [(1, " ".join(["before", *long[:9], "x", long[10], "after"])), (2, " ".join(["before", *long[:9], "x", "y", "z", "after"]))]
    want.add((1, 1, 10))
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_same) for r in got} == want


def test_masks_are_spaced():
    assert all(len(m) <= m[-1] for m in MASKS + SHORT_MASKS)


def test_texts_of_one_word(spark):
    bench = spark.createDataFrame([(1, "again " * 20), (2, "again " * 11 + "never"), (3, "quite another item of more than twelve words that stands in none of them")], "item_id long, text string")
    rows = [(1, "again " * 20_000), (2, "Some words first. " + "again " * 15), (3, "never " * 20_000), (2, "the same id with another text")]
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.start, r.n_same) for r in got} == {(1, 1, 0, 20), (1, 2, 0, 11), (2, 1, 18, 15), (2, 2, 18, 11)}


def test_repeated_ids_and_items(spark):
    passage = "a passage of fourteen words which is long enough to be found in any text"
    bench = spark.createDataFrame([(7, passage), (7, "twelve quite different tokens under one item id and still it must be found"), (7, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "nothing here"), (1, f"x {passage}"), (1, f"x {passage}"), (2, "y y twelve quite different tokens under one item id and still it must be found")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.start) for r in decontaminate(docs, bench).collect()} == {(1, 7, 2), (2, 7, 4)} and decontaminate(docs, bench).count() == 2


def test_long_texts_of_equal_words_in_little_memory():
    """Twenty thousand equal words on both sides have 400 million pairs of places."""
    import tracemalloc

    a, b, at = np.full(20_000, 7), np.full(20_000, 7), np.arange(20_000)
    tracemalloc.start()
    shifts = differences(at, at)
    found = best_overlap(a, b, shifts, 12, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shifts.tolist() == list(range(-19_999, 20_000)) and found == (0, 20_000, 20_000) and most < 200 << 20


def test_differences(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 300, rng.integers(1, 60))) for _ in range(2))
        want = np.unique(x[:, None] - y[None, :])
        monkeypatch.setattr(D, "_PAIRS", 0)
        assert differences(x, y).tolist() == want.tolist()


def test_best_overlap_tries_all_diagonals():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = rng.integers(0, 3, rng.integers(1, 40)), rng.integers(0, 3, rng.integers(6, 30))
        shifts = np.arange(-len(b) + 1, len(a))
        best = None
        for shift in shifts.tolist():
            low, high = max(0, shift), min(len(a), shift + len(b))
            same = a[low:high] == b[low - shift : high - shift]
            s, e = best_stretch(same, 0.8, min(12, len(b)))
            hit = np.flatnonzero(same[s:e])
            if e - s >= min(12, len(b)) and len(hit) and (best is None or (len(hit), hit[0] - hit[-1]) > (best[2], best[0] + 1 - best[1])):
                best = low + s + int(hit[0]), low + s + int(hit[-1]) + 1, len(hit)
        assert best_overlap(a, b, shifts, 12, 0.8) == best


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_phrase_in_every_item_and_text(spark, monkeypatch, broadcast):
    """Every text meets every item by a phrase; only the texts that hold the rest of an item match, and they match it alone."""
    if not broadcast:
        monkeypatch.setattr(D, "_MOST_ROWS", 0)
    monkeypatch.setattr(D, "_ITEMS", 16)
    phrase = "as everyone has always known for sure"
    item = lambda k: f"{phrase} " + " ".join(f"w{k}x{j}" for j in range(14))
    bench = spark.createDataFrame([(k, item(k)) for k in range(100)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"text {d} {phrase} it {d}" if d % 5 else f"text {d} {item(d % 100)}") for d in range(400)], "doc_id long, text string")
    got = decontaminate(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_same) for r in got) == [(d, d % 100, 21) for d in range(0, 400, 5)]
    assert decontaminate(docs.where(F.col("doc_id") % 5 != 0), bench).count() == 0
