"""The audit against counting row by row, and odd tables."""

import itertools
import random

import pytest
from common import SF, odd_documents
from pyspark.sql import functions as F

from tessera.llm import filter_audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(rows, filters="ABCDE"):
    """rows: (part, letters that fail, good, toxic). What ``audit`` returns, by walking through every order."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys(filters, 0)
        for order in itertools.permutations(filters):
            alive = own
            for step, f in enumerate(order, 1):
                removed = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                shapley[f] += len(removed)
                fails = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [len(alive), len(removed), fails - len(removed), sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("n", [1, 63, 64, 65, 700])
def test_bitmaps_equal_row_by_row(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "a", "b", "c"]), {f for f in "ABCDE" if rng.random() < 0.3}, rng.random() < 0.5, rng.random() < 0.2) for _ in range(n)]
    table = spark.createDataFrame([(p, *(f in fails for f in "ABCDE"), g or None, t) for p, fails, g, t in rows], "where string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    assert found(filter_audit.audit(table.repartition(3), list("ABCDE"), ["good", "toxic"], "where").withColumnRenamed("where", "part")) == plain(rows)


def test_two_filters_and_no_labels(spark):
    table = spark.createDataFrame([(None, True, True), (None, True, False), ("x", None, True)], "p string, one boolean, two boolean")
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(table, ["one", "two"], [], "p").collect()}
    assert rows["", "onetwo", 1] == (0, 2, 0, 1, 3) and rows["", "twoone", 2] == (0, 1, 1, 1, 3) and rows["x", "onetwo", 2] == (0, 1, 0, 1, 2) and len(rows) == 8
    with pytest.raises(ValueError):
        filter_audit.audit(table, list("abcdefg"), [], "p")


def verdicts(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return {f for f, bad in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), bool(set(text) & set("#$%&*|"))), strict=True) if bad}


def test_odd_documents(spark):
    docs = odd_documents(spark).unionByName(odd_documents(spark).where("doc_id = 6").withColumn("text", F.lit("One ONE one |")))
    rows = filter_audit.text_filters(docs).collect()
    texts = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    want = sorted((str(i), s, *sorted(verdicts(t) | ({"E"} if i is not None and any(u == t and j is not None and j < i for j, u, _ in texts) else set()))) for i, t, s in texts)
    assert sorted((str(r.doc_id), r.part, *(f for f in "ABCDE" if r[f])) for r in rows) == want
    assert filter_audit.audit(filter_audit.text_filters(odd_documents(spark, empty=True)), list("ABCDE"), [], "part").count() == 0


def test_labels(spark):
    flagged = spark.createDataFrame([(1, True), (2, True), (None, True), (3, False)], "doc_id long, A boolean").withColumn("part", F.lit("p"))
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    row = filter_audit.audit(filter_audit.with_labels(flagged, labels), ["A"], ["good", "toxic"], "part").first()
    assert (row.kept, row.removed, row.good_lost, row.toxic_lost) == (1, 3, 1, 1)


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i].text or "", i)
    label = lambda i, c: i in labels and labels[i][c] == 1
    rows = [(d.source or "", verdicts(d.text or "") | ({"E"} if first[d.text or ""] < i else set()), label(i, "quality"), label(i, "toxic")) for i, d in docs.items()]
    assert found(filter_audit.query(spark, SF)) == plain(rows)
