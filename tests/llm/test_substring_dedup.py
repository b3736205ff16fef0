"""Substring deduplication: planted passages go, first occurrences and clean texts stay."""

import random

import duckdb

from common import odd_documents
from tessera.llm.substring_dedup import ORACLE_SQL, find_repeats, query, remove_spans

VOCABULARY = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "r", "ll", "th")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", "", "", "", ".", ","]) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (55, 70, 120, 300)]
    texts, planted = {}, {}
    for d in range(60):
        words = prose(rng, 150).split(" ")
        if d % 3 == 0:
            p = passages[(d // 3) % 4]
            at = rng.randrange(len(words))
            head = " ".join(words[:at])
            texts[d] = head + " " + p + " " + " ".join(words[at:])
            planted[d] = (len(head) + 1, len(head) + 1 + len(p), (d // 3) % 4)
        else:
            texts[d] = " ".join(words)
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    spans = find_repeats(docs)
    rows = spans.collect()
    first = {min(d for d, p in planted.items() if p[2] == k) for k in range(4)}
    assert {r.doc_id for r in rows} == set(planted) - first
    for d, (s, e, k) in planted.items():
        own = [r for r in rows if r.doc_id == d]
        if d in first:
            continue
        assert sum(r.end - r.start for r in own) > 0.95 * (e - s)
        for r in own:
            assert s - 15 <= r.start and r.end <= e + 15
            assert planted[r.kept_doc_id][2] == k
    cleaned = {r.doc_id: r.text for r in remove_spans(docs, spans).collect()}
    for d, t in texts.items():
        own = sorted((r.start, r.end) for r in rows if r.doc_id == d)
        for s, e in reversed(own):
            t = t[:s] + t[e:]
        assert cleaned[d] == t


def test_lines_case_and_own_repeats(spark):
    line = "This Notice Must Stay With All Copies Of The Text And May Not Be Changed By Anyone Who Passes It On In Any Form Whatever"
    docs = spark.createDataFrame([(5, f"alpha\n{line}\nbeta"), (3, f"{line.upper()}  \ngamma\n{line}"), (9, "short line\nshort line")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.kept_doc_id) for r in find_repeats(docs).collect())
    second = len(line) + 2 + 1 + 5 + 1
    assert got == [(3, second, second + len(line), 3), (5, 6, 6 + len(line), 3)]


def test_odd_tables(spark):
    got = find_repeats(odd_documents(spark)).collect()
    # The long text repeats itself, and rows 4 and 5 are copies; texts of a few words aren't passages.
    assert {r.doc_id for r in got} <= {4, 5} and {r.doc_id for r in got} >= {5}
    assert find_repeats(odd_documents(spark, empty=True)).count() == 0
    odd = odd_documents(spark)
    assert remove_spans(odd, find_repeats(odd)).columns == odd.columns and remove_spans(odd, find_repeats(odd)).count() == 11


def brute_force(texts, n=20):
    """Words of every text that are part of a window of n words which stands earlier, in another text or apart in the same."""
    seen, out = {}, set()
    for d, t in sorted(texts.items()):
        w = t.lower().split()
        for k in range(len(w) - n + 1):
            first = seen.setdefault(tuple(w[k : k + n]), (d, k))
            if first[0] != d or k - first[1] >= n:
                out |= {(d, j) for j in range(k, k + n)}
    return out


def test_every_repeat_from_min_words_on(spark):
    rng = random.Random(5)
    # Sentences end and lines break after every word or two, and passages of 19 to 23 words lie among others.
    passages = [prose(rng, n).split(" ") for n in (19, 20, 21, 23, 60, 300)]
    lists = ["\n".join(prose(rng, 60).split(" ")), "\n".join(f"{w}. {v}!" for w, v in zip(prose(rng, 30).split(" "), prose(rng, 30).split(" ")))]
    texts = {}
    for d in range(48):
        parts = [*prose(rng, rng.randrange(12)).split(" "), *passages[d % 6], *prose(rng, rng.randrange(1, 12)).split(" ")]
        texts[d] = (rng.choice([" ", "\n"])).join(parts) + "\n" + lists[d % 2]
    # A phrase that stands earlier in other company, a changed word between equal stretches, and a text that repeats itself.
    w = prose(rng, 50).split(" ")
    texts[50], texts[51], texts[52], texts[53] = " ".join(w[10:22]), " ".join(w), " ".join(w[:25] + ["changed"] + w[26:]), " ".join(w[:7] * 9)
    rows = find_repeats(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()
    got = set()
    for r in rows:
        before = len(texts[r.doc_id][: r.start].split())
        n = len(texts[r.doc_id][r.start : r.end].split())
        assert n == r.n_words
        got |= {(r.doc_id, k) for k in range(before, before + n)}
    assert got == brute_force(texts) and (52, 25) not in got and (52, 24) in got


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(ORACLE_SQL).select('doc_id, "start", "end", n_words').fetchall())
    assert want and sorted(map(tuple, query(spark, sf).collect())) == want


def test_short_lines_and_paragraphs(spark):
    """Lines of ten words and paragraphs of short lines: the first stays, all others go, and every line still stands somewhere."""
    rng = random.Random(9)
    line, block = prose(rng, 10), "\n".join(prose(rng, 6) for _ in range(4))
    texts = {d: f"{prose(rng, 12)}\n\n  {line.upper() if d % 2 else line}\n\n{block}\n\n{prose(rng, 9)}" for d in range(30)}
    texts[40], texts[41] = f"{line}. / B.", f"{prose(rng, 30)}\nonly here once\n{prose(rng, 30)}"
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    spans = find_repeats(docs, line_words=8)
    rows = spans.collect()
    assert {r.doc_id for r in rows} == set(range(1, 30))
    for r in rows:
        assert (r.kept_doc_id, r.n_words) in {(0, 10), (0, 24), (0, 34)} and r.end <= len(texts[r.doc_id])
    cleaned = {r.doc_id: r.text for r in remove_spans(docs, spans).collect()}
    plain = lambda t: {" ".join(x.lower().split()) for x in t.split("\n") if x.strip()}
    assert set().union(*map(plain, texts.values())) == set().union(*map(plain, cleaned.values()))
    assert all(len(cleaned[d].split()) == 21 for d in range(1, 30)) and cleaned[40] == texts[40] and cleaned[41] == texts[41]
    # Without short lines only the paragraphs go.
    assert {r.n_words for r in find_repeats(docs).collect()} == {34}


def test_bridges_and_kept_copies(spark):
    """What stands once stays, and so does one copy of everything that goes."""
    rng = random.Random(6)
    a, b, x, u = (prose(rng, 25) for _ in range(4))
    texts = {0: f"{a}\n{x}\n{b}", 1: f"{a}\n{u}\n{b}", 2: f"{prose(rng, 5)}\n{u}\n{prose(rng, 5)}", 3: f"{a}\nonly here once\n{b}"}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    cleaned = {r.doc_id: r.text.split("\n") for r in remove_spans(docs, find_repeats(docs)).collect()}
    assert cleaned[0] == texts[0].split("\n") and cleaned[1] == ["", u, ""] and u not in cleaned[2] and cleaned[3] == ["", "only here once", ""]


def test_two_texts_of_one_id(spark):
    rng = random.Random(2)
    p = prose(rng, 60)
    rows = [(1, f"{prose(rng, 8)} {p}"), (1, f"{prose(rng, 12)} {p} {prose(rng, 3)}"), (1, f"{prose(rng, 4)}"), (2, p), (2, p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r.text.count(p) for r in remove_spans(docs, find_repeats(docs)).collect())
    assert left == [0, 0, 0, 0, 1]


def test_columns_named_like_helpers(spark):
    rng = random.Random(4)
    names, p = ["row", "doc", "cuts", "_rank", "_hash", "_cuts", "text_hash", "start"], prose(rng, 30)
    docs = spark.createDataFrame([(1, p, *names), (2, p, *names), (None, p, *names), (3, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = remove_spans(docs, find_repeats(docs))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, p, *names), (2, "", *names), (None, p, *names), (3, None, *names)], key=repr)
