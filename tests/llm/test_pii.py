"""Personal data: base spans against Python's re; disclosing terms in a made corpus; redaction."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import regex

from common import odd_documents
from tessera.llm.pii import find, query, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_force(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


ODD = [
    "a@b.c_d@e.f x@y.z..w@q.r", "1.2.3.4.5.6.7.8", "0255.00001.1.256 0255.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 and +1234", "x" * 3000 + "@" + "y.z" * 500,
    "é@b.co ü 日本 +49 30 1234567.", "@@@ a@b a@b. a@-.-", "+1+2345678901 ((", "12 34 56 78 90 12 34 56 78 90", "1..2.3.4.5", "a.b+c%d@e-f.g-h.i", "4242424242424242 4242 4242 4242 4242  5500005555555559", "a" * 20000, "1" * 5000,
    "+4(1.1)1 1-1.1)1(1.1-1-1 5",
]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice("ab1234567890..@@++-- ()_%é") for _ in range(rng.randrange(200))) for _ in range(300)]


def test_base_spans(spark, odd_texts):
    rows = find(spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(odd_texts)
    names = list(PATTERNS)
    for r in rows:
        got = ",".join(f"{names[s.k]}:{s.start}:{s.end}" for s in r.base_spans)
        assert got == brute_force(odd_texts[r.doc_id]), odd_texts[r.doc_id][:200]
        assert all(odd_texts[r.doc_id][s.start : s.end] == s.value for s in r.base_spans)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_force(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(re.findall(rf"\b{k}:", want)) for k in PATTERNS)
        assert set(filter(None, want.split(","))) <= set(filter(None, r.spans.split(",")))


def corpus():
    rng = random.Random(8)
    words = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnr" for d in ("ta", "ko", "si")]
    rows = []
    for d in range(300):
        text = " ".join(rng.choice(words) for _ in range(40))
        if d % 20 == 0:
            text += f" write to ann.example{d % 3}@mail.org about Zebrafarm number {d}"
        rows.append((d, text))
    return rows


def test_disclosing_terms(spark):
    rows = corpus()
    by = dict(rows)
    for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        terms = {by[r.doc_id][s.start : s.end].lower() for s in r.all_spans if s.k == 4}
        if r.doc_id % 20 == 0:
            # Every text with this word has one of three addresses, each has it always: five texts, log2(20) bits each and more.
            assert "zebrafarm" not in terms or terms <= {"zebrafarm", "write", "to", "about", "number"}
        else:
            assert not terms and not r.base_spans


def test_terms_that_give_one_entity_away(spark):
    rows = [(d, t.replace("example1", "example0").replace("example2", "example0")) for d, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = dict(rows)
    for r in find(docs).collect():
        terms = {by[r.doc_id][s.start : s.end].lower() for s in r.all_spans if s.k == 4}
        assert terms == ({"zebrafarm", "write", "to", "about", "number"} if r.doc_id % 20 == 0 else set())
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    for d, t in rows:
        assert clean[d] == (re.sub(r"\b(zebrafarm|write|to|about|number)\b", "<TERM>", t.replace("ann.example0@mail.org", "<EMAIL>"), flags=re.I) if d % 20 == 0 else t)


def test_redaction_of_overlaps(spark):
    docs = spark.createDataFrame([(1, "call +4242424242424242 or +1 555 123 4567, é a@b.co"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact(docs).collect()}
    assert got[2] == "nothing" and got[3] is None and got[1].endswith("<PHONE>, é <EMAIL>") and "42" not in got[1]


def test_odd_tables(spark):
    odd = odd_documents(spark)
    assert find(odd).count() == 11 and find(odd_documents(spark, empty=True)).count() == 0
    got = redact(odd)
    assert got.columns == odd.columns and sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    assert redact(odd_documents(spark, empty=True)).count() == 0


def terms_by_hand(rows, alpha=1.25, min_texts=3, min_bits=7.0):
    """Spans of disclosing terms of every text, from the definitions."""
    words = lambda t: [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", t)]
    known, entity, both, term, texts = {}, Counter(), Counter(), Counter(), defaultdict(set)
    for t in rows:
        if t not in known:
            own = {x for x in brute_force(t).split(",") if x}
            values = {(x.split(":")[0], t[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in own}
            plain = {(k, v.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", v)) for k, v in values}
            known[t] = plain, [(int(x.split(":")[1]), int(x.split(":")[2])) for x in own]
        own = {w for *_, w in words(t)}
        term.update(own)
        entity.update(known[t][0])
        for e in known[t][0]:
            texts[e].add(t)
    strong = {e for e in entity if len(texts[e]) >= min_texts}
    reach = {e: entity[e] * (len(rows) / entity[e]) ** (1 - 1 / alpha) * (1 + 1e-9) for e in strong}
    pairs = defaultdict(set)
    for t in rows:
        for e in known[t][0] & strong:
            for w in {w for *_, w in words(t)}:
                if term[w] <= reach[e]:
                    both[e, w] += 1
                    pairs[e, w].add(t)
    found = set()
    for (e, w), n in both.items():
        ratio = n * len(rows) / (entity[e] * term[w])
        bits = len(pairs[e, w]) * (math.log2(ratio) - (1 - 1 / ratio) / math.log(2)) if ratio > 1 else 0
        if len(pairs[e, w]) >= min_texts and ratio > 1 and math.log2(ratio) >= math.log2(len(rows) / entity[e]) / alpha and bits >= math.log2(len(both)) + min_bits:
            found.add((e, w))
    return {t: [(s, e) for s, e, w in words(t) if any((x, w) in found for x in known[t][0])] for t in known}, {t: known[t][1] for t in known}


def test_terms_by_hand_on_repeated_rows(spark):
    """Every row twice, two texts under one id, rows without id, short names, names with digits, names in other scripts."""
    rng = random.Random(4)
    rows = [(d if d % 7 else None, t) for d, t in corpus()]
    for d, (mail, name) in enumerate([("kim@a.org", "Kim"), ("wu@b.org", "吳明"), ("c@c.org", "plate AB12")] * 4):
        rows.append((d, f"{rng.choice(['so', 'then', 'now'])} {name} {rng.randrange(10**6)} wrote from {mail} on day {d}"))
    rows = rows + rows
    texts = [t for _, t in rows]
    terms, base = terms_by_hand(texts)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in redact(docs).collect())
    want, named = Counter(), set()
    for d, t in rows:
        cuts = []
        for s, _, e, name in sorted([(s, 4, e, "<TERM>") for s, e in terms[t]] + [(s, 0, e, "<EMAIL>") for s, e in base[t]]):
            if cuts and s < cuts[-1][1]:
                cuts[-1] = cuts[-1][0], max(e, cuts[-1][1]), cuts[-1][2]
            else:
                cuts.append((s, e, name))
        named |= {t[s:e].lower() for s, e in terms[t]}
        out, at = "", 0
        for s, e, name in cuts:
            out, at = out + t[at:s] + name, e
        want[d, out + t[at:]] += 1
    assert got == want and {"kim", "吳明", "ab12"} <= named
    spans = find(docs).collect()
    assert len(spans) == len(rows)
    for r in spans:
        assert sum(s.k == 4 for s in r.all_spans) in {len([1 for s, e in terms[t] if not any(s < f and b < e for b, f in base[t])]) for d, t in rows if d == r.doc_id}


def test_hot_repeated_text(spark):
    rows = [(d, "write to ann@mail.org about Zebrafarm") for d in range(500)] + [(600 + d, f"other text {d}") for d in range(500)]
    got = redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # One text, however often it comes, is no evidence of what discloses what.
    assert len(got) == 1000 and {r.text for r in got if r.doc_id < 600} == {"write to <EMAIL> about Zebrafarm"}


def test_text_full_of_entities(spark):
    """Time grows with the text: 40,000 addresses, with and without other kinds among them."""
    import time

    text = " ".join(f"u{k}@h{k}.org" if k % 50 else f"10.0.{k % 256}.7, +49 30 {1000000 + k}" for k in range(40_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    find(docs.limit(0)).count()
    began = time.time()
    row = find(docs).select("n_email", "n_ip", "n_phone", "all_spans").first()
    took = time.time() - began
    assert (row.n_email, row.n_ip, row.n_phone) == (39_200, 800, 800)
    assert all(text[s.start : s.end] == s.value for s in row.all_spans)
    left = redact(docs).first().text
    assert left == " ".join("<EMAIL>" if k % 50 else "<IP>, <PHONE>" for k in range(40_000))
    assert took < 20  # the machine may be busy; the work of appending to arrays would be minutes


def test_columns_named_like_helpers(spark):
    names = ["row", "text_hash", "terms", "spans", "_hash", "_terms", "_spans", "_cuts", "entities", "h"]
    docs = spark.createDataFrame([(1, "mail a@b.org now", *names), (2, None, *names), (3, "nothing", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = redact(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "mail <EMAIL> now", *names), (2, None, *names), (3, "nothing", *names)]
    assert find(docs).count() == 3
