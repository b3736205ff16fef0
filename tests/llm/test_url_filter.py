"""URL filter: hosts, paths and rules against plain Python; the trees on URLs whose label shows in their form."""

import random

import pytest
from pyspark.sql import functions as F

from common import odd_documents
from tessera.llm.url_filter import RULES, _sample, features, fit, judge, labelled_by, query, split_url

ODD = [
    None, "", "no scheme/at all", "http://", "HTTP://Www.EXAMPLE.Com/en/7", "x://a.com/en/", "http://com/en/x", "http://ecom/en/x", "http://a.com?/en/", "http://a.com#/en/", "http://a.com/EN/",
    "http://a.net/de/80", "http://a.example.net/de/80", "http://example.net/de/8?x", "http://notexample.net/de/8", "a://b://c.org/es/", "http://ä.org/es/é?ü#ö", "http://a.org/es", "http://user@a.org/es/", "http://a.com:80/en/",
    "line\nbreak://a.com/en/\nx?y", "http://a.com/en/7", "http://example.com/en/7/8", "http://ÀB.com/en/",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s] or [len(s)])]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def rule_of(host, path):
    found = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(found, key=lambda r: len(str(r)), default=None)


def test_hosts_paths_rules(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = split(pages[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule, r.by_model) == (host, path, rule and str(rule), rule is None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("block", "allow")


def test_odd_urls(spark):
    urls = spark.createDataFrame(list(enumerate(ODD)) + [(5, ODD[5])], "page_id long, url string").withColumn("entropy", split_url(__import__("pyspark").sql.functions.col("url"))[0])
    rows = judge(urls, RULES, fit(labelled_by(urls, RULES))).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        host, path = split(ODD[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and str(rule)), ODD[r.page_id]
    assert rows[0].entropy is not None or rows[0].page_id == 0


def test_trees_learn(spark):
    rng = random.Random(1)

    def url(spam):
        host = f"{rng.choice('abcdefg')}{rng.randrange(9)}.{'shop' if rng.random() < 0.5 else 'site'}.{'biz' if spam else 'org'}"
        return f"http://{host}/" + ("".join(rng.choice("0123456789-") for _ in range(30)) + "?a=1&b=2&c=3" if spam else "/".join(rng.choice(["news", "about", "team"]) for _ in range(3)))

    rows = [(url(k % 3 == 0), k % 3 == 0) for k in range(600)]
    labelled = spark.createDataFrame([(u, int(s)) for u, s in rows[:400]], "url string, label int")
    held = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[400:])], "page_id long, url string")
    got = judge(held, (), fit(labelled, trees=4)).collect()
    assert sum((r.verdict == "block") == rows[400 + r.page_id][1] for r in got) >= 195


def test_entropy(spark):
    r = features(spark.createDataFrame([("aabb",)], "url string"), "url").first()
    assert r.entropy == pytest.approx(1.0) and r.url_length == 4


def test_odd_tables(spark):
    odd = odd_documents(spark).withColumnRenamed("text", "url")
    got = judge(odd, RULES, fit(labelled_by(odd, RULES)))
    assert got.columns == [*odd.columns, "host", "path", "rule", "verdict", "by_model"] and got.count() == 11
    empty = odd_documents(spark, empty=True).withColumnRenamed("text", "url")
    assert judge(empty, RULES, fit(labelled_by(empty, RULES))).count() == 0
    one_kind = spark.createDataFrame([("http://a.com/en/1", 1.0)], "url string, label double")
    assert {r.verdict for r in judge(odd, (), fit(one_kind)).collect()} == {"block"}


@pytest.mark.parametrize("small", [True, False])
def test_suffixes_count_all_labelled(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr("tessera.llm.url_filter._MOST_BROADCAST", (10, 10))
    labelled = [(k, f"http://h{k}.s{k % 97}.org/", float(k % 97 % 2)) for k in range(970)]
    model = fit(spark.createDataFrame(labelled, "id long, url string, label double"), most_labelled=40, trees=2)
    assert model.small == small
    assert sorted(map(tuple, model.suffixes.collect())) == sorted((f"s{k}.org", 10.0, 10.0 * (k % 2)) for k in range(97))
    urls = spark.createDataFrame([(k, f"http://new.s{k}.org/") for k in range(97)] + [(97, "http://new.other.net/")], "page_id long, url string")
    got = judge(urls, (), model).collect()
    assert len(got) == 98 and sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in got if r.page_id < 97) >= 92


def test_copies_of_one_url_leave_room_for_others(spark):
    urls = [f"http://a{k}.site.org/x" for k in range(300)]
    hot = spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("min_by(url, shiftrightunsigned(xxhash64(url), 1)) AS url").first().url
    labelled = [(k, u, 0.0) for k, u in enumerate(urls) if u != hot] + [(1000 + k, hot, 1.0) for k in range(400)]
    model = fit(spark.createDataFrame(labelled, "id long, url string, label double"), most_labelled=200, trees=2)
    assert model.trees is not None and model.share == 400 / 699


def test_sample_is_bounded_and_of_distinct_urls(spark):
    rows = spark.createDataFrame([(f"http://a{k}.org/", 1.0) for k in range(3000)] + [("http://hot.org/", float(k % 3 == 0)) for k in range(500)], "url string, label double")
    got = {r.url: r for r in _sample(rows, 1000).collect()}
    assert len(got) == 1000 and all(r.own_n == (500 if u == "http://hot.org/" else 1) for u, r in got.items())
    assert {r.url: r.label for r in _sample(rows, 5000).collect()}["http://hot.org/"] == 0.0 and _sample(rows, 5000).count() == 3001


def test_trees_on_pages_that_they_have_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labelled = labelled_by(pages, RULES).distinct()
    held = F.crc32("url") % 5 == 0
    rows = judge(labelled.where(held).withColumnRenamed("label", "truth"), (), fit(labelled.where(~held))).collect()
    share = sum(r.truth for r in rows) / len(rows)
    right = sum((r.verdict == "block") == (r.truth == 1) for r in rows) / len(rows)
    assert len(rows) > 100 and right > max(share, 1 - share)
