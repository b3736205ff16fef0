"""WARC: archives read back whole, the index in global order, revisits as in SQL, the loser tree against sorted()."""

import gzip
import hashlib
import random

import duckdb
import pyarrow.fs as pafs
import pytest

from tessera.llm import warc
from tessera.llm.storage import new_path


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree(seed):
    rng = random.Random(seed)
    runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 9))]
    got = [(x, k) for k, x in warc.LoserTree([iter(r) for r in runs])]
    assert got == sorted((x, k) for k, r in enumerate(runs) for x in r)


def test_record_round_trip():
    payload = "<p>ünï\r\n\r\n</p>".encode()
    fields, http, got = warc.parse(warc.record("urn:x-page:1", "http://a.b/c d", "2024-01-01T00:00:00Z", payload, None))
    assert got == payload and fields["WARC-Target-URI"] == "http://a.b/c%20d" and int(http["Content-Length"]) == len(payload)
    fields, http, got = warc.parse(warc.record("urn:x-page:1", None, "2024-01-01T00:00:00Z", payload, "urn:x-page:2"))
    assert got == b"" and fields["WARC-Type"] == "revisit" and "WARC-Target-URI" not in fields and int(http["Content-Length"]) == len(payload)


def test_url_key():
    assert warc.url_key("HTTPS://Www.Example.COM/A?b#c") == "com,example,www)/A?b" and warc.url_key(None) == "" and warc.url_key("x") == "x)"


def odd_pages(spark, empty=False):
    big, other = "é" * 600, "x" * 1000
    rows = [
        (1, "http://a.com/1", big), (2, "http://a.com/1", big), (3, "http://b.com/", big), (4, "http://b.com/", "x" * 999), (5, "http://b.com/", "x" * 999), (6, None, None), (7, "", ""),
        (8, "no scheme", other), (9, "http://c.com/\n\x00?q", other), (9, "http://c.com/again", other), (None, "http://d.com", other), (10, "http://e.com", "long " * 400_000), (11, "http://e.com", big + "y"),
    ]
    return spark.createDataFrame([] if empty else [(*r, "z", "z") for r in rows], "page_id long, url string, html string, refers_to string, archive string")


def test_archives_and_index(spark):
    pages = odd_pages(spark).repartition(3)
    folder = new_path(spark, "archives")
    captures = warc.write_archives(pages, folder, archive_bytes=2000)
    index = warc.merge_index(captures)
    keys = [(r.url_key, r.timestamp, r.record_id) for r in index.collect()]
    assert sorted(keys) == sorted((r.url_key, r.timestamp, r.record_id) for r in captures.collect()) and len(keys) == 13
    records = {r.record_id: r for r in warc.read_archives(index, folder).collect()}
    texts = {f"urn:x-page:{r.page_id}": r.html or "" for r in pages.collect() if r.page_id not in (None, 9)}
    for name, html in texts.items():
        r, data = records[name], html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.payload == (data if r.record_type == "response" else None)
    assert {n: r.refers_to for n, r in records.items() if r.record_type == "revisit"} == {"urn:x-page:1": "urn:x-page:3", "urn:x-page:2": "urn:x-page:3", "urn:x-page:8": "urn:x-page:9"}
    # Any reader of gzip can read an archive: its members one after another are the records.
    files, root = pafs.FileSystem.from_uri(folder)
    first = captures.orderBy("archive", "offset").first().archive
    plain = gzip.decompress(files.open_input_stream(f"{root}/{first}", compression=None).read())
    assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC/1.1\r\n") == captures.where(captures.archive == first).count()


def test_index_order_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "_RUN_ROWS", 40)
    rng = random.Random(3)
    rows = [("com,hot)/" if k % 3 else f"com,{rng.randrange(50)})/", f"2024-01-01T00:{k % 60:02d}:00Z", f"urn:x-page:{k}", f"a{k % 7}", k, 1, "response") for k in range(300)]
    merged = warc.merge_index(spark.createDataFrame(rows, warc.CAPTURE).repartition(5))
    keys = [(r.url_key, r.timestamp, r.record_id) for r in merged.collect()]
    assert len(keys) == 300
    files = [[(r.url_key, r.timestamp, r.record_id) for r in spark.read.parquet(f).collect()] for f in sorted(merged.inputFiles())]
    assert sum(files, []) == sorted((r[0], r[1], r[2]) for r in rows) and len(files) > 3


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, warc.query(spark, sf).collect())) == sorted(con.sql(warc.ORACLE_SQL).fetchall())


def test_empty_table(spark):
    folder = new_path(spark, "archives")
    assert warc.read_archives(warc.merge_index(warc.write_archives(odd_pages(spark, empty=True), folder)), folder).count() == 0


def test_several_payloads_of_one_id(spark):
    shared, second, own = "x" * 1500, "y" * 1500, "z" * 1500
    rows = [(1, "http://a.com/1", shared), (1, "http://a.com/1", own), (1, "http://a.com/1", "short"), (1, "http://a.com/1", second), (2, "http://b.com/", shared), (3, "http://c.com/", second)]
    folder = new_path(spark, "archives")
    index = warc.merge_index(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder))
    got = sorted((r.record_id, r.payload_digest, r.refers_to, bytes(r.payload).decode() if r.payload is not None else None) for r in warc.read_archives(index, folder).collect())
    refers = {(1, shared): "urn:x-page:2", (1, second): "urn:x-page:3"}
    want = [(f"urn:x-page:{k}", hashlib.sha1(t.encode()).hexdigest(), refers.get((k, t)), None if (k, t) in refers else t) for k, _, t in rows]
    assert got == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize(("fan_in", "rows_a_task"), [(64, 250_000), (3, 200), (2, 5000)])
def test_external_merge_of_many_runs(spark, monkeypatch, fan_in, rows_a_task):
    """Runs longer than a block, more runs than are merged at a time, one URL in a third of all captures, and repeated captures."""
    monkeypatch.setattr(warc, "_RUN_ROWS", rows_a_task)
    rng = random.Random(fan_in)
    rows = []
    for archive in range(9):
        own = [("com,hot)/" if rng.random() < 0.35 else f"com,{rng.randrange(200)})/", f"2024-01-{1 + rng.randrange(28):02d}T00:00:00Z", f"urn:x-page:{rng.randrange(900)}", f"a{archive}", k, 1, "response") for k in range(700)]
        rows += sorted(own)
    captures = spark.createDataFrame(rows, warc.CAPTURE).repartition(4, "archive").sortWithinPartitions("archive", "url_key", "timestamp", "record_id")
    runs = warc.sorted_runs(captures, new_path(spark, "runs"))
    assert runs.select("run").distinct().count() == 9 and runs.agg({"n": "sum"}).first()[0] == 6300 and runs.agg({"n": "max"}).first()[0] <= warc._block_rows()
    merged = warc.merge_index(captures, fan_in=fan_in)
    order = [[tuple(r) for r in spark.read.schema(merged.schema).parquet(f).collect()] for f in sorted(merged.inputFiles())]
    got = sum(order, [])
    assert sorted(got) == sorted(rows) and [r[:3] for r in got] == sorted(r[:3] for r in rows)
    assert len(order) == 1 or rows_a_task < 6300


def test_very_long_payload(spark):
    text = "x" * 30_000_000
    folder = new_path(spark, "archives")
    index = warc.merge_index(warc.write_archives(spark.createDataFrame([(1, "http://a.com/", text), (2, "http://a.com/", "short")], "page_id long, url string, html string"), folder))
    got = {r.record_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(index, folder).select("record_id", "payload_bytes", "payload_digest").collect()}
    assert got == {"urn:x-page:1": (30_000_000, hashlib.sha1(text.encode()).hexdigest()), "urn:x-page:2": (5, hashlib.sha1(b"short").hexdigest())}
