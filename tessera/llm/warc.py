"""WARC archives of pages, and their index as globally ordered capture histories.

Every task writes its pages as gzipped records (one member each) to archives of bounded size, and gives the captures of an
archive as a run sorted by URL key and time. Runs are kept in files, in blocks, and merged from these: a task takes a range of keys
(time and record id are part of the key, so one URL can spread over many tasks), reads from each run the blocks that the range
meets, one at a time, and merges them with a loser tree. Only the blocks' places go through a shuffle. Many runs are merged in
several passes. The files of the result, in order, are the global order.

Pages with equal payloads of ``least`` bytes or more are revisits of the one with the largest id. Archives are read back by
the index's offsets.

Defined cases: a null payload is empty; a null URL has an empty key and no target; pages without an id are responses; several
rows of one id are written each, and none revisits its own id; equal keys are ordered by time, then id, and stay as many as
they are; empty tables give no archives and an empty result; columns beside id, URL and payload are not looked at.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.storage import materialize, new_path
from tessera.llm.text import slices

_EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
_SECONDS = 250_000_000_000  # up to the last date that can be written
_RUN_ROWS = 250_000  # captures that one merging task should read
_MOST_BROADCAST = 500_000  # revisits, of some hundred bytes each
_READ_BYTES = 64 << 20  # of archives that one task should read

CAPTURE = "url_key string, timestamp string, record_id string, archive string, offset long, length long, record_type string"


def url_key(url: str | None) -> str:
    """The URL in the order of its parts' weight: host labels from the last to the first, then the rest."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host = rest[:cut].lower()
    return ",".join(reversed(host.split("."))) + ")" + rest[cut:].split("#", 1)[0]


def record(record_id: str, url: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no payload of its own, but its digest and length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record, fields of the HTTP response, and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:]), payload


class LoserTree:
    """Merges k sorted runs: each inner node holds the loser of its match, so the next smallest costs log2(k) comparisons.

    On equal keys the run with the smaller number comes first."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) <= (y, b)

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            yield self.winner, head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            node, now = (self.winner + self.size) // 2, self.winner
            while node:
                if self._before(self.losers[node], now):
                    self.losers[node], now = now, self.losers[node]
                node //= 2
            self.winner = now


def revisits(pages: DataFrame, id_column: str, payload_column: str, least: int) -> DataFrame:
    """(id, digest, n_bytes, refers_to) of the pages whose payload stands in another's record, a row for each payload of an id."""
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    hashed = pages.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n_bytes")).where(F.col("n_bytes") >= least)
    hashed = materialize(hashed, "digests")
    kept = materialize(hashed.groupBy("digest", "n_bytes").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "kept")
    return materialize(hashed.join(kept, ["digest", "n_bytes"]).where("id <> refers_to").select("id", "digest", "n_bytes", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 1000, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write all pages to ``folder`` (any file system that pyarrow opens; shared by all executors) and return their captures.

    An archive that a lost task left behind is not named by any capture."""
    refers = revisits(pages, id_column, payload_column, least)
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(payload_column).alias("payload"))
    # An id can have several payloads, of which some stand elsewhere.
    stated = rows.withColumns({"digest": F.sha1(F.coalesce("payload", F.lit(""))), "n_bytes": F.octet_length(F.coalesce("payload", F.lit("")))})
    # Payloads stay where they are unless there are very many revisits.
    small = refers.count() <= _MOST_BROADCAST
    rows = stated.join(F.broadcast(refers) if small else refers, ["id", "digest", "n_bytes"], "left").select("id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, captures = None, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                captures.sort()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*captures, strict=True)], [x.split()[0] for x in CAPTURE.split(", ")])
                captures.clear()

        at, name = 0, ""
        for whole in batches:
            for batch in slices(whole, "payload"):
                for x in batch.to_pylist():
                    if out is None:
                        name, at = f"crawl-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)  # its members are packed one by one
                    own = f"urn:x-page:{x['id']}" if x["id"] is not None else f"urn:uuid:{uuid.uuid4()}"
                    date = (_EPOCH + datetime.timedelta(seconds=(x["id"] or 0) % _SECONDS)).strftime("%Y-%m-%dT%H:%M:%SZ")
                    refers_to = f"urn:x-page:{x['refers_to']}" if x["refers_to"] is not None else None
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = packer.compress(record(own, x["url"], date, (x["payload"] or "").encode(), refers_to)) + packer.flush()
                    out.write(member)
                    captures.append((url_key(x["url"]), date, own, name, at, len(member), "revisit" if refers_to else "response"))
                    at += len(member)
                    if at >= archive_bytes:
                        yield from close()
        yield from close()

    return materialize(rows.mapInArrow(run, CAPTURE), "captures")


_KEYS = ["url_key", "timestamp", "record_id"]
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_PLACE = "run string, file string, offset long, length long, n long, first array<string>, last array<string>"


class _Blocks:
    """Writes sorted captures to a file of the shared folder, block by block, and says where each block lies and what it spans."""

    def __init__(self, folder: str):
        self.files, root = pafs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.name, self.at = f"{root}/run-{uuid.uuid4().hex}", 0
        self.out = None

    def write(self, run: str, rows: list[tuple]) -> tuple:
        if self.out is None:
            self.out = self.files.open_output_stream(self.name, compression=None)
        columns = [pa.array(c) for c in zip(*rows, strict=True)]
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays(columns, _NAMES)
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        data = sink.getvalue()
        self.out.write(data)
        place = run, self.name, self.at, len(data), len(rows), list(rows[0][:3]), list(rows[-1][:3])
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _places(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _PLACE.split(", ")])


def sorted_runs(captures: DataFrame, folder: str) -> DataFrame:
    """Captures as runs in files of the shared folder; a row for each block. The captures of an archive come sorted from their writer and
    are a run as they are; what isn't sorted is sorted batch by batch, and a run ends where a key is smaller than the one before."""
    block = _block_rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, last, name = _Blocks(folder), [], None, ""
        places: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            turn = {archive: k for k, archive in enumerate(dict.fromkeys(r[3] for r in rows))}
            for row in sorted(rows, key=lambda r: (turn[r[3]], r[:3])):
                if last is None or row[:3] < last:
                    if held:
                        places.append(out.write(name, held))
                        held = []
                    name = uuid.uuid4().hex
                held.append(row)
                last = row[:3]
                if len(held) == block:
                    places.append(out.write(name, held))
                    held = []
            if len(places) > 1000:
                yield _places(places)
                places = []
        if held:
            places.append(out.write(name, held))
        out.close()
        if places:
            yield _places(places)

    return materialize(captures.select(*_NAMES).mapInArrow(run, _PLACE), "runs")


def _block_rows() -> int:
    return max(16, min(1024, _RUN_ROWS // 32))


def _read_run(files: pafs.FileSystem, places: list[tuple], low: tuple, high: tuple | None) -> Iterator[tuple]:
    """The captures of a run from key ``low`` on and before ``high``, one block in memory at a time."""
    for file, offset, length in places:
        with files.open_input_file(file) as source:
            table = pa.ipc.open_stream(source.read_at(length, offset)).read_all()
        for row in zip(*(c.to_pylist() for c in table.columns), strict=True):
            if high is not None and row[:3] >= high:
                return
            if row[:3] >= low:
                yield row


def _merged(blocks: DataFrame, folder: str, groups: int, last: bool) -> DataFrame:
    """Runs of ``blocks`` merged within ``groups`` of them: as runs again, or the ``last`` time as captures in order.

    The keys of a group are cut into ranges at keys where some of its blocks begin, so that a task merges about ``_RUN_ROWS`` captures:
    it reads from each run the blocks that the range meets, and holds one block of each run."""
    rows = blocks.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int"))
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("blocks")).first()
    parts = max(1, math.ceil(total.n / _RUN_ROWS / groups))  # of a group
    # Bounds balance the tasks' work and nothing else, so a few blocks a range, by hash, are enough to find them.
    share = min(1.0, 16 * parts * groups / max(1, total.blocks))
    some = rows.where(F.pmod(F.xxhash64("file", "offset"), F.lit(1 << 20)) < int(share * (1 << 20))).select("group", "first").collect()
    begins: dict[int, list[tuple]] = {}
    for r in some:
        begins.setdefault(r.group, []).append(tuple(r.first))
    bounds = {}
    for g, keys in begins.items():
        keys = sorted(set(keys))
        bounds[g] = sorted({keys[len(keys) * k // parts] for k in range(1, parts)})
    shared = blocks.sparkSession.sparkContext.broadcast(bounds)
    names = [x.split()[0] for x in _PLACE.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, ranges = [], []
            for k, (g, first, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "first", "last")), strict=True)):
                own = shared.value.get(g, [])
                met = range(bisect_right(own, tuple(first)), bisect_right(own, tuple(end)) + 1)
                take += [k] * len(met)
                ranges += met
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(take, pa.int64())) for c in ("group", *names)), pa.array(ranges, pa.int32())], ["group", *names, "range"])

    dealt = rows.select("group", *names).mapInArrow(deal, f"group int, {_PLACE}, range int")
    tasks = parts * groups
    spread = dealt.repartitionByRange(tasks, "group", "range") if last else dealt.repartition(tasks, "group", "range")
    spread = spread.sortWithinPartitions("group", "range", "run", "first").select("group", "range", "run", "file", "offset", "length")
    block = _block_rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        out = None if last else _Blocks(folder)

        def one(group: int, number: int, places: dict[str, list[tuple]]) -> Iterator[pa.RecordBatch]:
            own = [(), *shared.value.get(group, []), None]
            held, written = [], []
            for _, row in LoserTree([_read_run(files, p, own[number], own[number + 1]) for p in places.values()]):
                held.append(row)
                if len(held) == block:
                    yield from done(held, group, written)
            if held:
                yield from done(held, group, written)
            if written:
                yield _places(written)

        def done(held: list[tuple], group: int, written: list[tuple]) -> Iterator[pa.RecordBatch]:
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], _NAMES)
            else:
                written.append(out.write(f"group-{group}", held))
            held.clear()

        now, places = None, {}
        for batch in batches:
            for group, number, run, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, number) != now:
                    if places:
                        yield from one(*now, places)
                    now, places = (group, number), {}
                places.setdefault(run, []).append(tuple(place))
        if places:
            yield from one(*now, places)
        if out is not None:
            out.close()

    return materialize(spread.mapInArrow(merge, CAPTURE if last else _PLACE), "index" if last else "merged_runs")


def merge_index(captures: DataFrame, folder: str | None = None, fan_in: int = 64) -> DataFrame:
    """All captures in the order of URL key, time and record id, by merging their sorted runs from the files they are kept in: about
    ``fan_in`` runs at a time, as often as it takes, and the last time into the table of all captures."""
    folder = folder or new_path(captures.sparkSession, "index_runs")
    blocks = sorted_runs(captures, folder)
    runs = blocks.select("run").distinct().count()
    while runs > fan_in:
        groups = math.ceil(runs / fan_in)
        blocks = _merged(blocks, folder, groups, False)
        runs = groups
    return _merged(blocks, folder, 1, True)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names: record_id, payload_bytes, payload_digest (hex), record_type, refers_to, url, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        open_name, source = None, None
        names = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            out, held = [], 0
            for x in batch.to_pylist():
                if x["archive"] != open_name:
                    if source is not None:
                        source.close()
                    open_name, source = x["archive"], files.open_input_file(f"{root}/{x['archive']}")
                fields, http, payload = parse(zlib.decompress(source.read_at(x["length"], x["offset"]), 31))
                kind, digest = fields["WARC-Type"], base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{x['archive']} at {x['offset']}: the payload isn't that of the digest")
                refers = fields.get("WARC-Refers-To")
                out.append((fields["WARC-Record-ID"].strip("<>"), int(http["Content-Length"]), digest, kind, refers and refers.strip("<>"), fields.get("WARC-Target-URI"), payload if kind == "response" else None))
                held += len(payload)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    # As many tasks as the archives' bytes ask for; a large archive is dealt out over several.
    size = index.agg(F.sum("length").alias("b")).first().b or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, math.ceil(size / _READ_BYTES))
    spread = index.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.select("archive", "offset", "length").mapInArrow(run, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives, the index merged, and all records read back by it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_path(spark, "archives")
    records = read_archives(merge_index(write_archives(pages, folder)), folder)
    number = lambda c: F.when(F.col(c).startswith("urn:x-page:"), F.substring_index(c, ":", -1).cast("long"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: The rows of the query, from the table alone.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keep FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.keep IS NOT NULL AND k.keep <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keep <> d.page_id THEN k.keep END AS refers_to
FROM d LEFT JOIN k ON d.n >= 1000 AND d.digest = k.digest
"""
