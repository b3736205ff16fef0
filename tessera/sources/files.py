"""Picture files and archives as tables: files are read by Spark's binaryFile source and opened in the task that holds them."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import glob

_ENTRY = "path string, entry string, size long, content binary, error string"


def blobs(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content, length) of all files under ``path`` whose names match a glob pattern."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content", "length")


def globbed(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content, length, relative) of all files whose paths fit a pattern with ``*``, ``**`` and alternatives of an ending. Listing
    starts at the folder before the first wildcard; ``relative`` is what stands below it."""

    def one(single: str) -> DataFrame:
        folder, rest = glob.fixed_folder(single)
        found = blobs(spark, folder or ".", rest.rsplit("/", 1)[-1].replace("**", "*"))
        root = "/" + folder.split("://", 1)[-1].strip("/") + "/" if folder else "/"
        below = F.col("path") if not folder else F.substring("path", F.locate(root, F.col("path")) + len(root), F.length("path"))
        return found.withColumn("relative", below).where(F.col("relative").rlike(glob.expression(rest)))

    return reduce(DataFrame.union, map(one, dict.fromkeys(glob.alternatives(pattern))))


def kind_of(content: Column) -> Column:
    """Container of a blob by its first bytes, null where none fits."""
    head = F.hex(F.substring(content, 1, 12))
    # The first bytes of containers; of two that begin alike the longer one comes first.
    magic = {
        "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "zip": "504B0304", "gzip": "1F8B", "ktx2": "AB4B5458203230BB0D0A1A0A", "ktx": "AB4B5458203131BB0D0A1A0A",
        "dds": "44445320", "pvr": "50565203", "rom": "4E45531A", "ar": "213C617263683E0A",
    }
    # An archive whose first member is the index of a cut picture.
    member = F.decode(F.substring(content, 9, 60), "ISO-8859-1")
    indexed = head.startswith("213C617263683E0A") & (F.regexp_replace(F.substring(member, 1, 16), "[ /]+$", "") == "0000000000.txt") & (F.substring(member, 59, 2) == "`\n")
    found = F.when(indexed, "zcis").when(head.rlike("^503[1-6](09|0A|0D|20|23)"), "netpbm").when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^0A0[0-5]0[01]0[1248]"), "pcx")
    for name, first in magic.items():
        found = found.when(head.startswith(first), name)
    return found


def netpbm_pixels(files: DataFrame) -> DataFrame:
    """Pixel rows (path, x, y, r, g, b, a) of bitmaps (1 is black), grey and colour netpbm files, plain or raw; broken files have
    no rows."""

    def levels(data: bytes) -> np.ndarray | None:
        """height x width x 3."""
        gap = rb"(?:\s+|#[^\n]*\n)+"
        head = re.match(rb"P([1-6])" + gap + rb"(\d+)" + gap + rb"(\d+)" + rb"(?:(?<=\d)\s|(?=\s))", data) if data[1:2] in b"14" else re.match(rb"P([2356])" + gap + rb"(\d+)" + gap + rb"(\d+)" + gap + rb"(\d+)\s", data)
        if not head:
            return None
        kind, w, h = int(head[1]), int(head[2]), int(head[3])
        most = 1 if kind in (1, 4) else int(head[4])
        channels = 3 if kind in (3, 6) else 1
        n = w * h * channels
        if not 0 < most < 256 or not n:
            return None
        body = data[head.end() :]
        if kind < 4:
            body = re.sub(rb"#[^\n]*", b"", body)
            parts = re.findall(rb"[01]", body) if kind == 1 else body.split()
            if len(parts) < n:
                return None
            samples = np.array([int(v) for v in parts[:n]], np.int32)
        elif kind == 4:
            row = -(-w // 8)
            if len(body) < row * h:
                return None
            samples = np.unpackbits(np.frombuffer(body, np.uint8, row * h).reshape(h, row), axis=1)[:, :w].astype(np.int32).ravel()
        else:
            if len(body) < n:
                return None
            samples = np.frombuffer(body, np.uint8, n).astype(np.int32)
        if kind in (1, 4):
            samples = 1 - samples
        out = (samples * 255 // most).reshape(h, w, channels)
        return np.repeat(out, 3, axis=2) if channels == 1 else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if (found := levels(content)) is None:
                    continue
                h, w, _ = found.shape
                y, x = (v.ravel().astype(np.int32) for v in np.mgrid[0:h, 0:w])
                rgb = found.reshape(-1, 3)
                opaque = np.full(len(x), 255, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), *(pa.array(v) for v in (x, y, *np.ascontiguousarray(rgb.T), opaque))], ["path", "x", "y", "r", "g", "b", "a"])

    return files.select("path", "content").mapInArrow(run, "path string, x int, y int, r int, g int, b int, a int")


def netpbm_gray_file(levels: DataFrame) -> DataFrame:
    """(image_id, content): grey pictures (image_id, x, y, v), written as raw grey files; pictures must be whole."""
    rows = levels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    body = F.unhex(F.array_join(F.transform("p", lambda p: F.lpad(F.hex(p["v"].cast("long")), 2, "0")), ""))
    return rows.select("image_id", F.concat(F.encode(F.format_string("P5\n%d %d\n255\n", "w", "h"), "UTF-8"), body).alias("content"))


def netpbm_file(packed: DataFrame) -> DataFrame:
    """(image_id, content): pictures packed as RGBA bytes, written as raw colour files without their alpha."""
    pixels = F.regexp_replace(F.hex("data"), "(......)..", "$1")
    return packed.select("image_id", F.concat(F.encode(F.format_string("P6\n%d %d\n255\n", "width", "height"), "UTF-8"), F.unhex(pixels)).alias("content"))


def _safe(name: str) -> bool:
    return bool(name) and not name.startswith("/") and ".." not in name.split("/")


def archive_entries(files: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(path, entry, size, content, error) of the files in zip, tar and gzip archives; entries past ``most_bytes`` give an error
    and no content, names that climb out of the archive are left out, and a broken archive is one row with its error."""

    def entries(data: bytes) -> Iterator[tuple[str, int, bytes | None, str | None]]:
        if data[:2] == b"\x1f\x8b":
            plain = gzip.GzipFile(fileobj=io.BytesIO(data)).read(most_bytes + 1)
            if len(plain) > most_bytes:
                yield "", len(plain), None, "too large"
                return
            if len(plain) < 512 or plain[257:262] != b"ustar":
                yield "", len(plain), plain, None
                return
            data = plain
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir() and _safe(i.filename):
                        big = i.file_size > most_bytes
                        yield i.filename, i.file_size, None if big else z.read(i), "too large" if big else None
        else:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
                for m in t:
                    name = m.name.removeprefix("./")
                    if m.isfile() and _safe(name):
                        big = m.size > most_bytes
                        yield name, m.size, None if big else t.extractfile(m).read(), "too large" if big else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in _ENTRY.split(", ")], [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    for e in entries(content):
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, *e), kinds, strict=True)], names)
                except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, None, None, None, str(e)), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, _ENTRY)
