"""What each filter of a chain removes, in every order of the chain, from packed bitmaps.

1. Each text gets its filters' verdicts (true: the filter fails it) and its labels.
2. Within a task the rows of a batch are put together by part, and each part's verdicts and labels are packed into bits:
   the bitmap index, a row of 64-bit words for each part and batch.
3. For every subset of filters that can stand before a step, the survivors are the part's bits AND NOT those of the subset's
   filters; what the step removes, and what of it bears a label, is counted by popcount. Tasks sum over their batches, Spark over
   tasks: a task hands on 2^n rows a part, whatever the number of texts.
4. An order is a walk over subsets, so the n! * n rows a part are looked up in the sums, and none of them looks at texts.

Defined cases: null texts are empty ones; texts of any length are read whole; a null part is the empty string; rows without an id
are copies of nobody, bear no labels and count like others; repeated rows each count, and none is a copy of the other, as
only a smaller id makes a copy; several label rows of one id count as one that has what any of them has; empty tables have no
parts and so give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import text as T
from tessera.llm.joins import join_counted
from tessera.llm.storage import materialize

_MOST_FILTERS = 6
_HELD_PARTS = 2048  # parts whose sums a task holds before it hands them on

CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
SYMBOL = np.isin(np.arange(256), list(b"#$%&*|"))


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags stand between neighbouring offsets."""
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[offsets])


def _verdicts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Filters A to D of the texts between ``offsets``."""
    starts, ends, doc = T.words(data, offsets)
    n = len(offsets) - 1
    n_words = np.bincount(doc, minlength=n)
    hashes = T.word_hashes(data, starts, ends, cased=True)
    for a, b in itertools.pairwise(np.append(0, np.cumsum(n_words)).tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    distinct = np.bincount(doc[new], minlength=n)
    return {
        "A": n_words < 50,
        "B": 100 * distinct < 65 * n_words,
        "C": 100 * _within(CAPITAL[data], offsets) > 5 * _within((data & 0xC0) != 0x80, offsets),
        "D": _within(SYMBOL[data], offsets) > 0,
    }


def text_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of every document, whose columns are doc_id, source and text.

    E, a copy of a text with a smaller id, is told from the smallest id of the text's digest."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, offsets = T.buffer_of(batch.column("text"))
                view = memoryview(data)
                digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in itertools.pairwise(offsets.tolist())]
                verdicts = _verdicts(data, offsets)
                columns = [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), *map(pa.array, verdicts.values())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "digest", *verdicts])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    facts = materialize(rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, A boolean, B boolean, C boolean, D boolean"), "facts")
    copied = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    copied = materialize(copied.where("first < last").select("digest", "first", "n"), "copied")
    known = join_counted(facts, copied, "digest", "n", facts.count(), "left")
    return known.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def bitmap_index(flagged: DataFrame, flags: list[str], part: str) -> DataFrame:
    """(part, n, words): for each part of a batch the ``flags`` of its ``n`` rows, packed one after the other, each into whole
    words of 64 bits. A null flag is false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).dictionary_encode()
            code = parts.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            bits = np.stack([c.fill_null(False).to_numpy(zero_copy_only=False) for c in batch.columns[1:]])[:, order]
            cuts = np.searchsorted(code[order], np.arange(len(parts.dictionary) + 1))
            words = []
            for a, b in itertools.pairwise(cuts.tolist()):
                packed = np.zeros((len(flags), -(-(b - a) // 64) * 8), np.uint8)
                packed[:, : -(-(b - a) // 8)] = np.packbits(bits[:, a:b], axis=1)
                words.append(packed.tobytes())
            yield pa.RecordBatch.from_arrays([parts.dictionary, pa.array(np.diff(cuts), pa.int64()), pa.array(words, pa.binary())], ["part", "n", "words"])

    rows = flagged.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *(F.col(f).cast("boolean").alias(f"f{k}") for k, f in enumerate(flags)))
    return rows.mapInArrow(run, "part string, n long, words binary")


def _counted(n: np.ndarray, words: list[bytes], n_filters: int, n_labels: int) -> np.ndarray:
    """Counts (index rows x subsets x columns): a subset's survivors; then for each filter how many of them it fails, and how many
    of these bear each label."""
    wide = n_filters + n_labels
    size = -(-n // 64)
    at = np.cumsum(size) - size
    flat = np.concatenate([np.frombuffer(w, np.uint64).reshape(wide, -1) for w in words], 1)
    full = np.concatenate([np.packbits(np.arange(s * 64) < k).view(np.uint64) for s, k in zip(size.tolist(), n.tolist(), strict=True)])
    count = lambda bits: np.add.reduceat(np.bitwise_count(bits), at, dtype=np.int64)
    out = np.zeros((len(n), 1 << n_filters, 1 + n_filters * (1 + n_labels)), np.int64)
    alive = [full]
    for subset in range(1 << n_filters):
        if subset:  # one filter more than a subset that has been seen
            last = subset.bit_length() - 1
            alive.append(alive[subset ^ (1 << last)] & ~flat[last])
        out[:, subset, 0] = count(alive[subset])
        for f in range(n_filters):
            if not subset >> f & 1:
                removed = alive[subset] & flat[f]
                column = 1 + f * (1 + n_labels)
                out[:, subset, column] = count(removed)
                for k in range(n_labels):
                    out[:, subset, column + 1 + k] = count(removed & flat[n_filters + k])
    return out


def subset_counts(index: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(part, subset, c0, c1, ...), summed over all tasks; the bits of ``subset`` tell which filters stand before."""
    columns = [f"c{k}" for k in range(1 + len(filters) * (1 + len(labels)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def made() -> pa.RecordBatch:
            table = np.concatenate(list(sums.values()))
            parts, subsets = [p for p, v in sums.items() for _ in range(len(v))], np.tile(np.arange(1 << len(filters)), len(sums))
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(subsets, pa.int32()), *(pa.array(c) for c in np.ascontiguousarray(table.T))], ["part", "subset", *columns])

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                counts = _counted(batch.column("n").to_numpy(), batch.column("words").to_pylist(), len(filters), len(labels))
                for part, table in zip(batch.column("part").to_pylist(), counts, strict=True):
                    sums[part] = sums[part] + table if part in sums else table
                if len(sums) > _HELD_PARTS:
                    yield made()
        if sums:
            yield made()

    counted = index.mapInArrow(run, "part string, subset int, " + ", ".join(f"{c} long" for c in columns))
    return counted.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in columns))


def audit(flagged: DataFrame, filters: list[str], labels: list[str], part: str) -> DataFrame:
    """One row for each value of ``part``, order of ``filters`` (names end to end) and step: kept, removed, redundant (failing the
    step's filter, removed before), unique_fails (failing no other filter), ``<label>_lost`` of the removed rows, and the
    filter's shapley (what it removes, summed over all orders). ``filters`` and ``labels`` are boolean columns; six filters at most,
    since orders grow with the factorial."""
    n = len(filters)
    if not 1 <= n <= _MOST_FILTERS:
        raise ValueError(f"1 to {_MOST_FILTERS} filters, not {n}")
    sums = subset_counts(bitmap_index(flagged, [*filters, *labels], part), filters, labels)
    by_part, every = Window.partitionBy("part"), (1 << n) - 1
    column = lambda f, k=0: F.col(f"c{1 + f * (1 + len(labels)) + k}")
    orders_of = lambda s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
    at_subset = lambda f, s: F.max(F.when(F.col("subset") == s, column(f))).over(by_part)
    wider = {}
    for f in range(n):  # sums over a part's 2^n rows
        weight = F.get(F.array(*(F.lit(0 if s >> f & 1 else orders_of(s)) for s in range(1 << n))), F.col("subset"))
        wider |= {f"fails{f}": at_subset(f, 0), f"only{f}": at_subset(f, every ^ (1 << f)), f"shapley{f}": F.sum(column(f) * weight).over(by_part)}
    sums = sums.withColumns(wider)
    rows = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, f in enumerate(order):
            rows.append(("".join(filters[k] for k in order), step + 1, before, f))
            before |= 1 << f
    steps = flagged.sparkSession.createDataFrame(rows, "filter_order string, step int, subset int, filter int")
    of: dict[str, Column] = {"removed": F.coalesce(*(F.when(F.col("filter") == f, column(f)) for f in range(n)))}
    for name, stem in (("fails", "fails"), ("unique_fails", "only"), ("shapley", "shapley")):
        of[name] = F.coalesce(*(F.when(F.col("filter") == f, F.col(f"{stem}{f}")) for f in range(n)))
    for k, label in enumerate(labels):
        of[f"{label}_lost"] = F.coalesce(*(F.when(F.col("filter") == f, column(f, k + 1)) for f in range(n)))
    found = sums.join(F.broadcast(steps), "subset").select("part", "filter_order", "step", F.col("c0").alias("before"), *(v.alias(k) for k, v in of.items()))
    lost = [f"{label}_lost" for label in labels]
    return found.select("part", "filter_order", "step", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")


def with_labels(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """``flagged`` with good (quality is 1) and toxic (toxic is 1), false where there is no label."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return flagged.join(known, "doc_id", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all whole ``documents``, by source."""
    flagged = text_filters(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    flagged = with_labels(flagged, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))
    return audit(flagged, list("ABCDE"), ["good", "toxic"], "part")


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
marked AS (
  SELECT doc_id, part,
         (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS fails
  FROM worded
),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM marked LEFT JOIN known USING (doc_id) GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
found AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (fails & (before | own) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
         coalesce(sum(n * good) FILTER (fails & own <> 0 AND fails & before = 0), 0) AS good_lost,
         coalesce(sum(n * toxic) FILTER (fails & own <> 0 AND fails & before = 0), 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM found
"""
