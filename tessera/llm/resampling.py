"""Documents drawn by importance, so that their n-grams are distributed like those of a target.

1. Each text's n-grams are counted by hash bucket. A task writes its texts as blocks of a sparse matrix in compressed rows
   (documents by buckets) to the shared folder; texts are read once.
2. Column sums over all blocks give the distribution of the documents, those of the target's blocks that of the target. A task sums
   its blocks, Spark the tasks: as many rows as there are buckets come to the driver, whatever the number of texts.
3. A bucket's gain is the logarithm of the ratio of its smoothed shares, in thousandths. The product of the sparse matrix and the
   gains gives each document's weight.
4. Weights plus Gumbel noise, seeded by the id, make drawing without replacement a matter of the highest scores. Ranks come from
   a sort by range, the numbers of rows of the ranges and the places within them; no task sees all rows.

Defined cases: null and empty texts have no n-grams and weight 0; texts of any length are counted whole; rows without an id draw
their noise as an empty id and come last among equal scores; ties go to the smaller id; repeated rows are documents of their own
with the same score, in any order among each other; an empty target, or no documents, leaves S or T at 0, and the gains are defined all the
same; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.storage import materialize
from tessera.operators.order import numbered

_BUCKETS, _LEAST_WORDS, _SEED, _PERCENT = 10_000, 20, 2024, 10
_SPACED = bytes(0x20 if cut else low for cut, low in zip(T.NOT_ALNUM.tolist(), T.LOWER.tolist(), strict=True))


def _features(text: bytes, longest: int) -> tuple[int, list[int]]:
    """How many words a text has, and the checksums of all runs of one to ``longest`` words."""
    words = text.translate(_SPACED).split(b" ")
    words = [w for w in words if w]
    found = list(map(zlib.crc32, words))
    for n in range(2, longest + 1):
        found += [zlib.crc32(b" ".join(words[k : k + n])) for k in range(len(words) - n + 1)]
    return len(words), found


def count_blocks(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """Blocks of the sparse matrix of ``texts`` (id, text): ids, n_words and ends of the rows' entries, one for each document, and the
    entries' bucket (32 bits) and count (32 bits) as bytes."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, offsets = T.buffer_of(batch.column("text"))
                data, n_words, columns, counts, ends = data.tobytes(), [], [], [], [0]
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    n, found = _features(data[a:b], longest)
                    own, many = np.unique(np.array(found, np.uint32) % np.uint32(buckets), return_counts=True)
                    n_words.append(n)
                    columns.append(own)
                    counts.append(many.astype(np.uint32))
                    ends.append(ends[-1] + len(own))
                row = lambda values, of: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, of))
                packed = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (columns, counts)]
                yield pa.RecordBatch.from_arrays([row(batch.column("id"), None), row(n_words, pa.int64()), row(ends[1:], pa.int64()), *packed], ["ids", "n_words", "ends", "buckets", "counts"])

    return texts.mapInArrow(run, f"ids array<{kind}>, n_words array<long>, ends array<long>, buckets binary, counts binary")


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has, over all blocks; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own, many in zip(batch.column("buckets"), batch.column("counts"), strict=True):
                own, many = np.frombuffer(own.as_buffer(), np.uint32), np.frombuffer(many.as_buffer(), np.uint32)
                total += np.bincount(own, many, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    found = blocks.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target by that in the source."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [(t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every document: the product of the matrix and the gains."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, many = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint32) for c in ("buckets", "counts"))
                ends = np.append(0, batch.column("ends")[k].values.to_numpy())
                sums = [np.diff(np.append(0, np.cumsum(x))[ends]) for x in (many.astype(np.int64), many * gain[own])]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("n_words")[k].values, *map(pa.array, sums)], ["id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column) -> Column:
    """Thousandths of Gumbel noise drawn from a string."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = _PERCENT, buckets: int = _BUCKETS, longest: int = 1, least_words: int = _LEAST_WORDS, seed: int = _SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_features, weight, score, and rank if it is among the ``percent`` drawn of the
    documents with ``least_words`` words. ``target`` has its texts in the column ``text``."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    blocks = materialize(count_blocks(texts, buckets, longest), "blocks")
    wanted = count_blocks(target.select(F.lit(0).alias("id"), "text"), buckets, longest)
    known = weights(blocks, gains(column_sums(blocks, buckets), column_sums(wanted, buckets)))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    scored = materialize(known.withColumn("score", F.col("weight") + gumbel(key)), "scored")
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    rows = numbered(enough, [F.col("score").desc(), F.col("id").asc_nulls_last()])
    rows = rows.withColumn("rank", F.when(F.col("position") <= drawn, F.col("position"))).drop("position", "range")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return rows.unionByName(rest).select(F.col("id").alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all whole ``documents``, drawn to be like ``benchmark``."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
