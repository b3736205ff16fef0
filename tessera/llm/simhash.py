"""Near copies by SimHash fingerprints and a multi-index over their segments.

A text's features are its shingles of three words, with repeats; a bit of its 64-bit fingerprint is 1 if it is set in over half
of the features' hashes. Two texts are linked if their fingerprints differ in at most ``distance`` bits, and a component is
whatever links reach.

1. Equal fingerprints are one node, however many texts have it.
2. A fingerprint is cut into segments. Within each, the small Hamming ball around the segment's value is enumerated, and
   balls of several segments are combined up to half the distance (rounded up) in all. Each value so made, with the untouched
   segments beside it, is a key of the index. Fingerprints within the distance have a key half-way between them in common.
3. Keys that several fingerprints have are the matches. Since a key says all 64 bits, only real neighbours meet under one, at most
   as many as the ball has values (65 for a distance of 2), however large a group of copies is. Complete distances are verified,
   and all members of a key are linked with one of those nearest to it: a star, and not all pairs.
4. Components of these links, found by alternating stars in Spark, get the smallest id of their texts.

A plain index by segment would bring together all fingerprints with an equal half, which in a large group of near copies
is a number of pairs that grows with the square; here rows are 65 a distinct fingerprint.

Defined cases: null, empty and blank texts have the fingerprint zero, which links like any other; texts of one or two words have
one feature, the whole sequence; texts of any length are read whole; rows without an id have a fingerprint and link, but are
nobody's component (if none of a component has an id, it is null); repeated rows are repeated in the result; of texts that tie for
a component's name the smallest id gives it; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.joins import join_counted
from tessera.llm.storage import materialize

_BITS = 64
_AT_ONCE = 1 << 16  # shingles whose bits are counted together


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text; upper-case A-Z count as lower-case."""
    own = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not own:
        return 0
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    begins = np.cumsum(lengths + 1) - lengths - 1
    span = min(words, len(own))
    starts, ends = begins[: len(own) - span + 1], (begins + lengths)[span - 1 :]
    joined, counts = b" ".join(own), np.zeros(_BITS, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, len(starts), _AT_ONCE):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + _AT_ONCE].tolist(), ends[k : k + _AT_ONCE].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, bits) of every row, ``bits`` being the fingerprint as a signed long."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, bits long")


def segment_balls(radius: int, segments: int = 2) -> list[int]:
    """Masks that flip ``radius`` bits at most: the balls within each segment, and their combinations over segments."""
    width = _BITS // segments
    found = {0: 0}  # mask -> bits it flips
    for s in range(segments):
        low, high = s * width, _BITS if s == segments - 1 else (s + 1) * width
        ball = {0: 0}
        for size in range(1, radius + 1):
            ball |= {m | 1 << bit: size for m, k in list(ball.items()) if k == size - 1 for bit in range(low, high) if not m >> bit & 1}
        found = {m | b: k + j for m, k in found.items() for b, j in ball.items() if k + j <= radius}
    return sorted(found, key=lambda m: (found[m], m))


def links(nodes: DataFrame, distance: int = 2, segments: int = 2) -> DataFrame:
    """(a, b) between values of the column ``bits``, each once in ``nodes``: enough of the pairs within ``distance`` to connect all of them."""
    if not 0 <= distance <= 4:
        raise ValueError("a distance of 0 to 4 bits")
    radius = (distance + 1) // 2
    masks = segment_balls(radius, segments)
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    # A few rows a file become many: they are dealt out first.
    dealt = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bits")
    met = dealt.select("bits", F.explode(signed).alias("mask")).select("bits", F.col("bits").bitwiseXOR(F.col("mask")).alias("key"))
    # By distance from the key, then value: the first is the star's middle.
    off = F.bit_count(F.col("bits").bitwiseXOR(F.col("key")))
    groups = met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(off.alias("off"), "bits"))).alias("g")).where(F.size("g") > 1)
    middle = F.get("g", F.lit(0))["bits"]
    pairs = groups.select(middle.alias("a"), F.explode(F.slice("g", 2, len(masks))).alias("other")).select("a", F.col("other.bits").alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_copies(docs: DataFrame, distance: int = 2, segments: int = 2, words: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, bits (signed), n_same (texts of the same fingerprint, itself included) and component_id."""
    found = materialize(fingerprints(docs, id_column, text_column, words, seed), "fingerprints")
    nodes = materialize(found.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")), "nodes")
    reached = components(links(nodes.select("bits"), distance, segments)).select(F.col("id").alias("bits"), "component")
    placed = materialize(nodes.join(reached, "bits", "left").withColumn("component", F.coalesce("component", "bits")), "placed")
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(placed.join(names, "component").select("bits", "n_same", "component_id"), "named")
    return join_counted(found, named, "bits", "n_same", found.count())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all whole ``documents``, at two bits."""
    rows = near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "n_same")
