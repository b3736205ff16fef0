"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some token positions of a window and ignore the others, so a window still matches when words at ignored
positions were substituted. Seeds of the benchmark and of the training texts are joined, and around every hit the texts are
compared token by token along the diagonal that the seed gives, which tolerates substitutions.

Tokens are runs of letters and digits (bytes from 128 on count as letters), A-Z lower-cased. An item matches a document if
some stretch of ``min_tokens`` aligned tokens or more (the whole item where it is shorter) agrees in ``min_identity`` of its
positions; substitutions at its rim count for its length, but not for the place that is reported. Items of fewer than six
tokens are too short to be evidence and match nothing.

A seed that comes often, as in a text of one repeated word, is one row with all of its places: the diagonals of a stretch and an
item are worked out where the two are compared, and each of them is compared once. A stretch's tokens move once for the items that
it meets, and a seed or an item that is met everywhere is spread over tasks.

Defined cases: null and empty texts have no tokens and match nothing; texts of any length are read whole; rows without an id
cannot be named and are left out; repeated documents and items, and several texts of one id, each match by themselves, and the
best overlap of an id and an item is reported; of equally good alignments the one with the fewest tokens, then the earliest;
empty tables give an empty result. Other columns of the inputs are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.filters import bit_table
from tessera.llm.storage import materialize

#: Token positions that each mask looks at. However one substitution in five words lies in a stretch of 12 tokens or more, or
#: in a shorter item, some mask fits between: stretches from 24 tokens on have a half in which no more is substituted. In items
#: of under 12 tokens a substitution can leave no room for five positions and a gap, so these have a mask of four besides.
MASKS = ((0, 1, 2, 4, 5), (0, 2, 3, 4, 5), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5), (0, 1, 2, 3, 6))
SHORT_MASKS = ((0, 1, 2, 4),)
SHORT = 12  # tokens from which on an item needs none of those
SHORTEST = 6  # tokens of an item
_CONTEXT = 64  # tokens kept on either side of a hit for the comparison
_PAIRS = 1 << 18  # pairs of places whose differences are formed one by one
_ITEMS = 256  # items that go to a stretch in one row
_MOST_ROWS = 500_000  # of a table with three numbers a row, to be broadcast
_SALTS = 32


def _tokens(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, ...]:
    data, offsets = T.buffer_of(batch.column(column))
    starts, ends, doc = T.words(data, offsets, T.NOT_ALNUM)
    return data, offsets, starts, ends, doc, T.word_hashes(data, starts, ends)


def _seeds(hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k, mask in enumerate(MASKS + SHORT_MASKS):
        found, at = T.window_hashes(hashes, doc, list(mask))
        yield T.mix(found ^ T.U64(k + 1)), at


def _by_seed(owner: np.ndarray, seeds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Owners and seeds, each pair once, with the list of its places."""
    order = np.lexsort((at, seeds, owner))
    owner, seeds, at = owner[order], seeds[order], at[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (seeds[1:] != seeds[:-1]))) if len(at) else np.zeros(0, np.int64)
    return owner[first], seeds[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at, pa.int32()))


def _items(bench: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, tokens) of every item that has an id and enough tokens; ``item`` is its id and the hash of its text."""
    rows = bench.where(F.col(id_column).isNotNull()).select(F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h")).alias("item"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                *_, doc, hashes = _tokens(batch, "text")
                cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                tokens = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("item"), tokens], ["item", "tokens"])

    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, tokens array<long>").where(F.size("tokens") >= SHORTEST)


def _item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, item_at): one row for each seed of an item, with all of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            first = np.cumsum(lengths) - lengths
            for k, (seeds, at) in enumerate(_seeds(hashes, doc)):
                if k >= len(MASKS):
                    short = lengths[doc[at]] < SHORT
                    seeds, at = seeds[short], at[short]
                own, seeds, places = _by_seed(doc[at], seeds, at - first[doc[at]])
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), batch.column("item").take(pa.array(own)), places], ["seed", "item", "item_at"])

    return items.mapInArrow(run, f"seed long, item {items.schema['item'].dataType.simpleString()}, item_at array<int>")


def _segments(docs: DataFrame, table, kind: str) -> DataFrame:
    """Stretches of documents around positions whose seed may be one of the benchmark's, with the tokens, and those seeds with
    their places."""
    names = ["doc", "segment", "tokens", "starts", "ends", "seeds", "ats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, offsets, starts, ends, doc, hashes = _tokens(batch, "text")
                found = []
                for seeds, at in _seeds(hashes, doc):
                    hit = table.value.maybe(seeds)
                    found.append((at[hit], seeds[hit]))
                at = np.concatenate([f[0] for f in found])
                if not len(at):
                    continue
                seeds = np.concatenate([f[1] for f in found])
                order = np.argsort(at, kind="stable")
                at, seeds = at[order], seeds[order]
                cuts = np.flatnonzero(np.append(True, (np.diff(at) > _CONTEXT) | (doc[at[1:]] != doc[at[:-1]])))
                last = np.append(cuts[1:], len(at)) - 1
                own = doc[at[cuts]]
                low = np.maximum(np.searchsorted(doc, own), at[cuts] - _CONTEXT)
                high = np.minimum(np.searchsorted(doc, own, side="right"), at[last] + _CONTEXT)
                points = T.code_points(data)
                take = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
                base = np.repeat(points[offsets[own]], high - low)
                lists = pa.array(np.append(0, np.cumsum(high - low)), pa.int32())
                segment = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(at))))
                of, seeds, places = _by_seed(segment, seeds, at - low[segment])
                per = pa.array(np.searchsorted(of, np.arange(len(cuts) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(pa.array(own)),
                        pa.array(low - np.searchsorted(doc, own), pa.int64()),
                        *(pa.ListArray.from_arrays(lists, pa.array(v)) for v in (hashes[take].view(np.int64), points[starts[take]] - base, points[ends[take]] - base)),
                        pa.ListArray.from_arrays(per, pa.array(seeds.view(np.int64))),
                        pa.ListArray.from_arrays(per, places),
                    ],
                    names,
                )

    return docs.mapInArrow(run, f"doc {kind}, segment long, tokens array<long>, starts array<long>, ends array<long>, seeds array<long>, ats array<array<int>>")


def best_stretch(same: np.ndarray, identity: float, least: int = 0) -> tuple[int, int]:
    """The stretch with the most agreeing positions among those that agree in ``identity`` of their positions (earliest on ties).

    Only stretches of ``least`` positions or more count; without any, an empty one."""
    # A stretch qualifies if its sum of (agreement - identity) isn't negative: for each start the furthest end is found over
    # suffix maxima of the running sum.
    run = np.append(0.0, np.cumsum(same - identity))
    far = np.maximum.accumulate(run[::-1])[::-1]
    # far falls from left to right, so the last place where far >= run[start] is the furthest end.
    ends = len(run) - np.searchsorted(far[::-1], run - 1e-9, side="left") - 1
    agreed = np.append(0, np.cumsum(same))
    gain = np.where(ends - np.arange(len(ends)) >= least, agreed[ends] - agreed, -1)
    if gain.max() < 0:
        return 0, 0
    start = int(np.argmax(gain))
    return start, int(ends[start])


def best_overlap(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray, min_tokens: int, identity: float) -> tuple[int, int, int] | None:
    """Start and end in ``a`` and agreeing tokens of the best overlap with ``b`` on one of the diagonals (places in ``a`` of b's
    first token, in ascending order): of most agreeing tokens, then of fewest tokens, then the earliest."""
    best = None
    least = min(min_tokens, len(b))
    # The longest overlaps first: what is shorter than the best one's agreement can't be better.
    long = np.minimum(len(a), diagonals + len(b)) - np.maximum(0, diagonals)
    for k in np.argsort(-long, kind="stable").tolist():
        shift = int(diagonals[k])
        if long[k] < least or best is not None and long[k] < best[0][0]:
            break
        low, high = max(0, shift), min(len(a), shift + len(b))
        same = a[low:high] == b[low - shift : high - shift]
        s, e = best_stretch(same, identity, least)
        if e - s < least:
            continue
        # Substitutions at the rim are left out of the place.
        hit = np.flatnonzero(same[s:e])
        if len(hit):
            s, e = s + int(hit[0]), s + int(hit[-1]) + 1
            rank = len(hit), s - e, -shift
            if best is None or rank > best[0]:
                best = rank, low + s, low + e
            if len(hit) == len(b):  # no later diagonal is better
                break
    return None if best is None else (best[1], best[2], best[0][0])


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The different values of x - y over all pairs of two lists of places, in ascending order. Long lists are correlated, so memory
    is that of the places' range and not of the pairs."""
    if len(x) * len(y) <= _PAIRS:
        return np.unique(x[:, None] - y[None, :])
    low, high = int(x.min()), int(y.max())
    one, two = np.zeros(int(x.max()) - low + 1), np.zeros(high - int(y.min()) + 1)
    one[x - low], two[high - y] = 1, 1
    n = 1 << (len(one) + len(two) - 1).bit_length()
    met = np.fft.irfft(np.fft.rfft(one, n) * np.fft.rfft(two, n), n)
    return np.flatnonzero(met > 0.5) + low - high


def _compare(pairs: DataFrame, min_tokens: int, identity: float) -> DataFrame:
    """(doc, item, start, end, n_aligned, n_same, item_tokens) of the stretches and items that match; a row has a stretch and items that
    it meets."""
    names = ["doc", "item", "start", "end", "n_aligned", "n_same", "item_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k in range(batch.num_rows):
                tokens, starts, ends = (batch.column(c)[k].values.to_numpy() for c in ("tokens", "starts", "ends"))
                own = batch.column("items")[k].values
                for j in range(len(own)):
                    met = own.field("met")[j].values
                    shifts = [differences(x.values.to_numpy().astype(np.int64), y.values.to_numpy().astype(np.int64)) for x, y in zip(met.field("at"), met.field("item_at"), strict=True)]
                    b = own.field("item_tokens")[j].values.to_numpy()
                    found = best_overlap(tokens, b, np.unique(np.concatenate(shifts)), min_tokens, identity)
                    if found is not None:
                        s, e, same = found
                        keep.append(k)
                        out.append((own.field("item")[j], int(starts[s]), int(ends[e - 1]), e - s, same, len(b)))
            if keep:
                items, *numbers = zip(*out, strict=True)
                ids = [batch.column("doc").take(pa.array(keep)), pa.array([v.as_py() for v in items], batch.schema.field("items").type.value_type.field("item").type)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, pa.int64()) for c in numbers)], names)

    kinds = pairs.schema["doc"].dataType.simpleString(), pairs.schema["items"].dataType.elementType["item"].dataType.simpleString()
    return pairs.mapInArrow(run, f"doc {kinds[0]}, item {kinds[1]}, start long, end long, n_aligned long, n_same long, item_tokens long")


def _spread(rows: DataFrame, table: DataFrame, key: str, small: bool) -> DataFrame:
    """Join of ``rows`` with the benchmark's ``table``, however many rows have the same key: a table that was found ``small`` is broadcast,
    another one repeated for each of ``_SALTS`` parts that its keys' rows are dealt over."""
    if small:
        return rows.join(F.broadcast(table), key)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "segment"), F.lit(_SALTS)))
    many = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    return dealt.join(many, [key, "salt"]).drop("salt")


def decontaminate(docs: DataFrame, bench: DataFrame, min_tokens: int = 12, min_identity: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text_column: str = "text", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, the longest overlap's start and end (code
    points, end exclusive), its aligned and agreeing tokens, and the item's tokens."""
    items = materialize(_items(bench, item_id, item_text), "items")
    seeds = materialize(_item_seeds(items), "item_seeds")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(seeds, "seed"))
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text_column).alias("h")).alias("doc"), F.col(text_column).alias("text"))
    segments = materialize(_segments(texts, table, texts.schema["doc"].dataType.simpleString()), "segments")
    hits = segments.select("doc", "segment", F.explode(F.arrays_zip("seeds", "ats")).alias("h")).select("doc", "segment", F.col("h.seeds").alias("seed"), F.col("h.ats").alias("at"))
    met = _spread(hits, seeds, "seed", seeds.count() <= _MOST_ROWS).groupBy("doc", "segment", "item").agg(F.collect_list(F.struct("at", "item_at")).alias("met"))
    # Items go to the stretches, some hundred at a time, and so a stretch's tokens move once for all of them.
    n = F.count("*").over(Window.partitionBy("doc", "segment"))
    met = met.withColumn("part", F.pmod(F.xxhash64("item"), F.ceil(n / _ITEMS)))
    size = items.agg(F.coalesce(F.sum(F.size("tokens") + 8), F.lit(0))).first()[0]
    met = _spread(met, items.withColumnRenamed("tokens", "item_tokens"), "item", size <= 4 * _MOST_ROWS)
    met = met.groupBy("doc", "segment", "part").agg(F.collect_list(F.struct("item", "item_tokens", "met")).alias("items"))
    found = _compare(met.join(segments.select("doc", "segment", "tokens", "starts", "ends"), ["doc", "segment"]), min_tokens, min_identity)
    best = F.struct("n_same", (-F.col("n_aligned")).alias("a"), (-F.col("start")).alias("s"), "end", "item_tokens")
    found = found.groupBy(F.col("doc.id").alias("doc_id"), F.col("item.id").alias("item_id")).agg(F.max(best).alias("b"))
    return found.select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.end").alias("end"), (-F.col("b.a")).alias("n_aligned"), F.col("b.n_same").alias("n_same"), F.col("b.item_tokens").alias("item_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole ``documents`` against all items of ``benchmark``."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
