"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A text is the set of its five-word shingles (words are runs without white space, case of A-Z doesn't count; a text of one to
four words is a single shingle). Two texts are linked if the Jaccard similarity of their sets is ``threshold`` or more.

1. Texts with equal sets form a class; the rest works on one set of each class.
2. Each of ``trees`` prefix tries holds the classes' signatures of ``longest`` MinHash values. Classes that are alone under even
   the shortest prefix of each of their signatures meet nobody and go no further.
3. The tries are matched from the longest prefix up. The pairs that share a prefix are verified on their full shingle sets, and
   from the links found each class's recall is estimated: a link of similarity s is met at length k with probability
   ``1 - (1 - s^k)^trees``, so it stands for the inverse of that many. Prefixes are shortened for those classes only that have
   no link yet or whose estimated recall is below ``enough``; at the shortest length a pair just at the threshold is met with
   probability ``recall``. A pair is verified in the first round in which it meets while one of both is in search, once. A class
   that had found enough searches again when links found from other ends show that it hadn't.
4. For verification classes that meet, directly or through others, are put into blocks of bounded size, those under the same
   large node of a trie together, and only blocks that have classes under a common node are brought together. Of two such
   blocks only those pairs are looked at that met; intersections are counted by products of incidence matrices. No pairs are
   emitted: a pair of blocks gives each class's number of links and the edges of a spanning forest of its links.

Links between different texts are thus counted as surely as the recall asks, groups are exact components of the found links, and
rows stay proportional to members times blocks.

Defined cases: null, empty and blank texts have no shingles and link to nothing, each is its own class; texts of any length are
read whole; rows without an id are left out (and kept by ``keep_one``); repeated rows of one id and text count once per row and
stay or go together; several texts of one id are texts of their own; of texts that tie for a group's place the one with the
smallest id stays, and of one id's that with the smallest hash; empty tables give an empty result; other columns are not looked
at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.components import components
from tessera.llm.filters import bit_table
from tessera.llm.joins import drop_rows
from tessera.llm.storage import discard, materialize

_WORDS = 5
_BLOCK_DOCS, _BLOCK_SHINGLES = 512, 400_000
_COLUMNS = 2048
_LINKS = "digest string, n_links long, n_docs long, estimates array<double>, joined string"
_MOST_BROADCAST = 200_000  # rows of a few numbers


def prefix_lengths(trees: int, recall: float, threshold: float, longest: int = 8) -> list[int]:
    """The lengths at which tries are matched, from the longest to the one that suffices for any pair."""
    last = prefix_length(trees, recall, threshold, longest)
    return [*range(longest, last, -2), last]


def prefix_length(trees: int, recall: float, threshold: float, longest: int = 8) -> int:
    """The longest prefix at which a pair at ``threshold`` is met in one of ``trees`` with probability ``recall``."""
    length = longest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingle_sets(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text end to end, sorted within a text, and the texts' offsets."""
    data, offsets = T.buffer_of(batch.column(column))
    starts, ends, doc = T.words(data, offsets)
    hashes = T.word_hashes(data, starts, ends)
    found, at = T.window_hashes(hashes, doc, list(range(_WORDS)))
    cuts = np.searchsorted(doc[at], np.arange(batch.num_rows + 1)) if len(at) else np.zeros(batch.num_rows + 1, np.int64)
    words = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    sets = []
    for k in range(batch.num_rows):
        n = words[k + 1] - words[k]
        if n >= _WORDS:
            sets.append(np.unique(found[cuts[k] : cuts[k + 1]]))
        elif n:
            own = hashes[words[k] : words[k + 1]]
            sets.append(T.mix((T.mix(own + T.U64(n)) * np.arange(1, n + 1, dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum([0, *map(len, sets)])


def signature_keys(shingles: np.ndarray, offsets: np.ndarray, trees: int, lengths: list[int]) -> np.ndarray:
    """Keys (sets x lengths x trees) of the prefixes of the signatures of the sets between ``offsets``, which must not be empty."""
    n, longest = len(offsets) - 1, max(lengths)
    keys = np.zeros((n, len(lengths), trees), np.uint64)
    draw = np.random.default_rng(20_240_501)
    factor = draw.integers(1, 1 << 63, (trees, longest), dtype=np.uint64) * T.U64(2) + T.U64(1)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 16_384, side="right")) - 1)
        own = shingles[offsets[at] : offsets[to]]
        begins = offsets[at:to] - offsets[at]
        product = np.empty_like(own)
        for tree in range(trees):
            key = np.full(to - at, tree + 1, np.uint64)
            for k in range(longest):
                np.multiply(own, factor[tree, k], out=product)
                key = T.mix(key + np.minimum.reduceat(product, begins))
                if k + 1 in lengths:
                    keys[at:to, lengths.index(k + 1), tree] = key
        at = to
    return keys


def _digests(shingles: np.ndarray, offsets: np.ndarray) -> list[str | None]:
    """128 bits of every set, null for an empty one."""
    has = np.flatnonzero(np.diff(offsets))
    digest = np.zeros((len(offsets) - 1, 2), np.uint64)
    for k in range(2):
        if len(has):
            digest[has, k] = T.mix(np.add.reduceat(T.mix(shingles + T.U64(k * 77)), offsets[has]))
    return [f"{a:016x}{b:016x}" if n else None for a, b, n in zip(*digest.T.tolist(), np.diff(offsets).tolist(), strict=True)]


def _classes(docs: DataFrame, kind: str, trees: int, lengths: list[int]) -> DataFrame:
    """(doc, digest, n_shingles, keys) of every text; without words the digest is null."""
    wide = trees * len(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                shingles, offsets = shingle_sets(batch, "text")
                sizes = np.diff(offsets)
                has = np.flatnonzero(sizes)
                keys = np.zeros((len(sizes), wide), np.uint64)
                if len(has):
                    keys[has] = signature_keys(shingles, np.append(offsets[has], offsets[-1]), trees, lengths).reshape(len(has), wide)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * wide, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(_digests(shingles, offsets), pa.string()), pa.array(sizes, pa.int64()), lists], ["doc", "digest", "n_shingles", "keys"])

    return docs.mapInArrow(run, f"doc {kind}, digest string, n_shingles long, keys array<long>")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys``, of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        if held and tuple(c[0] for c in columns) != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def intersections(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b`` (or with each other): products of incidence matrices
    over the shingles that come twice, some of them at a time."""
    sets = a + (b or [])
    every = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    own = own[order]
    new = np.append(True, np.diff(every[order]) != 0)
    del every, order
    code = np.cumsum(new, dtype=np.int32) - 1
    twice = np.bincount(code)[code] > 1
    own, code = own[twice], np.cumsum(new[twice], dtype=np.int32) - 1
    counts = np.zeros((len(a), len(b) if b else len(a)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, _COLUMNS):
        s, e = np.searchsorted(code, [low, low + _COLUMNS])
        x = np.zeros((len(sets), _COLUMNS), np.float32)
        x[own[s:e], code[s:e] - low] = 1
        counts += x[: len(a)] @ (x[len(a) :].T if b else x.T)
    return counts


def _compare(rows: DataFrame, threshold: float, trees: int, lengths: list[int], level: int) -> DataFrame:
    """(digest, n_links, n_docs, estimates, joined) of the classes in pairs of blocks (i, j): links between pairs that meet at
    ``lengths[level]``, one of them in search of links, and were not verified before; the estimates of all links for each length;
    and the first class of those that it is linked with here. Bit k of ``active`` tells whether a class searched at level k."""
    chance = lambda s, k: 1 - (1 - s**k) ** trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            digests, links, docs, estimates, to = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(digests), pa.array(links, pa.int64()), pa.array(docs, pa.int64()), pa.array(estimates, pa.list_(pa.float64())), pa.array(to)], ["digest", "n_links", "n_docs", "estimates", "joined"])

        def met(keys: np.ndarray, a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
            some = np.zeros((len(a), len(b)), bool)
            for tree in range(at * trees, (at + 1) * trees):
                some |= keys[a, tree][:, None] == keys[b, tree][None, :]
            return some

        for group in _runs(batches, ["i", "j"]):
            # A class can come twice where an id hash leads to its set twice.
            _, once = np.unique(np.array(group.column("digest").to_pylist()), return_index=True)
            group = group.take(pa.array(once))
            digests, size, block = group.column("digest").to_pylist(), group.column("n_docs").to_numpy(), group.column("block").to_numpy()
            keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(digests), -1)
            active = group.column("active").to_numpy()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            a, b = (np.flatnonzero(block == i), np.flatnonzero(block == j)) if i != j else (np.arange(len(digests)),) * 2
            searched = active[a][:, None] | active[b][None, :]
            wanted = met(keys, a, b, level) & (searched >> level & 1 == 1)
            for before in range(level):
                if wanted.any():
                    wanted &= ~(met(keys, a, b, before) & (searched >> before & 1 == 1))
            if i == j:
                np.fill_diagonal(wanted, False)
            sizes = group.column("n_shingles").to_numpy()
            wanted &= np.minimum(sizes[a][:, None], sizes[b][None, :]) >= threshold * np.maximum(sizes[a][:, None], sizes[b][None, :])
            rows, columns = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
            if not len(rows):
                continue
            a, b, wanted = a[rows], b[columns], wanted[np.ix_(rows, columns)]
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles").combine_chunks()]
            same = i == j and len(a) == len(b) and (a == b).all()
            both = intersections([sets[x] for x in a], None if same else [sets[x] for x in b]).astype(np.float64)
            similar = both / (sizes[a][:, None] + sizes[b][None, :] - both)
            linked = wanted & (similar >= threshold)
            x, y = np.nonzero(linked)
            if not len(x):
                continue
            stands_for = np.stack([1 / chance(similar[x, y], k) for k in lengths], 1)
            # Within a block every link is seen from both of its ends, between two blocks from one.
            ends = [(a[x], b[y])] if i == j else [(a[x], b[y]), (b[y], a[x])]
            degree, weight, estimate = np.zeros(len(digests)), np.zeros(len(digests)), np.zeros((len(digests), len(lengths)))
            for one, other in ends:
                np.add.at(degree, one, 1)
                np.add.at(weight, one, size[other])
                np.add.at(estimate, one, stands_for)
            label = _first_of_component(len(digests), a[x], b[y])
            out += [(digests[k], int(degree[k]), int(weight[k]), estimate[k].tolist(), digests[label[k]]) for k in np.flatnonzero(degree)]
            if len(out) > 4096:
                yield made()
        if out:
            yield made()

    return rows.mapInArrow(run, _LINKS)


def _first_of_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the first node of its component, given edges."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sets(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(digest, shingles) of the texts of ``chosen`` classes, and of a few more that a bit table of bounded size lets pass:
    so sets travel to the join, and never the texts of all documents."""
    table = texts.sparkSession.sparkContext.broadcast(bit_table(chosen.select(F.xxhash64("rep").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            maybe = table.value.maybe(whole.column("h").to_numpy().view(np.uint64))
            for batch in T.slices(whole.take(pa.array(maybe)), "text", 1 << 20):
                shingles, offsets = shingle_sets(batch, "text")
                packed = pa.array([shingles[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_digests(shingles, offsets), pa.string()), packed], ["digest", "shingles"])

    return texts.select("text", F.xxhash64("doc").alias("h")).mapInArrow(run, "digest string, shingles binary")


def _shared_prefixes(rows: DataFrame, trees: int, level: int) -> DataFrame:
    """(key, node, n) of the prefixes at a level under which several classes stand, one of them in search, that haven't all met at
    the level before, or of which one didn't search then."""
    each = F.explode(F.arrays_zip(F.slice("keys", level * trees + 1, trees).alias("key"), F.slice("keys", max(0, level - 1) * trees + 1, trees).alias("longer"))).alias("k")
    under = rows.select("node", "active", each).select("node", "active", "k.key", "k.longer")
    searches = lambda k: F.col("active").bitwiseAND(F.lit(1 << k)) != 0
    new = F.lit(True) if level == 0 else (F.min("longer") < F.max("longer")) | F.max(searches(level) & ~searches(level - 1))
    shared = under.groupBy("key").agg(F.count("*").alias("n"), F.max(searches(level)).alias("some"), new.alias("new")).where("n > 1 and some and new")
    return under.select("key", "node").join(shared.select("key", "n"), "key")


def _blocks(sets: DataFrame, under: DataFrame) -> DataFrame:
    """(node, block): as many blocks to a cluster of classes that meet as its size asks for, dealt by the largest shared prefix."""
    firsts = under.groupBy("key").agg(F.min("node").alias("first"))
    meets = under.join(firsts, "key").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    clusters = materialize(components(meets).select(F.col("id").alias("node"), F.col("component").alias("cluster")), "clusters")
    sized = clusters.join(sets.select("node", "n_shingles"), "node").groupBy("cluster")
    parts = materialize(sized.agg(F.greatest(F.ceil(F.count("*") / _BLOCK_DOCS), F.ceil(F.sum("n_shingles") / _BLOCK_SHINGLES)).alias("parts")), "parts")
    home = under.groupBy("node").agg(F.max(F.struct("n", "key")).alias("h"))
    share = F.pmod(F.xxhash64("node"), F.ceil(F.col("h.n") / _BLOCK_DOCS))
    rows = home.join(clusters, "node").join(parts, "cluster")
    return materialize(rows.select("node", F.xxhash64("cluster", F.pmod(F.xxhash64("h.key", share), F.col("parts"))).alias("block")), "placed")


def _verify(sets: DataFrame, now: DataFrame, placed: DataFrame, threshold: float, trees: int, lengths: list[int], level: int) -> DataFrame | None:
    """One round: the links of the pairs that meet at this level, in pairs of blocks that have a prefix in common. ``now`` has the
    classes' keys, and the levels at which they search for links. None if nobody meets."""
    under = materialize(_shared_prefixes(now, trees, level).join(placed, "node").select("key", "node", "block"), "prefixes")
    # A prefix has few blocks, and many prefixes have the same ones.
    together = under.groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("b")).select("b").distinct()
    pairs = together.select(F.explode(F.transform("b", lambda i, k: F.struct(i.alias("i"), F.slice("b", k + 1, F.size("b") - k).alias("js")))).alias("p"))
    pairs = pairs.select("p.i", F.explode("p.js").alias("j")).distinct()
    ends = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    of = pairs.select(F.explode(ends).alias("block"), "i", "j")
    sent = under.select("node", "block").distinct().join(of, "block").join(now.select("node", "active"), "node")
    sent = materialize(sent.select("node", "block", "i", "j", "active"), "sent")
    n_sent = sent.count()
    if not n_sent:
        discard(under, sent)
        return None
    rows = sets.join(F.broadcast(sent) if n_sent <= _MOST_BROADCAST else sent, "node").select("i", "j", "block", "digest", "n_docs", "n_shingles", "keys", "active", "shingles")
    links = materialize(_compare(rows.repartition("i", "j").sortWithinPartitions("i", "j"), threshold, trees, lengths, level), "links")
    discard(under, sent)
    return links


def _all(found: list[DataFrame], spark: SparkSession) -> DataFrame:
    """The links of all rounds so far."""
    return reduce(DataFrame.union, found, spark.createDataFrame([], _LINKS))


def linked(docs: DataFrame, id_column: str, text_column: str, threshold: float, trees: int = 20, recall: float = 0.999, enough: float = 0.99999, longest: int = 8) -> DataFrame:
    """(doc, class_doc, group_doc, n_links, n_similar_docs) of every row with an id; ``doc`` is (id, hash of the text)."""
    lengths = prefix_lengths(trees, recall, threshold, longest)
    spark = docs.sparkSession
    texts = docs.where(F.col(id_column).isNotNull()).select(F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h")).alias("doc"), F.col(text_column).alias("text"))
    members = materialize(_classes(texts, texts.schema["doc"].dataType.simpleString(), trees, lengths), "members")
    worded = members.where("digest is not null")
    classes = worded.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = materialize(classes.withColumns({"node": F.xxhash64("digest"), "active": F.lit(True)}), "classes")
    # Those that are alone under all of their shortest prefixes go no further.
    under = classes.select("node", F.explode(F.slice("keys", (len(lengths) - 1) * trees + 1, trees)).alias("key"))
    shared = materialize(under.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    under = materialize(under.join(shared, "key"), "under")
    chosen = materialize(classes.join(under.select("node").distinct(), "node", "left_semi"), "chosen")
    sets = chosen.join(_sets(texts, chosen).hint("merge"), "digest").select(*chosen.columns, "shingles")
    sets = materialize(sets.dropDuplicates(["digest"]).drop("active", "rep"), "sets")
    placed = _blocks(sets, under)
    discard(shared, under, chosen)
    found = []
    now = sets.select("node", "digest", "keys").withColumn("active", F.lit(1))
    for level in range(len(lengths)):
        if level:  # who has found enough only answers
            done = _all(found, spark).groupBy("digest").agg(F.sum("n_links").alias("n"), F.sum(F.get("estimates", F.lit(level - 1))).alias("all")).where(F.col("n") >= enough * F.col("all"))
            searches = F.when(F.col("done").isNull(), F.col("active") + (1 << level)).otherwise(F.col("active"))
            now = materialize(now.join(done.select("digest", F.lit(True).alias("done")), "digest", "left").withColumn("active", searches).drop("done"), "now")
        links = _verify(sets, now, placed, threshold, trees, lengths, level)
        found += [] if links is None else [links]
    found = _all(found, spark)
    groups = components(found.select(F.col("digest").alias("a"), F.col("joined").alias("b")))
    totals = found.groupBy("digest").agg(F.sum("n_links").alias("n_links"), F.sum("n_docs").alias("n_linked"))
    groups = classes.select("digest", "rep").join(groups.withColumnRenamed("id", "digest"), "digest")
    firsts = groups.groupBy("component").agg(F.min("rep").alias("group_doc"))
    groups = materialize(groups.join(firsts, "component").select("digest", "group_doc"), "groups")
    known = classes.select("digest", "rep", "n_docs").join(totals, "digest", "left").join(groups, "digest", "left")
    known = materialize(known, "known")
    none = F.lit(0).cast("long")
    columns = {"class_doc": F.col("rep"), "group_doc": F.coalesce("group_doc", "rep"), "n_links": F.coalesce("n_links", none), "n_similar_docs": F.col("n_docs") - 1 + F.coalesce("n_linked", none)}
    with_words = worded.select("doc", "digest").join(known, "digest").select("doc", *(v.alias(k) for k, v in columns.items()))
    return with_words.union(members.where("digest is null").select("doc", "doc", "doc", none, none))


def ngram_join(docs: DataFrame, threshold: float = 0.8, trees: int = 20, recall: float = 0.999, enough: float = 0.99999, longest: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id (smallest id with the same shingles), n_links (classes that it links to),
    n_similar_docs (all other documents at the threshold, copies included) and group_id (smallest id of its component)."""
    rows = linked(docs, id_column, text_column, threshold, trees, recall, enough, longest)
    return rows.select(F.col("doc.id").alias("doc_id"), F.col("class_doc.id").alias("class_id"), "n_links", "n_similar_docs", F.col("group_doc.id").alias("group_id"))


def keep_one(docs: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; columns stay as they are."""
    rows = linked(docs, id_column, text_column, threshold)
    dropped = materialize(rows.where("doc <> group_doc").select("doc").distinct(), "dropped")
    whole = docs.select(F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h")).alias("doc"), F.struct(*docs.columns).alias("row"))
    return drop_rows(whole, dropped, "doc").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all whole ``documents``."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
