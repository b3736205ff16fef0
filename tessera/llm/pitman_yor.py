"""Language-model scores under a hierarchical Pitman-Yor model.

Words are dishes. The restaurant of a context serves the words that followed it; its parent, the root restaurant that all
contexts share, is served a customer for every table of its children. The most frequent words are contexts of their own, as many
as ``words_of_their_own``; all other words share the ``classes`` restaurants that their hashes lead to, and the start of a text
is a context besides. So the number of restaurants doesn't grow with the vocabulary, while what each of them has seen does. The
root's base measure has no atoms: an unknown word opens a new table there, and all unknown words together are one event, as in
the base score.

The seating is sampled by Gibbs sweeps. For a (context, word) with c customers only the number of tables t matters; given all
other tables its distribution is proportional to S(c, t), the generalised Stirling number, times the probability that the t
tables open in the context and send their customers to the root, one after the other. It is drawn exactly for c up to 256.
Beyond that S(c, t) follows from its row of 256 customers, since it depends on t / c^discount but for known factors, and t is
drawn one by one up to 128, and beyond from cells that each span a few per cent. The draws of a sweep go by turns, each of them
given what the turns before have changed of the word's own tables in all contexts; what other words have changed in the sums of
contexts and of the root is seen in the next sweep (as in distributed samplers for topic models). So a sweep is one pass over the
counts, of which only sums by context are shuffled. Predictive probabilities are averaged over the sweeps after ``burn_in``. Draws
are seeded by the words and the sweep and depend on no bucket, task or file, so a lost and repeated task draws the same, and
the scores are a function of the table.

Everything is joined by Spark on word hashes; bounded arrays hold what a task works on. Hash buckets bound what one task
holds: their number follows the number of tokens.

Defined cases: a null or empty text is the end token alone; texts of any length are scored whole; words that tie for a context of
their own are ordered by hash; rows without an id are scored but not learned from; repeated rows count and score alike; with
nothing learned every token is unknown; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.storage import discard, materialize, small_batches

_END = T.U64(0x5851F42D4C957F2D)  # the hash of the end token, which no word has but by chance
_EXACT = 256
_SINGLE, _CELLS = 128, 256  # numbers of tables looked at one by one, and in cells, for a dish with more customers
_TURNS = 8  # of a sweep; a power of two
_BUCKET_TOKENS = 2_000_000  # tokens that one bucket should hold
_HELD_WORDS = 1_000_000  # words whose counts a task holds
_BROADCAST_BYTES = 48 << 20  # of the words that are scored where the texts are


def _stream(batch: pa.RecordBatch, m: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context and text of every token, the end tokens included."""
    data, offsets = T.buffer_of(batch.column("text"))
    starts, ends, doc = T.words(data, offsets)
    hashes = T.word_hashes(data, starts, ends)
    n = np.bincount(doc, minlength=batch.num_rows)
    all_docs = np.repeat(np.arange(batch.num_rows), n + 1)
    is_end = np.zeros(len(all_docs), bool)
    is_end[np.cumsum(n + 1) - 1] = True
    out = np.full(len(all_docs), _END)
    out[~is_end] = hashes
    context = np.full(len(out), m.contexts, np.int64)
    context[1:] = m.context_of(out[:-1])
    context[1:][is_end[:-1]] = m.contexts
    return out, context, all_docs


def _frequent_words(docs: DataFrame, most: int) -> np.ndarray:
    """Sorted hashes of the ``most`` most frequent words. All words are counted; a task hands its counts on once it holds many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            words, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return words, np.bincount(at, np.concatenate([h[1] for h in held])).astype(np.int64)

        def made() -> pa.RecordBatch:
            words, n = added()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, offsets = T.buffer_of(batch.column("text"))
                starts, ends, _ = T.words(data, offsets)
                held.append(np.unique(T.word_hashes(data, starts, ends), return_counts=True))
                if sum(len(h[0]) for h in held) > _HELD_WORDS:
                    held[:] = [added()]
                    if len(held[0][0]) > _HELD_WORDS // 2:
                        yield made()
        if held:
            yield made()

    counts = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "word").limit(most).collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def _count(docs: DataFrame, m: Shape) -> DataFrame:
    """(bucket, words, contexts, counts): packed counts of (word, context) of the training texts of a slice, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text", 2 << 20):
                words, context, _ = _stream(batch, m)
                yield from _packed(*_tally(words, context), m.buckets)

    return docs.mapInArrow(run, "bucket int, words binary, contexts binary, counts binary")


def _tally(words: np.ndarray, context: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, context), sorted by word and context, with their counts."""
    order = np.argsort(words, kind="stable")
    words, context = words[order], context[order]
    # Within a word the contexts are few: sort by (rank of the word, context) as one number.
    rank = np.cumsum(np.append(False, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    key = rank * (1 << 16) + context
    again = np.argsort(key, kind="stable")
    key, words, context = key[again], words[again], context[again]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    if counts is None:
        n = np.diff(np.append(first, len(key)))
    else:
        n = np.add.reduceat(counts[order][again], first) if len(key) else np.zeros(0, np.int64)
    return words[first], context[first].astype(np.int32), n.astype(np.int64)


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words >> T.U64(32)) * T.U64(buckets) >> T.U64(32)  # grows with the hash, so buckets are ranges of sorted hashes


def _packed(words: np.ndarray, context: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = _bucket(words, buckets)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(words) else []
    if len(first):
        cuts = [*first.tolist(), len(words)]
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[first].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (words, context.astype(np.uint8), n.astype(np.uint32)))],
            ["bucket", "words", "contexts", "counts"],
        )


def _gather(counts: DataFrame) -> DataFrame:
    """One row for each bucket: its (word, context) counts over all texts, still packed and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for k, b in enumerate(batch.column("bucket").to_pylist()):
                parts = held.setdefault(b, [])
                parts.append(tuple(np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("words", np.uint64), ("contexts", np.uint8), ("counts", np.uint32))))
                if sum(len(p[0]) for p in parts) > 1_000_000 and len(parts) > 1:
                    held[b] = [_added(parts)]
        for b, parts in held.items():
            w, c, n = _added(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([w.tobytes()]), pa.array([c.astype(np.uint8).tobytes()]), pa.array([n.astype(np.int64).tobytes()])], ["bucket", "words", "contexts", "counts"]
            )

    return counts.mapInArrow(run, "bucket int, words binary, contexts binary, counts binary")


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return _tally(*(np.concatenate([p[k] for p in parts]).astype(t) for k, t in enumerate((np.uint64, np.int64, np.int64))))


@lru_cache(maxsize=4)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c and t up to ``_EXACT``."""
    s = np.full((_EXACT + 1, _EXACT + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(1, _EXACT + 1)
    for c in range(_EXACT):
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + s[c, 1:]
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay)
    return s


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: shifted to where the asymptotic series is exact enough."""
    shift = sum(np.log(x + k) for k in range(7))
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_rise(start: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log of (start + 1) (start + 2) ... (start + t - 1)."""
    return log_gamma(start + t) - log_gamma(start + 1)


@lru_cache(maxsize=4)
def _scaling(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """t / c^discount, and what log S(c, t) has there beside its known factors, from the last exact row."""
    t = np.arange(1, _EXACT + 1)
    known = log_gamma(np.array(float(_EXACT))) - discount * math.log(_EXACT) - log_gamma(t.astype(float)) - (t - 1) * math.log(discount)
    return t / _EXACT**discount, stirling(discount)[_EXACT, 1:] - known


def draw_tables(c: np.ndarray, tables: np.ndarray, sent: np.ndarray, total: np.ndarray, m: Shape, uniform: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with ``c`` customers each, given the other tables of the context, and the root's other customers
    of the word and of all words; ``uniform`` makes the draw repeatable."""
    table = stirling(m.discount)
    t = np.ones(len(c), np.int64)
    size = 2
    while size <= _EXACT:  # dishes of about as many customers together; the table has nothing beyond a dish's own
        at = np.flatnonzero((c <= size) & (c > size // 2))
        step = max(1, (1 << 19) // size)  # rows at a time, so that the weights stay small
        k = np.arange(1, size)[None, :]
        for low in range(0, len(at), step):
            part = at[low : low + step]
            opens = (m.strength + m.discount * (tables[part, None] + k)) * (sent[part, None] + k - m.root_discount) / (m.strength + total[part, None] + k)
            weight = table[c[part], 1 : size + 1]
            weight[:, 1:] += np.cumsum(np.log(opens), 1)
            weight = np.exp(weight - weight.max(1)[:, None])
            upto = np.cumsum(weight, 1)
            t[part] = np.minimum(1 + (upto < uniform[part, None] * upto[:, -1:]).sum(1), c[part])
        size *= 2
    large = np.flatnonzero(c > _EXACT)
    x, extra = _scaling(m.discount)
    for low in range(0, len(large), 1 << 10):
        part = large[low : low + (1 << 10)]
        size = c[part, None].astype(float)
        most = np.minimum(size, x[-1] * size**m.discount)
        first = _SINGLE + 0.5
        single = np.broadcast_to(np.arange(_SINGLE + 1) + 0.5, (len(part), _SINGLE + 1))
        edge = np.concatenate([single, first * (np.maximum(most, first + 1) / first) ** np.linspace(0, 1, _CELLS + 1)[None, 1:]], 1)
        middle = (edge[:, 1:] + edge[:, :-1]) / 2
        weight = np.log(edge[:, 1:] - edge[:, :-1]) - log_gamma(middle) - (middle - 1) * math.log(m.discount) + np.interp(middle / size**m.discount, x, extra)
        weight += (middle - 1) * math.log(m.discount) + _log_rise(m.strength / m.discount + tables[part, None], middle)
        weight += _log_rise(sent[part, None] - m.root_discount, middle) - _log_rise(m.strength + total[part, None], middle)
        upto = np.cumsum(np.exp(weight - weight.max(1)[:, None]), 1)
        goal = uniform[part, None] * upto[:, -1:]
        cell = np.minimum((upto < goal).sum(1), _SINGLE + _CELLS - 1)
        row = np.arange(len(part))
        below = np.where(cell > 0, upto[row, cell - 1], 0.0)
        within = (goal[:, 0] - below) / np.maximum(upto[row, cell] - below, 1e-300)
        t[part] = np.clip(np.rint(edge[row, cell] + within * (edge[row, cell + 1] - edge[row, cell])), 1, c[part]).astype(np.int64)
    return t


@dataclass(frozen=True)
class Shape:
    """Parameters of the model that stay fixed."""

    own: np.ndarray  # sorted hashes of the words that are contexts of their own
    classes: int  # contexts that all other words share
    root_discount: float
    discount: float
    strength: float
    buckets: int

    @property
    def contexts(self) -> int:
        return len(self.own) + self.classes

    def context_of(self, words: np.ndarray) -> np.ndarray:
        """The context that each word is to the next one."""
        shared = len(self.own) + (T.mix(words + T.U64(1)) % T.U64(self.classes)).astype(np.int64)
        if not len(self.own):
            return shared
        at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
        return np.where(self.own[at] == words, at, shared)


@dataclass(frozen=True)
class Totals:
    """Sums over all restaurants after a sweep; a number for each context, so their size is fixed."""

    customers: np.ndarray
    tables: np.ndarray
    words: float

    def back_off(self, m: Shape) -> np.ndarray:
        """Each context's probability of a new table, which asks the root for its dish."""
        return (m.strength + m.discount * self.tables) / (m.strength + self.customers)

    def root(self, tables_of_word: np.ndarray, m: Shape) -> np.ndarray:
        """The root's probability of known words, by the customers that the tables of their contexts sent."""
        return (tables_of_word - m.root_discount) / (m.strength + self.tables.sum())

    def root_unknown(self, m: Shape) -> float:
        return (m.strength + m.root_discount * self.words) / (m.strength + self.tables.sum())


def _row(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(batch.column(c)[r].as_buffer(), t).astype(to) for c, t, to in (("words", np.uint64, np.uint64), ("contexts", np.uint8, np.int64), ("counts", np.int64, np.int64)))


def _by_word(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the words, and each row's word."""
    change = np.append(True, words[1:] != words[:-1]) if len(words) else np.zeros(0, bool)
    return np.flatnonzero(change), np.cumsum(change) - 1


def sweep(words: np.ndarray, context: np.ndarray, n: np.ndarray, tables: np.ndarray, before: Totals, number: int, m: Shape) -> np.ndarray:
    """Tables of every (word, context) after one more sweep, given the totals before it.

    What a word gets depends on its own counts and tables and on the totals, so it is the same wherever it is drawn."""
    first, own = _by_word(words)
    tables = tables.copy()
    many = np.flatnonzero(n > 1)  # a lone customer sits at a table of its own
    seed = T.mix(words[many] + T.mix(context[many].astype(np.uint64) + T.U64(1000 * number)))
    uniform = (seed >> T.U64(11)).astype(np.float64) / 2.0**53
    turn = (seed & T.U64(_TURNS - 1)).astype(np.int64)
    around, total = before.tables.astype(float), float(before.tables.sum())
    sent = np.add.reduceat(tables, first) if len(first) else np.zeros(0, np.int64)
    started = sent.copy()
    for now in range(_TURNS):
        chosen = np.flatnonzero(turn == now)
        part = many[chosen]
        # What the turns before have changed for the word is seen at once; a dish's own tables stand up first.
        was, word = tables[part], own[part]
        new = draw_tables(n[part], around[context[part]] - was, sent[word] - was, total + (sent - started)[word] - was, m, uniform[chosen])
        np.add.at(sent, word, new - was)
        tables[part] = new
    return tables


_STATE = "bucket int, words binary, contexts binary, counts binary, tables binary, seated binary, sent binary"


def _seated(counts: DataFrame) -> DataFrame:
    """The state before the first sweep: all customers of a dish at one table, which is what missing tables stand for."""
    return counts.select("bucket", "words", "contexts", "counts", *(F.lit(None).cast("binary").alias(c) for c in ("tables", "seated", "sent")))


def _tables(batch: pa.RecordBatch, r: int, size: int) -> np.ndarray:
    held = batch.column("tables")[r].as_buffer()
    return np.ones(size, np.int64) if held is None else np.frombuffer(held, np.uint32).astype(np.int64)


def _swept(state: DataFrame, before: Totals, number: int, kept: bool, m: Shape) -> DataFrame:
    """The state after one more sweep. If it is ``kept``, what its tables give to each (word, context) is added to ``seated``, and the
    customers that each word has sent to the root are another row of ``sent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words, context, n = _row(batch, r)
                tables = sweep(words, context, n, _tables(batch, r, len(words)), before, number, m)
                held = [batch.column(c)[r].as_buffer() for c in ("seated", "sent")]
                seated = np.zeros(len(words), np.float32) if held[0] is None else np.frombuffer(held[0], np.float32)
                sent = b"" if held[1] is None else held[1].to_pybytes()
                if kept:
                    seated = (seated + (n - m.discount * tables) / (m.strength + before.customers[context])).astype(np.float32)
                    sent += np.add.reduceat(tables, _by_word(words)[0]).astype(np.uint32).tobytes()
                made = [pa.array([x], pa.binary()) for x in (tables.astype(np.uint32).tobytes(), seated.tobytes(), sent)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in ("bucket", "words", "contexts", "counts")), *made], batch.schema.names)

    return materialize(state.mapInArrow(run, _STATE), "seating")


def _totals(state: DataFrame, m: Shape) -> Totals:
    """Sums over a state: at most a row for each bucket and context is shuffled, one for each context sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words, context, n = _row(batch, r)
                tables = _tables(batch, r, len(words))
                by = [np.bincount(context, weights=x, minlength=m.contexts + 1).astype(np.int64) for x in (n, tables)]
                names = [*range(m.contexts + 1), -1]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([*by[0], len(_by_word(words)[0])], pa.int64()), pa.array([*by[1], 0], pa.int64())], ["context", "n", "t"])

    sums = state.select("words", "contexts", "counts", "tables").mapInArrow(run, "context int, n long, t long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    customers, tables, words = np.zeros(m.contexts + 1), np.zeros(m.contexts + 1), 0
    for r in sums:
        if r.context < 0:
            words = r.n
        else:
            customers[r.context], tables[r.context] = r.n, r.t
    return Totals(customers, tables, float(words))


def _model(state: DataFrame, samples: list[Totals], m: Shape) -> DataFrame:
    """One row for each bucket: distinct words with their counts and the root's probability in each kept sample, and for each
    (word, context) the part of the averaged probability that its own tables give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words, context, n = _row(batch, r)
                first, own = _by_word(words)
                sent = np.frombuffer(batch.column("sent")[r].as_buffer(), np.uint32).reshape(len(samples), -1)
                roots = np.stack([s.root(x.astype(np.int64), m).astype(np.float32) for s, x in zip(samples, sent, strict=True)])
                seated = np.frombuffer(batch.column("seated")[r].as_buffer(), np.float32) / np.float32(len(samples))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("bucket").slice(r, 1)]
                    + [pa.array([x.tobytes()], pa.binary()) for x in (words[first], np.add.reduceat(n, first), roots, own.astype(np.int32), context.astype(np.uint8), seated.astype(np.float32))],
                    ["bucket", "words", "counts", "roots", "own", "contexts", "seated"],
                )

    return state.mapInArrow(run, "bucket int, words binary, counts binary, roots binary, own binary, contexts binary, seated binary")


class Lookup:
    """Probabilities of (word, context) from rows of the model, by binary search in sorted words and in sorted (word, context)."""

    def __init__(self, row: dict[str, bytes], history: list[Totals], kept: list[int], m: Shape):
        get = lambda c, t: np.frombuffer(row[c], t)
        self.words, self.counts = get("words", np.uint64), get("counts", np.int64)
        self.roots = get("roots", np.float32).reshape(len(kept), -1)
        self.keys = get("own", np.int32).astype(np.int64) * 256 + get("contexts", np.uint8)
        self.seated = get("seated", np.float32)
        self.back_off = np.stack([history[k].back_off(m) for k in kept])
        self.unknown = np.mean([history[k].back_off(m) * history[k].root_unknown(m) for k in kept], axis=0)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of words, -1 for unknown ones."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def probability(self, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Averaged predictive probabilities; ``at`` as of ``find``."""
        out = self.unknown[context]
        known = np.flatnonzero(at >= 0)
        a, c = at[known], context[known]
        p = np.zeros(len(known))
        for back_off, root in zip(self.back_off, self.roots, strict=True):
            p += back_off[c] * root[a]
        p /= len(self.roots)
        if len(self.keys):
            key = a.astype(np.int64) * 256 + c
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            p += np.where(self.keys[place] == key, self.seated[place], 0)
        out[known] = p
        return out


_PARTIAL = ["n_rows", "n_tokens", "n_known", "base_score", "score"]


def _frequent(model: DataFrame, least: int, history: list[Totals], kept: list[int], m: Shape) -> dict[str, bytes]:
    """Rows of the model for the words seen ``least`` times or more; there are at most all training tokens / ``least`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = Lookup({c: batch.column(c)[r].as_buffer() for c in batch.schema.names if c != "bucket"}, history, kept, m)
                at = np.flatnonzero(x.counts >= least)
                new = np.full(len(x.words), -1)
                new[at] = np.arange(len(at))
                own = new[x.keys >> 8]
                pairs = np.flatnonzero(own >= 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("bucket").slice(r, 1)]
                    + [pa.array([v.tobytes()], pa.binary()) for v in (x.words[at], x.counts[at], np.ascontiguousarray(x.roots[:, at]), own[pairs].astype(np.int32), (x.keys[pairs] & 255).astype(np.uint8), x.seated[pairs])],
                    batch.schema.names,
                )

    rows = model.mapInArrow(run, model.schema).orderBy("bucket").collect()
    sizes = np.cumsum([0, *(len(r.words) // 8 for r in rows)])
    out = {c: b"".join(bytes(r[c]) for r in rows) for c in ("words", "counts", "contexts", "seated")}
    out["roots"] = np.concatenate([np.frombuffer(r.roots, np.float32).reshape(len(kept), -1) for r in rows] or [np.zeros((len(kept), 0), np.float32)], axis=1).tobytes()
    out["own"] = b"".join((np.frombuffer(r.own, np.int32) + np.int32(s)).tobytes() for r, s in zip(rows, sizes, strict=False))
    return out


def _least_frequent(model: DataFrame, least: int, kept: int) -> int:
    """The number of times, ``least`` or its smallest doubling, from which on the words' rows of the model fit a broadcast: sums by
    powers of two, so few rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(64)
        for batch in batches:
            for r in range(batch.num_rows):
                counts, own = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("counts", np.int64), ("own", np.int32)))
                level = np.where(counts >= least, 1 + np.log2(np.maximum(counts / least, 1)).astype(np.int64), 0)
                sizes += np.bincount(level, 16 + 4 * kept + 9 * np.bincount(own, minlength=len(counts)), 64)[:64]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, 64), pa.int32()), pa.array(sizes[1:])], ["level", "size"])

    sums = {r.level: r.size for r in model.select("counts", "own").mapInArrow(run, "level int, size double").groupBy("level").agg(F.sum("size").alias("size")).collect()}
    level = 1
    while sum(v for k, v in sums.items() if k >= level) > _BROADCAST_BYTES:
        level += 1
    return least << (level - 1)


def _partial(ids: pa.Array, doc: np.ndarray, known: np.ndarray, base: np.ndarray, p: np.ndarray, rows: int, tokens: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    sums = [
        pa.array(np.full(n, rows), pa.int64()),
        pa.array(tokens, pa.int64()),
        pa.array(np.bincount(doc, weights=known, minlength=n).astype(np.int64)),
        *(pa.array(np.bincount(doc, weights=x, minlength=n).astype(np.float64)) for x in (base, np.log10(p))),
    ]
    return pa.RecordBatch.from_arrays([ids, *sums], ["doc_id", *_PARTIAL])


def fit_and_score(docs: DataFrame, train, words_of_their_own: int = 192, classes: int = 48, sweeps: int = 6, burn_in: int = 2, root_discount: float = 0.75, discount: float = 0.7, strength: float = 1.0, most_frequent: int = 100_000) -> DataFrame:
    """Score the texts of ``docs`` (columns doc_id, text) under the model of those for which ``train`` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text). Words that make
    up a ``most_frequent``-th of the training tokens or more, of which there can be no more than that many, are scored where
    the texts are, as far as their rows fit a broadcast of bounded size; all others travel to their bucket of the model and back.
    """
    if words_of_their_own + classes > 255:
        raise ValueError("contexts are numbered in a byte: at most 255 besides the start of a text")
    with small_batches(docs.sparkSession):  # jobs take their bound when they run, so the scores are written here
        scores, used = _scored(docs, train, words_of_their_own, classes, sweeps, burn_in, root_discount, discount, strength, most_frequent)
        out = materialize(scores, "scores")
    discard(*used)
    return out


def _scored(docs: DataFrame, train, words_of_their_own: int, classes: int, sweeps: int, burn_in: int, root_discount: float, discount: float, strength: float, most_frequent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The scores, still to be worked out, and the tables that they are worked out from."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    own = _frequent_words(docs.where(train).select("text"), words_of_their_own)
    m = Shape(own, classes, root_discount, discount, strength, max(32, math.ceil(size / 6 / _BUCKET_TOKENS)))
    counts = materialize(_gather(_count(docs.where(train).select("text"), m).repartition(m.buckets, "bucket")), "counts")
    kept = list(range(burn_in + 1, sweeps + 1))
    state = _seated(counts)
    history = [_totals(state, m)]
    for number in range(1, sweeps + 1):
        state = _swept(state, history[-1], number, number in kept, m)
        discard(counts)
        counts = state
        history.append(_totals(state, m))
    model = materialize(_model(state, [history[k] for k in kept], m), "model")
    discard(state)
    n_train, v = int(history[0].customers.sum()), int(history[0].words)
    least = _least_frequent(model, max(1, math.ceil(n_train / most_frequent)), len(kept))
    near = docs.sparkSession.sparkContext.broadcast(_frequent(model, least, history, kept, m))
    floor = math.log10(n_train + 0.1 * (v + 1))
    # Rows with the same id and text are added up and told apart again at the end.
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(near.value, history, kept, m)
        for whole in batches:
            for batch in T.slices(whole, "text", 2 << 20):
                words, context, doc = _stream(batch, m)
                at = look.find(words)
                here = np.flatnonzero(at >= 0)
                a = at[here]
                ids = batch.column("doc_id")
                done = _partial(ids, doc[here], np.ones(len(here)), np.log10(look.counts[a] + 0.1) - floor, look.probability(a, context[here]), 1, np.bincount(doc, minlength=batch.num_rows))
                blank = pa.nulls(batch.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(batch.num_rows, pa.int32()), blank, blank, blank, blank], [*done.schema.names, "bucket", "words", "contexts", "docs", "names"])
                away = np.flatnonzero(at < 0)
                away = away[np.argsort(words[away], kind="stable")]
                w, c, d = words[away], context[away].astype(np.uint8), doc[away]
                bucket = _bucket(w, m.buckets)
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(w) else np.zeros(0, np.int64)
                packs: list[list[bytes]] = [[], [], [], []]
                for s, e in zip(first, np.append(first, len(w))[1:], strict=True):
                    own, number = np.unique(d[s:e], return_inverse=True)
                    names = pa.RecordBatch.from_arrays([ids.take(pa.array(own))], ["doc_id"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, names.schema) as stream:
                        stream.write_batch(names)
                    for pack, x in zip(packs, (w[s:e].tobytes(), c[s:e].tobytes(), number.astype(np.uint32).tobytes(), sink.getvalue().to_pybytes()), strict=True):
                        pack.append(x)
                if len(first):
                    k = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(k, ids.type), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(bucket[first].astype(np.int32)), *(pa.array(x, pa.binary()) for x in packs)],
                        [*done.schema.names, "bucket", "words", "contexts", "docs", "names"],
                    )

    schema = f"doc_id {kind}, n_rows long, n_tokens long, n_known long, base_score double, score double"
    both = materialize(keyed.mapInArrow(local, f"{schema}, bucket int, words binary, contexts binary, docs binary, names binary"), "local_scores")
    travelling = both.where("bucket is not null").select("bucket", F.lit(1).alias("part"), "words", "contexts", "docs", "names", *(F.lit(None).cast("binary").alias(c) for c in ("counts", "roots", "own", "seated")))
    rows = model.select("bucket", F.lit(0).alias("part"), "words", "contexts", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("names"), "counts", "roots", "own", "seated")

    def remote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = {c: b"" for c in ("words", "counts", "roots", "own", "contexts", "seated")}
        look, of = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                bucket = batch.column("bucket")[r].as_py()
                get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                if batch.column("part")[r].as_py() == 0:
                    look, of = Lookup({c: get(c) for c in nothing}, history, kept, m), bucket
                    continue
                if of != bucket:  # no training text has a word of this bucket
                    look, of = Lookup(nothing, history, kept, m), bucket
                words, context, doc = np.frombuffer(get("words"), np.uint64), np.frombuffer(get("contexts"), np.uint8).astype(np.int64), np.frombuffer(get("docs"), np.uint32).astype(np.int64)
                at = look.find(words)
                known = at >= 0
                c = look.counts[at] if len(look.counts) else np.zeros(len(at))
                base = np.log10(np.where(known, c, 0) + 0.1) - floor
                ids = pa.ipc.open_stream(get("names")).read_all().column("doc_id").combine_chunks()
                yield _partial(ids, doc, known, base, look.probability(at, context), 0, np.zeros(len(ids), np.int64))

    moved = travelling.union(rows).repartition(m.buckets, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(remote, schema)
    sums = moved.union(both.where("bucket is null").select(moved.columns)).groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in _PARTIAL))
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    n = F.col("n_rows")
    scores = each.select(
        "doc_id.doc_id", F.expr("n_tokens div n_rows").alias("n_tokens"), F.expr("n_known div n_rows").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base_score") / n).alias("base_score"), (F.col("score") / n).alias("score")
    )
    return scores, [model, both]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole ``documents``; one in ten, by a checksum of its id, is not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    scored = fit_and_score(docs, ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
