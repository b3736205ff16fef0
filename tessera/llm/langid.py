"""Language identification of words, spans and whole texts.

Languages are learned from labelled texts as counts of letter trigrams (a word is bounded by blanks) and of the scripts of
their letters. To label a text, each word's script narrows its candidate languages, trigram likelihoods score the word under
each of them, and a Viterbi pass with a penalty for switching labels every word, so that mixed texts fall into spans.

Trigrams are hashed into tables of fixed size, 2^16 cells each; with more than 128 languages each gets fewer cells, so that all
tables together stay as large.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and no spans (marks belong to a word, but a word
of marks alone is none); texts of any length are labelled whole; if nothing was learned every text is
``und``; rows without text or label are not learned from; ties go to the language that comes first by name; repeated rows give
repeated results; empty tables give empty results; input columns stay, those whose names the operator adds are replaced.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import slices

_BITS, _LEAST_BITS = 16, 8  # trigrams are hashed into so many bits, so a language is a table of fixed size
_CELLS = 1 << 23  # of all languages' tables together
_BLOCK = 1 << 18  # letters scored at a time

# First and last code points of scripts, by the Unicode blocks that hold them.
_SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
SCRIPTS = ["other", *_SCRIPTS]
_MARK = len(SCRIPTS)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its small letter (0 if it's neither letter nor mark), and its script (one of its own for marks)."""
    lower = np.zeros(sys.maxunicode + 1, np.uint32)
    marks = []
    for c in [*range(0x40000), *range(0xE0000, 0xE0200)]:
        if (kind := unicodedata.category(ch := chr(c))[0]) in "LM":
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
            if kind == "M":
                marks.append(c)
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for k, ranges in enumerate(_SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    script[marks] = _MARK
    return lower, script


def _words(texts: list[str], bits: int) -> tuple[np.ndarray, ...]:
    """Small letters of all texts with blanks between them, trigram hashes and scripts; starts, ends and texts of the words."""
    lower, script = _tables()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = lower[points]
    inside = letters != 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Words without a letter go; the others begin at their first letter.
    at = np.flatnonzero(inside & (script[points] != _MARK))
    place = np.searchsorted(at, starts)
    held = place < np.searchsorted(at, ends)
    inside = np.zeros(len(points) + 1, np.int8)
    starts, ends = at[place[held]], ends[held]
    inside[starts], inside[ends] = 1, -1
    inside = np.cumsum(inside, dtype=np.int8)[:-1] > 0
    letters = np.where(inside, letters, np.uint32(0))
    before, after = np.append(np.uint32(0), letters[:-1]), np.append(letters[1:], np.uint32(0))
    mixed = letters * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    hashes = mixed >> np.uint32(32 - bits)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return points, inside, hashes, script, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, offsets


@dataclass(frozen=True)
class Model:
    langs: list[str]
    scores: np.ndarray  # trigram x language: log probabilities, float32
    scripts: np.ndarray  # script x language: whether the language is written in it
    bits: int  # of a trigram's hash


def learn(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", least_share: float = 0.005) -> Model:
    """Count trigrams and scripts of all labelled texts. At most ``_CELLS`` counts reach the driver, however many languages there are."""
    rows = labelled.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("text is not null and lang is not null")
    most = _CELLS >> _LEAST_BITS
    langs = sorted(r.lang for r in rows.select("lang").distinct().limit(most + 1).collect())
    if len(langs) > most:
        raise ValueError(f"the label column has more than {most} values: these aren't languages")
    bits = _BITS
    while len(langs) << bits > _CELLS:
        bits -= 1
    numbers = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for lang, (grams, scripts) in held.items():
                both = np.concatenate([grams, scripts])
                at = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at, pa.int32()), pa.array(both[at], pa.int64())], ["lang", "at", "n"])
            held.clear()

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                points, inside, hashes, script, *_, offsets = _words(texts, bits)
                own = np.repeat(np.array([numbers[x] for x in batch.column("lang").to_pylist()]), np.diff(offsets))
                for lang in np.unique(own).tolist():
                    at = np.flatnonzero(inside & (own == lang))
                    if lang not in held:
                        held[lang] = np.zeros(1 << bits, np.int64), np.zeros(len(SCRIPTS), np.int64)
                    held[lang][0][:] += np.bincount(hashes[at], minlength=1 << bits)
                    held[lang][1][:] += np.bincount(script[points[at]], minlength=len(SCRIPTS) + 1)[:-1]
                if len(held) > 64:
                    yield from drain()
        yield from drain()

    found = rows.mapInArrow(count, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(((1 << bits) + len(SCRIPTS), len(langs)))
    table[found["at"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    used = table[: 1 << bits].sum(0) > 0  # a language without a letter can't be told
    table, langs = table[:, used], [x for x, u in zip(langs, used, strict=True) if u]
    grams, scripts = table[: 1 << bits], table[1 << bits :]
    scores = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * len(grams)))
    return Model(langs, scores.astype(np.float32), scripts >= least_share * scripts.sum(0), bits)


def viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word of many texts at once: all texts advance word by word together, the longest first.

    ``scores`` has a row for each word; text k's rows begin at ``first[k]``. On ties a text stays with its label, and else
    takes the lowest.
    """
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    best = np.zeros((len(first), scores.shape[1]), np.float32)
    came = np.zeros(scores.shape, bool)  # from another language
    source = np.zeros(len(scores), np.int16)
    for t, n in enumerate(active):
        at, now = first[:n] + t, best[:n]
        if t:
            top = now.max(1)
            source[at] = now.argmax(1)
            switch = (top - penalty)[:, None]
            came[at] = switch > now
            np.maximum(now, switch, out=now)
            now -= top[:, None]  # keeps the sums of long texts near zero
        now += scores[at]
    state = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        own = state[:n]
        labels[at] = own
        if t:
            state[:n] = np.where(came[at, own], source[at], own)
    return labels


def label_words(texts: list[str], model: Model, penalty: float) -> tuple[np.ndarray, ...]:
    """Starts, ends (code points in their text), texts and labels of all words."""
    points, inside, hashes, script, starts, ends, doc, offsets = _words(texts, model.bits)
    scores = np.empty((len(starts), len(model.langs)), np.float32)
    k = 0
    step = max(1, _BLOCK * 4 // max(4, len(model.langs)))
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + step)))
        low, high = starts[k], ends[to - 1]
        part = model.scores[hashes[low:high]]
        part[~inside[low:high]] = 0
        scores[k:to] = np.add.reduceat(part, starts[k:to] - low, axis=0)
        k = to
    if len(starts):
        allowed = model.scripts[script[points[starts]]]
        allowed |= ~allowed.any(1)[:, None]  # a script that no language is written in tells nothing
        scores[~allowed] = -1e4
        scores -= scores.max(1)[:, None]
        np.maximum(scores, np.where(allowed, np.float32(-15), np.float32(-1e3)), out=scores)
    count = np.bincount(doc, minlength=len(texts))
    has = np.flatnonzero(count)
    labels = viterbi(scores, (np.cumsum(count) - count)[has], count[has], penalty) if len(starts) else np.zeros(0, np.int16)
    return starts - offsets[doc], ends - offsets[doc], doc, labels


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, spans: bool = False, text_column: str = "text") -> DataFrame:
    """Add ``lang_pred`` (the language of most letters), ``score`` (its share of the letters) and, if asked, ``lang_spans``:
    an array of (start, end, lang) in code points, end exclusive."""
    added = {"lang_pred": "string", "score": "double"} | ({"lang_spans": "array<struct<start:int,end:int,lang:string>>"} if spans else {})
    kept = [f for f in docs.schema if f.name not in added]
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own.value
        names = pa.array([*m.langs, "und"], pa.string())
        for whole in batches:
            for batch in slices(whole, text_column, 1 << 20):
                texts = [t or "" for t in batch.column(text_column).to_pylist()]
                pred, score, lists = np.full(len(texts), len(m.langs)), np.zeros(len(texts)), [[] for _ in texts]
                if m.langs:
                    starts, ends, doc, labels = label_words(texts, m, penalty)
                    letters = np.bincount(doc * len(m.langs) + labels, weights=ends - starts, minlength=len(texts) * len(m.langs)).reshape(len(texts), -1)
                    total = letters.sum(1)
                    has = total > 0
                    pred[has] = letters[has].argmax(1)
                    score[has] = letters[has].max(1) / total[has]
                    if spans and len(doc):
                        cut = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(labels) != 0)))
                        last = np.append(cut[1:], len(doc)) - 1
                        for d, s, e, x in zip(doc[cut], starts[cut], ends[last], labels[cut], strict=True):
                            lists[d].append({"start": int(s), "end": int(e), "lang": m.langs[x]})
                columns = [batch.column(f.name) for f in kept] + [names.take(pa.array(pred)), pa.array(score)]
                if spans:
                    columns.append(pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *added])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{k} {v}" for k, v in added.items()])
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all whole ``documents``, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learn(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
