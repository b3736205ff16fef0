"""Substring deduplication: lines, paragraphs and passages that stand earlier in the corpus are removed.

Units are lines and paragraphs (lines between blank ones) of ``min_words`` words or more, normalised: case of A-Z and white space
don't count, so a unit is the same however it is broken or indented. Digests are grouped globally, the occurrence that ranks
first (lowest rank, then earliest place) stays, and all others go, with their places in the original text. ``line_words`` lets
shorter lines count, too; they are left out where headings, licences and menus that many clean texts share should stay.

Line ends are no limits of what is copied, so passages within lines and across them are found as well: over all texts, the first
occurrence of a window of ``min_words`` words stays and later ones are repeats. The words of repeats that overlap or touch are
one span. So a span ends exactly where the texts differ, and every word in it stands in an earlier occurrence of its unit or
window; nothing that stands once is removed, and of all that is removed the first occurrence stays.

Few windows move by themselves. Of the shorter windows in a window of ``min_words`` words the one with the smallest hash stands
for it, wherever the passage stands (winnowing), and the windows that follow each other with the same such mark are a piece.
Equal windows have equal marks, so what a mark's pieces hold is all that there is of their windows. A piece that stands earlier
as a whole is a repeat. Windows are compared one by one where a mark has different pieces, as at the ends of passages, and
only in those pieces that aren't repeats as a whole: the first occurrence of any window is in one of them.

Defined cases: null, empty and blank texts have no words; texts of any length are read whole; rows without a rank column value
cannot be named and are left out; several texts of one rank are told apart, in the order of their hashes, while repeated rows
(equal rank and text) are one text and stay or go alike; a unit or passage that comes twice in one text is removed there the
second time, where the two don't overlap; empty tables give an empty result; other columns are not looked at, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.storage import materialize

_SECOND = T.U64(0xD6E8FEB86659FD93)
_STEP = 1 << 16  # windows compared at a time


def _pieces(docs: DataFrame, kind: str, min_words: int) -> DataFrame:
    """(doc_id, word, n_windows, start, end, mark, digest): the pieces of every text, with the places of all of their words.

    Pieces are compared within a mark, so the two hashes are 128 bits."""
    short = max(1, 2 * min_words // 5)
    within = min_words - short + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, offsets = T.buffer_of(batch.column("text"))
                starts, ends, doc = T.words(data, offsets)
                if len(starts) < min_words:
                    continue
                hashes = T.word_hashes(data, starts, ends)
                full, held = T.window_hashes(hashes, doc, list(range(min_words)))
                if not len(held):
                    continue
                found, at = T.window_hashes(hashes, doc, list(range(short)))
                every = np.zeros(len(starts), np.uint64)
                every[at] = found
                view = np.lib.stride_tricks.sliding_window_view(every, within)
                marks = np.concatenate([(part := held[k : k + _STEP]) + view[part].argmin(1) for k in range(0, len(held), _STEP)])
                first = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
                last = np.append(first[1:], len(held)) - 1
                n = last - first + 1
                # The first and the last window overlap, so they hold all words of the piece.
                digest = T.mix(T.mix(full[first] + n.astype(np.uint64)) ^ full[last])
                points = T.code_points(data)
                own = doc[held[first]]
                base = points[offsets[own]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(own)),
                        pa.array((held[first] - np.searchsorted(doc, own)).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array((points[starts[held[first]]] - base).astype(np.int32)),
                        pa.array((points[ends[held[last] + min_words - 1]] - base).astype(np.int32)),
                        *(pa.array(x.view(np.int64)) for x in (every[marks[first]], digest)),
                    ],
                    ["doc_id", "word", "n_windows", "start", "end", "mark", "digest"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, word int, n_windows int, start int, end int, mark long, digest long")


def _units(docs: DataFrame, kind: str, line_words: int, paragraph_words: int) -> DataFrame:
    """(doc_id, word, n_words, start, end, d1, d2): the lines and paragraphs of every text that are long enough."""
    names = ["doc_id", "word", "n_words", "start", "end", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, offsets = T.buffer_of(batch.column("text"))
                starts, ends, doc = T.words(data, offsets)
                if not len(starts):
                    continue
                line = np.searchsorted(np.flatnonzero(data == 10), starts)  # line ends before each word
                other = doc[1:] != doc[:-1]
                lines = np.flatnonzero(np.append(True, other | (line[1:] > line[:-1])))
                blocks = np.flatnonzero(np.append(True, other | (line[1:] > line[:-1] + 1)))
                sizes, deep = np.diff(np.append(lines, len(starts))), np.diff(np.append(blocks, len(starts)))
                several = np.diff(np.searchsorted(lines, np.append(blocks, len(starts)))) > 1  # one line alone is a line
                first = np.concatenate([lines[sizes >= line_words], blocks[several & (deep >= paragraph_words)]])
                n = np.concatenate([sizes[sizes >= line_words], deep[several & (deep >= paragraph_words)]])
                if not len(first):
                    continue
                hashes = T.word_hashes(data, starts, ends)
                points = T.code_points(data)
                own = doc[first]
                base = points[offsets[own]]
                digests = T.sequence_hashes(hashes, first, n), T.sequence_hashes(T.mix(hashes ^ _SECOND), first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(own)),
                        pa.array((first - np.searchsorted(doc, own)).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array((points[starts[first]] - base).astype(np.int32)),
                        pa.array((points[ends[first + n - 1]] - base).astype(np.int32)),
                        *(pa.array(d.view(np.int64)) for d in digests),
                    ],
                    names,
                )

    return docs.mapInArrow(run, f"doc_id {kind}, word int, n_words int, start int, end int, d1 long, d2 long")


def _windows(texts: DataFrame, pieces: DataFrame, kind: str, min_words: int) -> DataFrame:
    """(doc_id, word, start, end, d1, d2): the windows of ``pieces``."""
    asked = pieces.groupBy("doc_id").agg(F.collect_set(F.struct("word", "n_windows")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, offsets = T.buffer_of(batch.column("text"))
                starts, ends, doc = T.words(data, offsets)
                if len(starts) < min_words:
                    continue
                hashes = T.word_hashes(data, starts, ends)
                low = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                lists = batch.column("asked")
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                word, n = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, np.minimum(low[row] + word, low[row + 1]), 1)
                np.add.at(change, np.minimum(low[row] + word + n, low[row + 1]), -1)
                keep = list(range(min_words))
                d1, first = T.window_hashes(hashes, doc, keep)
                d2, _ = T.window_hashes(T.mix(hashes ^ _SECOND), doc, keep)
                wanted = np.cumsum(change)[first] > 0
                d1, d2, first = d1[wanted], d2[wanted], first[wanted]
                points = T.code_points(data)
                own = doc[first]
                base = points[offsets[own]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(own)),
                        pa.array((first - low[own]).astype(np.int32)),
                        pa.array((points[starts[first]] - base).astype(np.int32)),
                        pa.array((points[ends[first + min_words - 1]] - base).astype(np.int32)),
                        *(pa.array(d.view(np.int64)) for d in (d1, d2)),
                    ],
                    ["doc_id", "word", "start", "end", "d1", "d2"],
                )

    return texts.hint("merge").join(asked, "doc_id").mapInArrow(run, f"doc_id {kind}, word int, start int, end int, d1 long, d2 long")


def repeated_units(texts: DataFrame, kind: str, line_words: int, paragraph_words: int) -> DataFrame:
    """(doc_id, word, to, start, end, kept): lines and paragraphs that stand earlier. Digests are counted in each task before they move."""
    units = materialize(_units(texts, kind, line_words, paragraph_words), "units")
    kept = F.min(F.struct("doc_id", "word", "start")).alias("kept")
    first = materialize(units.groupBy("d1", "d2").agg(kept, F.count("*").alias("n")).where("n > 1").drop("n"), "kept_units")
    later = units.join(first.hint("merge"), ["d1", "d2"]).where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("word") != F.col("kept.word")))
    return later.select("doc_id", "word", (F.col("word") + F.col("n_words")).alias("to"), "start", "end", "kept")


def _named(docs: DataFrame, rank: str, text_column: str) -> DataFrame:
    """Texts by rank and hash, since a rank can have several."""
    return docs.where(F.col(rank).isNotNull()).select(F.struct(F.col(rank).alias("id"), F.xxhash64(text_column).alias("h")).alias("doc_id"), F.col(text_column).alias("text"))


def find_repeats(docs: DataFrame, min_words: int = 20, rank: str = "doc_id", text_column: str = "text", line_words: int | None = None) -> DataFrame:
    """Spans to remove: doc_id (the rank column), text_hash, start, end (code points, end exclusive), n_words, and where an
    earlier occurrence of the first words' unit or window stands: kept_doc_id, kept_start. Spans of one text don't overlap."""
    texts = _named(docs, rank, text_column)
    kind = texts.schema["doc_id"].dataType.simpleString()
    units = materialize(repeated_units(texts, kind, line_words or min_words, min_words), "repeated_units")
    # Only marks met twice go on. Marks and digests are counted in each task before they move, so a hot one costs a row a task.
    marks = _pieces(texts, kind, min_words).groupBy("mark").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    marks = materialize(marks.where("n > 1").select("mark", (F.col("low") < F.col("high")).alias("varied")), "marks")
    pieces = materialize(_pieces(texts, kind, min_words).join(marks.hint("merge"), "mark"), "pieces")
    kept = F.min(F.struct("doc_id", "word", "start")).alias("kept")
    first = materialize(pieces.groupBy("mark", "digest").agg(kept, F.count("*").alias("n")).where("n > 1").drop("n"), "kept_pieces")
    apart = (F.col("doc_id") != F.col("kept.doc_id")) | (F.col("word") - F.col("kept.word") >= min_words)
    told = pieces.join(first.hint("merge"), ["mark", "digest"], "left").withColumn("repeated", F.coalesce(apart, F.lit(False)))
    told = materialize(told.where("repeated or varied").select("doc_id", "word", "n_windows", "start", "end", "kept", "repeated"), "told")
    windows = materialize(_windows(texts, told.where("not repeated"), kind, min_words), "windows")
    single = materialize(windows.groupBy("d1", "d2").agg(kept, F.count("*").alias("n")).where("n > 1").drop("n"), "kept_windows")
    single = windows.join(single.hint("merge"), ["d1", "d2"]).where(apart)
    whole = told.where("repeated").select("doc_id", "word", (F.col("word") + F.col("n_windows") - 1 + min_words).alias("to"), "start", "end", "kept")
    repeats = units.union(whole).union(single.select("doc_id", "word", (F.col("word") + min_words).alias("to"), "start", "end", "kept"))
    by_place = Window.partitionBy("doc_id").orderBy("word")
    reached = F.max("to").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    spans = repeats.withColumn("opens", F.coalesce(F.col("word") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "run")
    spans = spans.agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to") - F.min("word")).cast("long").alias("n_words"), F.min(F.struct("word", "kept"))["kept"].alias("k"))
    return spans.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.h").alias("text_hash"), "start", "end", "n_words", F.col("k.doc_id.id").alias("kept_doc_id"), F.col("k.start").alias("kept_start"))


def remove_spans(docs: DataFrame, spans: DataFrame, rank: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of ``text_column``, in place; texts without spans stay as they are."""
    named = F.struct("doc_id", "text_hash").alias("doc")
    cuts = spans.groupBy(named).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    # The input's columns travel in one of their own, so none of them can have the name of a helper.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_column).alias("text"), F.struct(F.col(rank).alias("doc_id"), F.xxhash64(text_column).alias("text_hash")).alias("doc"))
    n = F.size("cuts")
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            "text",
            F.when(i == 0, F.lit(1)).otherwise(F.get("cuts", i - 1)["end"] + 1),
            F.when(i == n, F.length("text")).otherwise(F.get("cuts", i)["start"]) - F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1)["end"]),
        ),
    )
    joined = rows.join(cuts, "doc", "left")
    cleaned = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    return joined.select(*(cleaned.alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines, paragraphs and passages of all whole ``documents``. Lines of under 20 words, which many clean texts share, stay."""
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "start", "end", "n_words")


#: The rows of the query: words with their places, windows of 20 words, later occurrences, and spans of windows that touch.
ORACLE_SQL = r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split_regex(text, '[^\x20\x09-\x0D]+') AS g FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT doc_id, unnest(w) AS w, unnest(g[1:len(w)]) AS g, generate_subscripts(w, 1) AS k FROM p),
t AS (SELECT doc_id, k, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, length(w) AS n, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM q),
v AS (SELECT doc_id, k, e - n AS s, max(e) OVER f AS e, string_agg(w, ' ') OVER f AS x, count(*) OVER f AS c FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
o AS (SELECT doc_id, k, s, e, first_value(doc_id) OVER h AS d0, first_value(k) OVER h AS k0 FROM v WHERE c = 20 WINDOW h AS (PARTITION BY x ORDER BY doc_id, k)),
r AS (SELECT * FROM o WHERE doc_id <> d0 OR k - k0 >= 20),
i AS (SELECT *, CASE WHEN k > max(k + 20) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM r),
j AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM i)
SELECT doc_id, CAST(min(s) AS INT) AS "start", CAST(max(e) AS INT) AS "end", CAST(max(k) + 20 - min(k) AS BIGINT) AS n_words FROM j GROUP BY doc_id, run
"""
