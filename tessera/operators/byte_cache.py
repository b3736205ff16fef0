"""A cache bounded by the bytes it holds, least recently used first out, with a time to live that every hit renews.

Whether a request finds its key is told without running the cache: the entry is still there if the bytes of all the different keys
asked for since the key's last request, and its own, fit the bound, and if that request is no longer ago than the time to
live. What is asked for is thus a sum over a window of the log of those requests m of (p, i) whose own last request came before p:
a sum of dominated points. It is put together from three parts, none of which needs the log in one task:

1. requests of the same time range as i: in a task for each range;
2. requests of earlier ranges whose last request lies in p's range: in a task for each range of last requests;
3. all others by pairs of ranges: sums of at most ``most_ranges`` squared cells.

A key's requests are linked within ranges first, so a key with a third of all requests is spread over as many tasks as there
are ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import numbered
from tessera.sources.storage import materialize


def dominated(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each place the sum of the weights of earlier places with a smaller value: neighbouring blocks are merged, twice as long
    each time, and what the left half holds below a value of the right half is a cumulated sum."""
    n = len(value)
    out = np.zeros(n, np.int64)
    place = np.arange(n)
    order = np.argsort(value, kind="stable")  # by value, then place
    size = 1
    while size < n:
        # Stable sort by block keeps the order by value within each.
        own = order[np.argsort(place[order] // (2 * size), kind="stable")]
        left = (own // size) % 2 == 0
        total = np.cumsum(np.where(left, weight[own], 0))
        block, v = own // (2 * size), value[own]
        # Equal values don't count: a run of equal values of a block takes what stood before the run.
        begins = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (v[1:] != v[:-1])))
        run = np.repeat(begins, np.diff(np.append(begins, n)))
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        first = np.repeat(first, np.diff(np.append(first, n)))
        before = np.append(0, total)
        out[own] += np.where(left, 0, before[run] - before[first])
        size *= 2
    return out


def _grouped(rows: DataFrame, group: str, order: str, value: str, output: str) -> DataFrame:
    """``rows`` with the dominated sums of ``size`` within each group, places being in the order of ``order``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(**{output: dominated(pdf[value].to_numpy(np.int64), pdf["size"].to_numpy(np.int64))})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(group).applyInPandas(run, f"{schema}, {output} long")


def _distances(log: DataFrame, most_ranges: int, rows_per_range: int) -> DataFrame:
    """(id, key, t, size, position, before_t, distance): of requests that repeat a key, the time of the one before, and the bytes of
    the different keys in between."""
    log = materialize(log.select("id", "key", F.col("t").cast("double").alias("t"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")), "log")
    ranges = max(1, min(most_ranges, math.ceil(log.count() / rows_per_range)))
    rows = numbered(log, [F.col("t"), F.col("id")], {"held": "size"}, ranges)
    # The request before, within the range; the first of a key in a range finds it in the last of an earlier one.
    here = F.struct("position", "range", "held", "t")
    local = Window.partitionBy("range", "key").orderBy("position")
    rows = materialize(rows.withColumn("last", F.lag(here).over(local)), "linked")
    ends = rows.groupBy("range", "key").agg(F.min("position").alias("position"), F.max(here).alias("end"))
    earlier = F.lag("end").over(Window.partitionBy("key").orderBy("range"))
    links = ends.select("position", earlier.alias("link")).where("link is not null")
    rows = rows.join(links, "position", "left").withColumn("last", F.coalesce("last", "link"))
    rows = rows.select("id", "key", "t", "size", "position", "range", F.coalesce("last.position", F.lit(0)).alias("prev"), F.coalesce("last.range", F.lit(-1)).alias("prev_range"), F.col("last.held").alias("prev_held"), F.col("last.t").alias("before_t"))
    rows = materialize(_grouped(rows, "range", "position", "prev", "same"), "same_range")
    again = _grouped(rows.where("prev > 0").select("position", "prev", "prev_range", "range", "size"), "prev_range", "prev", "range", "near").select("position", "near")
    # Cells of pairs of ranges: sums over earlier ranges of rows, then of last requests.
    cells = rows.groupBy("range", "prev_range").agg(F.sum("size").alias("size"))
    grid = log.sparkSession.range(ranges).select(F.col("id").cast("int").alias("range")).select("range", F.explode(F.sequence(F.lit(-1), F.lit(ranges - 1))).alias("prev_range"))
    grid = grid.join(cells, ["range", "prev_range"], "left").fillna(0, ["size"])
    before = Window.unboundedPreceding
    grid = grid.withColumn("across", F.sum("size").over(Window.partitionBy("range").orderBy("prev_range").rowsBetween(before, -1)))
    far = F.sum("across").over(Window.partitionBy("prev_range").orderBy("range").rowsBetween(before, -1))
    grid = grid.select("range", "prev_range", F.coalesce(far, F.lit(0)).alias("far"))
    rows = rows.join(again, "position", "left").join(grid, ["range", "prev_range"], "left")
    distance = F.col("far") + F.col("same") + F.col("near") - F.col("prev_held")
    return rows.select("id", "key", "t", "size", "position", "before_t", F.when(F.col("prev") > 0, distance).alias("distance"))


def byte_lru(log: DataFrame, most_bytes: int, ttl: float, most_ranges: int = 4096, rows_per_range: int = 1 << 18) -> DataFrame:
    """(id, key, hit, outcome, distance) of every request of ``log`` (id, key, t, size), in the order of t, then id. ``distance`` is the bytes
    of other keys since the key's last request. Outcomes: hit, first (the key was never asked for), evicted (it had to make
    room), expired (it was there, but too old), oversize (larger than the whole store, so never kept). A request that doesn't
    hit stores the entry; ``size`` belongs to the key. A null size is 0, and null is a key of its own."""
    kept = log.withColumn("size", F.when(F.col("size") <= most_bytes, F.col("size")).otherwise(0))
    over = F.col("size") > most_bytes
    marks = log.select("id", F.coalesce(over, F.lit(False)).alias("over"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("own"))
    found = _distances(kept, most_ranges, rows_per_range).join(marks, "id")
    outcome = (
        F.when(F.col("over"), "oversize")
        .when(F.col("distance").isNull(), "first")
        .when(F.col("distance") + F.col("own") > most_bytes, "evicted")
        .when(F.col("t") - F.col("before_t") >= ttl, "expired")
        .otherwise("hit")
    )
    return found.select("id", "key", (outcome == "hit").alias("hit"), outcome.alias("outcome"), "distance", "position", F.col("own").alias("size"))


def lru_totals(found: DataFrame, most_bytes: int) -> DataFrame:
    """One row: requests, hits, misses, and evictions, which are the entries that had to make room, asked for again or not."""
    found = materialize(found, "outcomes")
    is_ = lambda name: F.sum((F.col("outcome") == name).cast("long"))
    counts = found.agg(F.count("*").alias("requests"), F.coalesce(is_("hit"), F.lit(0)).alias("hits"), F.coalesce(is_("evicted"), F.lit(0)).alias("again"))
    # Of the keys' last requests those are gone after which others filled the store.
    last = materialize(found.where("outcome <> 'oversize'").groupBy("key").agg(F.max("position").alias("last"), F.max("size").alias("size")), "last_requests")
    gone = numbered(last, [F.col("last").desc()], {"held": "size"}).agg(F.sum((F.col("held") > most_bytes).cast("long")).alias("gone"))
    return counts.crossJoin(F.broadcast(gone)).select("requests", "hits", (F.col("requests") - F.col("hits")).alias("misses"), (F.col("again") + F.coalesce("gone", F.lit(0))).alias("evictions"))
