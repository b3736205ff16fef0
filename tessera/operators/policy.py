"""Serving policies over a log of requests (client, key, ts): each client or key is one group, ordered by time.

Cache hits and single flights are windows. Quotas and rate limits carry state from request to request; a client's requests
stream through a task in order with a state of two numbers, so a busy client is never held in memory whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def single_flight(log: DataFrame) -> DataFrame:
    """(key, first_id, waiters): one producer for each key, which the others wait for."""
    return log.groupBy("key").agg(F.min("id").alias("first_id"), (F.count("*") - 1).alias("waiters"))


def cache_hits(log: DataFrame, ttl: float) -> DataFrame:
    """``log`` with ``hit``: whether the key was asked for less than ``ttl`` seconds before; reading renews an entry."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("key").orderBy("t", "id"))
    return log.withColumn("hit", F.coalesce(gap < ttl, F.lit(False)))


def sessions(log: DataFrame, ttl: float) -> DataFrame:
    """(key, session, first, last, n): how long an entry lived each time."""
    by = Window.partitionBy("key").orderBy("t", "id")
    opens = F.coalesce(F.col("t") - F.lag("t").over(by) >= ttl, F.lit(True)).cast("int")
    numbered = log.withColumn("session", F.sum(opens).over(by))
    return numbered.groupBy("key", "session").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


def _in_order(log: DataFrame, step, output: str) -> DataFrame:
    """Run ``step(state, t) -> (state, verdict)`` over each client's requests in order of time."""
    rows = log.select("client", "id", "t").repartition("client").sortWithinPartitions("client", "t", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, state = None, None
        for batch in batches:
            verdicts = []
            for c, t in zip(batch["client"], batch["t"], strict=True):
                if c != client:
                    client, state = c, None
                state, verdict = step(state, t)
                verdicts.append(verdict)
            yield batch[["id"]].assign(**{output: verdicts})

    return rows.mapInPandas(run, f"id long, {output} boolean")


def quota(log: DataFrame, per_window: int, window: float) -> DataFrame:
    """(id, stored): at most ``per_window`` entries in a client's window, which opens with its first request after the last."""

    def step(state, t):
        created, resets = state or (0, float("-inf"))
        if t >= resets:
            created, resets = 0, t + window
        ok = created < per_window
        return (created + ok, resets), ok

    return _in_order(log, step, "stored")


def rate_limit(log: DataFrame, per_second: float) -> DataFrame:
    """(id, allowed): a bucket of one second's requests that fills at the same rate. Requests without a client's name, and all of
    them at a rate of 0, are allowed."""
    unnamed = F.coalesce(F.col("client").cast("string"), F.lit("")) == ""
    free = log.where(unnamed | F.lit(per_second <= 0)).select(F.col("id").cast("long"), F.lit(True).alias("allowed"))

    def step(state, t):
        tokens, filled = state or (per_second, t)
        tokens = min(per_second, tokens + (t - filled) * per_second)
        ok = tokens >= 1
        return (tokens - ok, t), ok

    return _in_order(log.where(~unnamed & F.lit(per_second > 0)), step, "allowed").union(free)
