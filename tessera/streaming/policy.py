"""The policies over a stream of requests: the same rules, with the state kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(requests: DataFrame, per_second: float) -> DataFrame:
    """(client, id, allowed) for a stream of (client, id, t), t in seconds; batches are taken in order of time."""

    if per_second <= 0:
        return requests.select("client", F.col("id").cast("long").alias("id"), F.lit(True).alias("allowed"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        tokens, filled = state.get if state.exists else (per_second, float(rows["t"].iloc[0]))
        allowed = []
        for t in rows["t"]:
            if not key[0]:  # requests without a client's name are always allowed
                allowed.append(True)
                continue
            tokens = min(per_second, tokens + max(0.0, t - filled) * per_second)
            filled = max(filled, t)
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        state.update((float(tokens), float(filled)))
        yield pd.DataFrame({"client": key[0], "id": rows["id"], "allowed": allowed})

    kind = requests.schema["client"].dataType.simpleString()
    return requests.groupBy("client").applyInPandasWithState(step, f"client {kind}, id long, allowed boolean", "tokens double, filled double", "append", GroupStateTimeout.NoTimeout)


def entries(requests: DataFrame, ttl: str, lateness: str = "1 minute") -> DataFrame:
    """(key, opened, closed, n) of cache entries that reading renews, for a stream of (key, ts): a session ends ``ttl`` after its
    last request, and is given out once the watermark has passed it."""
    window = F.session_window("ts", ttl)
    return requests.withWatermark("ts", lateness).groupBy("key", window).agg(F.count("*").alias("n")).select("key", F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "n")
