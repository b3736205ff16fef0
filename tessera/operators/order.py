"""Places and running sums in one order of a whole table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import materialize


def numbered(rows: DataFrame, order: list[Column], sums: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``position`` (1, 2, ...) in that order, ``range`` (0, 1, ...) of the range of neighbours that was sorted
    together, and for each item of ``sums`` (new column: long column) the sum up to and with the row.

    Ranges are sorted each in a task; only their sizes and sums, a row each, reach the driver. ``rows`` is read twice, so it should be a
    stored table. Rows that tie in ``order`` are numbered in any order, once: the result is a stored table."""
    spark, sums = rows.sparkSession, sums or {}
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order)
    fields = dealt.schema.simpleString().removeprefix("struct<").removesuffix(">")
    extra = "".join(f", {c} long" for c in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, dict.fromkeys(sums, 0)
        for batch in batches:
            columns = [pa.array(np.arange(n + 1, n + 1 + batch.num_rows))]
            n += batch.num_rows
            for name, source in sums.items():
                running = np.cumsum(batch.column(source).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + totals[name]
                totals[name] = int(running[-1]) if len(running) else totals[name]
                columns.append(pa.array(running, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "position", *sums])

    placed = materialize(dealt.mapInArrow(run, f"{fields}, position long{extra}").withColumn("range", F.spark_partition_id()), "ranges")
    ends = placed.groupBy("range").agg(F.max("position"), *(F.max_by(c, "position") for c in sums)).collect()  # a row for each range
    before, offsets = [0] * (1 + len(sums)), []
    for k, row in enumerate(sorted(ends)):
        offsets.append((row[0], k, *before))
        before = [a + b for a, b in zip(before, row[1:], strict=True)]
    names = ["position", *sums]
    offsets = spark.createDataFrame(offsets, "range int, _k int" + "".join(f", _{c} long" for c in names))
    found = placed.join(F.broadcast(offsets), "range")
    kept = [F.col(c) for c in rows.columns]
    return found.select(*kept, *((F.col(c) + F.col(f"_{c}")).alias(c) for c in names), F.col("_k").alias("range"))
