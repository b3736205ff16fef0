"""Layouts of many pictures on one canvas, and what an encoder needs to know of a picture's colours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.composite import GRAVITIES, place


def grid(sizes: DataFrame, columns: int | None, group: str = "group_id", quantum: int = 1, gap: int = 0, rows: int | None = None) -> DataFrame:
    """``sizes`` (group, seq, w, h) with the rectangle of each picture in its group's grid: px, py, cell_w, cell_h. Without
    ``columns`` there are as many as the ``rows`` need; with both, groups that don't fit fail."""
    whole = Window.partitionBy(group)
    n = F.count("*").over(whole)
    wide = F.lit(columns) if columns else F.ceil(n / rows).cast("int")
    up = lambda c: (F.ceil(F.max(c).over(whole) / quantum) * quantum).cast("int")
    cells = sizes.withColumn("cell_w", up("w")).withColumn("cell_h", up("h")).withColumn("at", F.row_number().over(whole.orderBy("seq")) - 1).withColumn("wide", wide)
    if columns and rows:
        fits = F.when(n <= columns * rows, F.col("wide")).otherwise(F.raise_error(F.lit(f"more pictures than a grid of {columns} by {rows} holds")))
        cells = cells.withColumn("wide", fits)
    return cells.withColumn("px", (F.col("at") % F.col("wide")) * (F.col("cell_w") + gap)).withColumn("py", F.floor(F.col("at") / F.col("wide")).cast("int") * (F.col("cell_h") + gap)).drop("at", "wide")


def painted(px: DataFrame, rooms: DataFrame, group: str = "group_id", gravity: str = "northwest") -> DataFrame:
    """(group, x, y, r, g, b, a): the pictures (image_id is a room's seq) moved to their rooms on the group's canvas, by gravity
    within the room. Nothing but the rooms is joined, and pixels never meet: what no picture covers has no row."""
    across, down = GRAVITIES[gravity]
    at = rooms.select(group, F.col("seq").alias("image_id"), (F.col("px") + place(F.col("cell_w"), F.col("w"), across, 0)).alias("px"), (F.col("py") + place(F.col("cell_h"), F.col("h"), down, 0)).alias("py"))
    return px.join(at, "image_id").select(group, (F.col("x") + F.col("px")).alias("x"), (F.col("y") + F.col("py")).alias("y"), *"rgba")


def runs(px: DataFrame) -> DataFrame:
    """(image_id, y, start, length, r, g, b, a): runs of equal colour along rows."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    changed = F.lit(False)
    for c in "rgba":
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(row))
    numbered = px.withColumn("run", F.sum(changed.cast("int")).over(row))
    return numbered.groupBy("image_id", "y", "run", *"rgba").agg(F.min("x").alias("start"), F.count("*").alias("length")).drop("run")


def draw_counts(px: DataFrame) -> DataFrame:
    """(image_id, draws, kept): the runs of a picture that differ from its commonest colour, which is filled first, and the pixels
    that the fill spares."""
    ground = commonest_colour(px)
    own = ground.select("image_id", *(F.col(c).alias(f"g{c}") for c in "rgba"), "n")
    apart = F.lit(False)
    for c in "rgba":
        apart = apart | (F.col(c) != F.col(f"g{c}"))
    found = runs(px).join(own, "image_id")
    return found.groupBy("image_id").agg(F.sum(apart.cast("int")).alias("draws"), F.max("n").alias("kept"))


def index_lines(cuts: DataFrame) -> DataFrame:
    """(image_id, text): one line of x, y, width and height for each cut (image_id, seq, x, y, w, h), in order."""
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x", "y", "w", "h"))).alias("line"))))
    return cuts.groupBy("image_id").agg(F.array_join(F.transform(lines, lambda v: F.concat(v["line"], F.lit("\r\n"))), "").alias("text"))


def commonest_colour(px: DataFrame) -> DataFrame:
    """(image_id, r, g, b, a, n): the colour of most pixels; the smallest of equals."""
    counts = px.groupBy("image_id", *"rgba").agg(F.count("*").alias("n"))
    best = counts.groupBy("image_id").agg(F.min(F.struct((-F.col("n")).alias("m"), *"rgba")).alias("c"))
    return best.select("image_id", *(F.col(f"c.{c}").alias(c) for c in "rgba"), (-F.col("c.m")).alias("n"))


def bounding_box(px: DataFrame, ground: DataFrame) -> DataFrame:
    """(image_id, x0, y0, x1, y1): the box around all pixels that differ from the picture's ground colour."""
    own = ground.select("image_id", *(F.col(c).alias(f"g{c}") for c in "rgba"))
    apart = F.lit(False)
    for c in "rgba":
        apart = apart | (F.col(c) != F.col(f"g{c}"))
    return px.join(own, "image_id").where(apart).groupBy("image_id").agg(*(f("x" if k in (0, 2) else "y").alias(n) for k, (n, f) in enumerate((("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max)))))


def shelves(sizes: DataFrame, group: str = "group_id", quantum: int = 1, gap: int = 0) -> DataFrame:
    """(group, seq, px, py, canvas_w, canvas_h): pictures on shelves, the tallest first, at the width whose canvas is squarest.

    Only sizes reach a task, one group at a time; candidate widths are the running totals of the widths, and are all tried
    together, picture by picture."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "seq"], ascending=[False, True], kind="stable")
        w, h = pdf["w"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64)
        room, deep = -(-w // quantum) * quantum, -(-h // quantum) * quantum
        widths = (room + gap).cumsum() - gap

        def pack(widths: np.ndarray, places: list | None = None) -> tuple[np.ndarray, np.ndarray]:
            x, y, shelf, reach = (np.zeros(len(widths), np.int64) for _ in range(4))
            for k in range(len(w)):
                full = (x > 0) & (x + w[k] > widths)
                y += np.where(full, shelf + gap, 0)
                x, shelf = np.where(full, 0, x), np.where(full, 0, shelf)
                if places is not None:
                    places.append((x[0], y[0]))
                reach = np.maximum(reach, x + room[k])
                x = x + room[k] + gap
                shelf = np.maximum(shelf, deep[k])
            return reach, y + shelf

        across, down = pack(widths)
        best = np.lexsort((np.arange(len(widths)), down, across * down, np.maximum(across, down)))[:1]
        places: list[tuple[int, int]] = []
        pack(widths[best], places)
        return pdf[[group, "seq"]].assign(px=[p[0] for p in places], py=[p[1] for p in places], canvas_w=across[best[0]], canvas_h=down[best[0]])

    kinds = {c: sizes.schema[c].dataType.simpleString() for c in (group, "seq")}
    return sizes.select(group, "seq", "w", "h").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, seq {kinds['seq']}, px int, py int, canvas_w int, canvas_h int")
