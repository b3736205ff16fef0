"""What a picture costs to draw run by run, and what fills, boxes and a little slack in the colours save.

A picture is cut into rectangles, ``cuts`` (image_id, seq, x, y, w, h), that don't overlap. Of each cut the commonest colour can be
filled first, so that only the box around everything else is drawn; a fill is kept when the pixels that it spares are worth more
than it costs. Runs of one colour along the rows of the boxes are the draws. With slack, pixels are pulled onto colours near them
until fewer runs are left; ``least_slack`` searches the least slack that saves a given share of the draws.

Colours are compared as keys, 0xAARRGGBB. Two are near each other if none of red, green and blue is further apart than the slack and
the alphas are equal. Pixels meet cuts by an equal join on their places, so work is proportional to areas.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.storage import materialize, small_batches

_MOST_SLACK = 512  # 32 levels, in sixteenths
_AT_ONCE = 1 << 20  # pixels that a task's arrays take at a time, or one cut
_DRAW_BYTES = 9600 // 77  # what a draw is worth
_MASK_BYTES = 128 + 1 + 3 * 256  # of a bitmap beside its rows


def _key() -> Column:
    r, g, b, a = (F.col(c).cast("long") for c in "rgba")
    return F.shiftleft(a, 24) + F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def _apart(one: Column, two: Column, slack: Column) -> Column:
    byte = lambda v, n: F.shiftright(v, n).bitwiseAND(F.lit(255))
    differs = byte(one, 24) != byte(two, 24)
    for n in (16, 8, 0):
        differs = differs | (F.abs(byte(one, n) - byte(two, n)) > slack)
    return differs


def _places(rects: DataFrame, *names: str) -> DataFrame:
    """``rects`` with a row (px, py) for each of their pixels; ``names`` are the columns of left, top, width and height."""
    x, y, w, h = map(F.col, names)
    rows = rects.where((w > 0) & (h > 0)).withColumn("py", F.explode(F.sequence(y, y + h - 1)))
    return rows.withColumn("px", F.explode(F.sequence(x, x + w - 1)))


def _keys(px: DataFrame) -> DataFrame:
    return px.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), _key().alias("key"))


def flatten(px: DataFrame, cuts: DataFrame, worth: int, bytes_per_pixel: int = 4, even: bool = False, slack: str | None = None) -> DataFrame:
    """``cuts`` with the ``ground`` that fills them (a key; null where a fill isn't worth it) and the box that is left to draw: box_x, box_y, box_w, box_h,
    the whole cut without a fill, nothing (0 by 0) where all of the cut is ground.

    The ground is the cut's commonest colour, the smallest key of equals. ``slack`` is a column of ``cuts``, in levels. With ``even`` a box
    starts and ends at even places, and there is no fill where such a box would leave its cut."""
    near = F.coalesce(F.col(slack), F.lit(0)) if slack else F.lit(0)
    rows = cuts.withColumn("near", near)
    held = _places(rows, "x", "y", "w", "h").select("image_id", "seq", "near", "px", "py").join(_keys(px), ["image_id", "px", "py"])
    by = ["image_id", "seq"]
    counts = held.groupBy(*by, "key").agg(F.count("*").alias("n"))
    ground = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("less"), "key"))["key"].alias("ground"))
    other = held.join(ground, by).groupBy(*by, "ground")
    off = _apart(F.col("key"), F.col("ground"), F.col("near"))
    edges = other.agg(*(f(F.when(off, c)).alias(n) for n, f, c in (("x0", F.min, F.col("px")), ("y0", F.min, F.col("py")), ("x1", F.max, F.col("px")), ("y1", F.max, F.col("py")))))
    found = rows.join(edges, by, "left")
    some = F.col("x0").isNotNull()
    box = {"box_x": F.when(some, F.col("x0")).otherwise(F.col("x")), "box_y": F.when(some, F.col("y0")).otherwise(F.col("y")), "box_w": F.when(some, F.col("x1") - F.col("x0") + 1).otherwise(0), "box_h": F.when(some, F.col("y1") - F.col("y0") + 1).otherwise(0)}
    found = found.withColumns(box)
    fits = F.lit(True)
    if even:  # outwards to even edges
        for at, size in (("box_x", "box_w"), ("box_y", "box_h")):
            end = F.col(at) + F.col(size)
            start = F.col(at) - F.pmod(F.col(at), F.lit(2))
            long = end - start + F.pmod(end - start, F.lit(2))
            found = found.withColumn(f"{at}2", F.when(some, start).otherwise(F.col(at))).withColumn(size, F.when(some, long).otherwise(F.col(size)))
        found = found.withColumn("box_x", F.col("box_x2")).withColumn("box_y", F.col("box_y2")).drop("box_x2", "box_y2")
        fits = ~some | ((F.col("box_x") + F.col("box_w") <= F.col("x") + F.col("w")) & (F.col("box_y") + F.col("box_h") <= F.col("y") + F.col("h")))
    spared = (F.col("w") * F.col("h") - F.col("box_w") * F.col("box_h")) * bytes_per_pixel
    kept = F.col("ground").isNotNull() & fits & (spared > worth)
    whole = {"box_x": "x", "box_y": "y", "box_w": "w", "box_h": "h"}
    found = found.withColumn("kept", F.coalesce(kept, F.lit(False)))
    return found.select(*cuts.columns, F.when(F.col("kept"), F.col("ground")).alias("ground"), *(F.when(F.col("kept"), F.col(b)).otherwise(F.col(c)).alias(b) for b, c in whole.items()))


def merge_fills(fills: DataFrame) -> DataFrame:
    """Fills (image_id, seq, x, y, w, h, ground, solid) that touch and share a colour as one: first neighbours across in a row, then
    rows of equal extent downwards. (image_id, place, x, y, w, h, ground, solid), by ``place`` in the order in which they are painted.

    Each pass is a running number of islands; a fill follows the one before it in order, or opens an island."""

    def joined(rows: DataFrame, order: list[str], same: list[str], at: str, size: str) -> DataFrame:
        row = Window.partitionBy("image_id").orderBy(*order)
        follows = F.lag(F.col(at) + F.col(size)).over(row) == F.col(at)
        for c in same:
            follows = follows & (F.lag(c).over(row) == F.col(c))
        numbers = rows.withColumn("opens", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("island", F.sum("opens").over(row.rowsBetween(Window.unboundedPreceding, 0)))
        other = [c for c in ("x", "y", "w", "h") if c not in (at, size)]
        first = F.min(F.struct(*order))
        rects = numbers.groupBy("image_id", "island").agg(first.alias("first"), F.min(at).alias(at), F.sum(size).alias(size), *(F.min(c).alias(c) for c in other), F.min("ground").alias("ground"), F.min("solid").alias("solid"))
        return rects.select("image_id", F.col("first.seq").alias("seq"), *(F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")), "ground", "solid")

    across = joined(fills, ["y", "x", "seq"], ["y", "h", "ground"], "x", "w")
    down = joined(across, ["x", "y", "seq"], ["x", "w", "ground"], "y", "h")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("x", "y", "seq"))
    return down.select("image_id", place.alias("place"), "x", "y", "w", "h", "ground", "solid")


def fills_of(flat: DataFrame) -> DataFrame:
    """The fills of ``flatten``, merged."""
    own = flat.where("ground is not null")
    return merge_fills(own.select("image_id", "seq", "x", "y", "w", "h", "ground", (F.col("box_w") == 0).alias("solid")))


def draws(px: DataFrame, boxes: DataFrame, fills: DataFrame | None = None, stretched: bool = True, spared: DataFrame | None = None) -> DataFrame:
    """(image_id, draws): runs of one colour along the rows of the boxes, and one for each fill, less what masks (``spared``) save. Where
    a preview is ``stretched`` over pairs of rows, every second row of a box is painted twice."""
    held = _places(boxes.select("image_id", "seq", "box_y", "box_h", "box_x", "box_w"), "box_x", "box_y", "box_w", "box_h").join(_keys(px).hint("merge"), ["image_id", "px", "py"])
    row = Window.partitionBy("image_id", "seq", "py").orderBy("px")
    starts = F.coalesce(F.lag("key").over(row) != F.col("key"), F.lit(True))
    twice = F.lit(stretched) & (F.col("box_h") > 1) & (F.pmod(F.col("py") - F.col("box_y"), F.lit(2)) == 1)
    cost = held.select("image_id", F.when(starts, F.when(twice, 2).otherwise(1)).otherwise(0).alias("n"))
    if fills is not None:
        cost = cost.union(fills.select("image_id", F.lit(1)))
    if spared is not None:
        cost = cost.union(spared.select("image_id", -F.col("spared")))
    pictures = boxes.select("image_id").distinct()
    return pictures.join(cost.groupBy("image_id").agg(F.sum("n").cast("long").alias("draws")), "image_id", "left").select("image_id", F.greatest(F.coalesce("draws", F.lit(0).cast("long")), F.lit(0).cast("long")).alias("draws"))


def _grounds(boxes: DataFrame, fills: DataFrame) -> DataFrame:
    """(image_id, seq, px, py, under): the colour under each pixel of the boxes that stand on one fill: the last fill painted there."""
    own = _places(boxes, "box_x", "box_y", "box_w", "box_h").select("image_id", "seq", "px", "py", (F.col("box_w") * F.col("box_h")).alias("area"))
    met = own.join(_places(fills, "x", "y", "w", "h").select("image_id", "place", "px", "py", "ground"), ["image_id", "px", "py"])
    stands = met.groupBy("image_id", "seq", "place").agg(F.count("*").alias("n"), F.first("area").alias("area")).where("n = area").select("image_id", "seq").distinct()
    last = met.groupBy("image_id", "seq", "px", "py").agg(F.max_by("ground", "place").alias("under"))
    return last.join(stands, ["image_id", "seq"], "left_semi")


def masks(px: DataFrame, boxes: DataFrame, fills: DataFrame, worth: int, stretched: bool = True) -> DataFrame:
    """(image_id, seq, refine, x, y, w, h, spared, bytes): the bitmaps that spare draws worth more than they cost.

    The first mask of a box spares the pixels that are exactly the ground under them; the second, where a preview is ``stretched`` over
    pairs of rows, those of the upper row that are like the pixel below and not spared before. A run of spared pixels is a draw
    less, two where its row is painted twice. A mask covers what it spares, at one bit a pixel, rows packed by run lengths; it
    is kept if its draws, at their worth in bytes, exceed its size and ``worth``."""
    by, box = ["image_id", "seq"], ["box_x", "box_y", "box_w", "box_h"]
    own = _places(boxes.select(*by, *box), *box).join(_keys(px), ["image_id", "px", "py"]).join(_grounds(boxes, fills), [*by, "px", "py"], "left")
    own = own.withColumn("plain", F.coalesce(F.col("key") == F.col("under"), F.lit(False)))
    own = own.withColumn("below", F.lead("key").over(Window.partitionBy(*by, "px").orderBy("py")))
    odd = F.pmod(F.col("py") - F.col("box_y"), F.lit(2)) == 1
    paired = ~odd & ~F.col("plain") & F.coalesce(F.col("key") == F.col("below"), F.lit(False))
    layers = [F.struct(F.lit(False).alias("refine"), F.col("plain").alias("spared"), F.when(F.lit(stretched) & (F.col("box_h") > 1) & odd, 2).otherwise(1).alias("paints"))]
    if stretched:
        layers.append(F.struct(F.lit(True).alias("refine"), paired.alias("spared"), F.lit(1).alias("paints")))
    rows = own.select(*by, "px", "py", F.explode(F.array(*layers)).alias("m")).select(*by, "px", "py", "m.*")
    mask, row = [*by, "refine"], Window.partitionBy(*by, "refine", "py")
    begins = F.col("spared") & ~F.coalesce(F.lag("spared").over(row.orderBy("px")), F.lit(False))
    rows = rows.withColumn("n", F.when(begins, F.col("paints")).otherwise(0))
    some = lambda f, c: f(F.when(F.col("spared"), F.col(c)))
    found = rows.groupBy(*mask).agg(F.sum("n").alias("runs"), some(F.min, "px").alias("x"), some(F.min, "py").alias("y"), (some(F.max, "px") - some(F.min, "px") + 1).alias("w"), (some(F.max, "py") - some(F.min, "py") + 1).alias("h")).where("runs > 0")
    inside = rows.join(found.select(*mask, "x", "y", "w", "h"), mask).where("px between x and x + w - 1 and py between y and y + h - 1")
    at = F.col("px") - F.col("x")
    bits = inside.groupBy(*mask, "py", F.floor(at / 8).cast("int").alias("byte")).agg(F.sum(F.when(F.col("spared"), 0).otherwise(F.expr("shiftleft(1, 7 - (px - x) % 8)"))).cast("int").alias("value"))
    wide = F.ceil(F.col("w") / 8).cast("int")
    padding = found.where(F.pmod(wide, F.lit(2)) == 1).select(*mask, F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("py"), wide.alias("byte"), F.lit(0).alias("value"))
    line = row.orderBy("byte")
    runs = bits.union(padding).withColumn("new", F.coalesce(F.lag("value").over(line) != F.col("value"), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(line))
    runs = runs.groupBy(*mask, "py", "run", "value").agg(F.count("*").alias("n"))
    rest = F.pmod(F.col("n"), F.lit(63))
    cost = F.floor(F.col("n") / 63) * 2 + F.when(rest == 0, 0).when((rest > 1) | (F.col("value") >= 0xC0), 2).otherwise(1)
    sizes = runs.groupBy(*mask).agg((F.sum(cost) + _MASK_BYTES).cast("long").alias("bytes"))
    kept = found.join(sizes, mask).where(F.col("runs") * _DRAW_BYTES > worth + F.col("bytes"))
    return kept.select(*mask, "x", "y", "w", "h", F.col("runs").cast("long").alias("spared"), "bytes")


def _near(one: np.ndarray, two: np.ndarray, slack: np.ndarray) -> np.ndarray:
    ok = one >> 24 == two >> 24
    for n in (16, 8, 0):
        ok &= np.abs((one >> n & 255) - (two >> n & 255)) <= slack
    return ok


def pulled(keys: np.ndarray, under: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Keys (boxes x height x width) pulled onto the ground (``under``, -1 for none), else the run before, else the pixel above, where
    that is near and doesn't end the next run; ``slack`` is in sixteenths, a number for each box.

    A pixel waits for the one before it and the one above, so all pixels with the same x + y are settled together, in all boxes."""
    n, h, w = keys.shape
    out, run = keys.copy(), np.zeros((n, h), np.int64)
    allowed = (slack[:, None] + np.arange(h)[None] * 7 % 16) // 16
    for front in range(w + h - 1):
        y = np.arange(max(0, front - w + 1), min(h - 1, front) + 1)
        x = front - y
        key, ground, level = keys[:, y, x], under[:, y, x], allowed[:, y]
        above = out[:, np.maximum(y - 1, 0), x]
        after = keys[:, y, np.minimum(x + 1, w - 1)]
        takes = (y > 0)[None] & _near(key, above, level) & ((x == w - 1)[None] | _near(after, above, level))
        settled = np.where(takes, above, key)
        settled = np.where((x > 0)[None] & _near(key, run[:, y], level), run[:, y], settled)
        settled = np.where((ground >= 0) & _near(key, ground, level), ground, settled)
        out[:, y, x] = run[:, y] = settled
    return np.where((slack > 0)[:, None, None], out, keys)


def _packed(px: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts`` with their ``pixels``, each a number: its place in the cut, in rows, << 32, and its key. Cuts without any stay.

    The places of a cut are many more rows than the cut, which sizes estimated from files don't show; so this join broadcasts nothing."""
    x, y, w, h = map(F.col, "xywh")
    rows = cuts.withColumn("py", F.explode_outer(F.when((w > 0) & (h > 0), F.sequence(y, y + h - 1))))
    places = rows.withColumn("px", F.explode_outer(F.when(F.col("py").isNotNull(), F.sequence(x, x + w - 1))))
    held = places.join(_keys(px).hint("merge"), ["image_id", "px", "py"], "left")
    place = (F.col("py") - y).cast("long") * w + (F.col("px") - x)
    return held.groupBy(*cuts.columns).agg(F.sort_array(F.collect_list(F.shiftleft(place, 32) + F.col("key"))).alias("pixels"))


class Cuts(NamedTuple):
    """Cuts of ``_packed`` in a task: their x, y, w, h and their pixels."""

    rects: np.ndarray
    pixels: list[np.ndarray]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Cuts:
        pixels = batch.column("pixels")
        values, ends = pixels.flatten().to_numpy(), np.cumsum(pixels.value_lengths().to_numpy())
        return cls(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in "xywh"], axis=1), np.split(values, ends[:-1]) if len(ends) else [])

    def __add__(self, other: Cuts) -> Cuts:
        return Cuts(np.concatenate([self.rects, other.rects]), self.pixels + other.pixels)

    def __getitem__(self, rows: slice) -> Cuts:
        return Cuts(self.rects[rows], self.pixels[rows])

    def tables(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cuts of equal size that have pixels: their numbers, and their keys (cuts x height x width), -1 where a pixel is missing."""
        size, n = self.rects[:, 2:], np.array([len(p) for p in self.pixels], np.int64)
        for w, h in np.unique(size[n > 0], axis=0).tolist():
            rows = np.flatnonzero((size == (w, h)).all(axis=1) & (n > 0))
            step = max(1, _AT_ONCE // (w * h))
            for part in (rows[k : k + step] for k in range(0, len(rows), step)):
                own = np.concatenate([self.pixels[k] for k in part])
                keys = np.full((len(part), h * w), -1, np.int64)
                keys[np.repeat(np.arange(len(part)), n[part]), own >> 32] = own & 0xFFFFFFFF
                yield part, keys.reshape(-1, h, w)


def commonest(keys: np.ndarray) -> np.ndarray:
    """The commonest key of each cut, the smallest of equals; -1 doesn't count."""
    rows = np.sort(keys.reshape(len(keys), -1), axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    starts = np.flatnonzero(new)
    n = np.zeros(rows.size, np.int64)
    n[starts] = np.diff(np.append(starts, rows.size))
    n[rows.ravel() < 0] = 0
    return rows[np.arange(len(rows)), n.reshape(rows.shape).argmax(axis=1)]


def paints(keys: np.ndarray) -> np.ndarray:
    """The runs of one colour along the rows of each box, of every second row twice, as ``draws`` counts them. Missing pixels (-1) are passed over."""
    starts = keys >= 0
    if starts.all():
        starts[:, :, 1:] = keys[:, :, 1:] != keys[:, :, :-1]
    else:
        last = np.maximum.accumulate(np.where(starts, np.arange(keys.shape[2]), -1), axis=2)[:, :, :-1]
        before = np.where(last < 0, -1, np.take_along_axis(keys, np.maximum(last, 0), axis=2))
        starts[:, :, 1:] &= keys[:, :, 1:] != before
    n = starts.sum(axis=2)
    n[:, 1::2] *= 2
    return n.sum(axis=1)


def as_drawn(keys: np.ndarray, ground: np.ndarray, slack: np.ndarray, worth: int, level: int, bytes_per_pixel: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of equal size as they are drawn with a slack, a number for each: the grounds that fill them (-1 for none), their boxes (x, y, w, h
    from the cut's corner, as ``flatten`` finds them), their keys with the runs of boxes made longer, and the draws of these boxes."""
    n, h, w = keys.shape
    boxes = np.tile(np.array([0, 0, w, h], np.int64), (n, 1))
    if level:
        off = ~_near(keys, ground[:, None, None], slack[:, None, None] // 16) & (keys >= 0)
        for k, size, some in ((0, w, off.any(axis=1)), (1, h, off.any(axis=2))):
            boxes[:, k] = some.argmax(axis=1)
            boxes[:, k + 2] = np.where(some.any(axis=1), size - some[:, ::-1].argmax(axis=1) - boxes[:, k], 0)
        kept = (w * h - boxes[:, 2] * boxes[:, 3]) * bytes_per_pixel > worth
        boxes[~kept] = 0, 0, w, h
        ground = np.where(kept, ground, -1)
    else:
        ground = np.full(n, -1, np.int64)
    out, cost = keys.copy(), np.zeros(n, np.int64)
    for wide, tall in np.unique(boxes[boxes[:, 2] > 0, 2:], axis=0).tolist():
        at = np.flatnonzero((boxes[:, 2] == wide) & (boxes[:, 3] == tall))
        inside = (at[:, None, None], boxes[at, 1][:, None, None] + np.arange(tall)[None, :, None], boxes[at, 0][:, None, None] + np.arange(wide)[None, None])
        own = keys[inside]
        moves = (slack[at] > 0) & (own >= 0).all(axis=(1, 2))  # a box that misses pixels stays as it is
        if moves.any():
            own[moves] = pulled(own[moves], np.broadcast_to(ground[at[moves]][:, None, None], own[moves].shape), slack[at[moves]])
            out[inside] = own
        cost[at] = paints(own)
    return ground, boxes, out, cost


def fill_counts(fills: np.ndarray, pictures: int) -> np.ndarray:
    """How many fills ``merge_fills`` leaves of each picture, from rows of picture, number, x, y, w, h, ground."""
    for order, same, at, size in (((0, 3, 2, 1), [0, 3, 5, 6], 2, 4), ((0, 2, 3, 1), [0, 2, 4, 6], 3, 5)):  # across, then down
        if len(fills):
            fills = fills[np.lexsort([fills[:, c] for c in reversed(order)])]
            follows = (fills[1:, same] == fills[:-1, same]).all(axis=1) & (fills[:-1, at] + fills[:-1, size] == fills[1:, at])
            starts = np.flatnonzero(np.append(True, ~follows))
            extent = np.add.reduceat(fills[:, size], starts)
            fills = fills[starts]
            fills[:, size] = extent
    return np.bincount(fills[:, 0], minlength=pictures)


def searched_slack(picture: np.ndarray, cuts: Cuts, worth: int, percent: int, level: int) -> np.ndarray:
    """The least slack of each picture, whose numbers, one for each cut, count from 0."""
    pictures = int(picture[-1]) + 1
    low, high = np.ones(pictures, np.int64), np.full(pictures, _MOST_SLACK)
    if percent <= 0:
        return low * 0
    tables = [(rows, keys, commonest(keys)) for rows, keys in cuts.tables()]
    plain = np.zeros(pictures, np.int64)
    for rows, keys, _ in tables:
        np.add.at(plain, picture[rows], paints(keys))
    target = plain - np.floor(plain * percent / 100).astype(np.int64)

    def tried(slack: np.ndarray, going: np.ndarray) -> np.ndarray:
        """The draws of the pictures that are ``going``, each with its slack."""
        draws, fills = np.zeros(pictures, np.int64), [np.zeros((0, 7), np.int64)]
        for rows, keys, ground in tables:
            use = np.flatnonzero(going[picture[rows]])
            if len(use):
                at = rows[use]
                filled, _, _, cost = as_drawn(keys[use], ground[use], slack[picture[at]], worth, level)
                np.add.at(draws, picture[at], cost)
                own = filled >= 0
                fills.append(np.column_stack([picture[at], at, cuts.rects[at], filled])[own])
        return draws + fill_counts(np.concatenate(fills), pictures)

    enough = tried(low * 0, low > 0) <= target
    low[enough] = high[enough] = 0
    while (going := low < high).any():
        middle = (low + high) // 2
        enough = tried(middle, going) <= target
        high = np.where(going & enough, middle, high)
        low = np.where(going & ~enough, middle + 1, low)
    return low


def planned(px: DataFrame, cuts: DataFrame, worth: int, slack: str, level: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels, boxes and fills of pictures as they are drawn with a slack (a column of ``cuts``, in sixteenths of a level; rows of a box get
    the whole numbers next to it in turn): at level 1 grounds are filled; at level 0 cuts are drawn whole. A cut is one row in a task, as
    its pixels wait for each other; boxes of equal size go together."""
    packed = _packed(px, cuts)
    kinds = {c: cuts.schema[c].dataType for c in "xywh"}
    boxes = [T.StructField("ground", T.LongType()), *(T.StructField(f"box_{c}", kind) for c, kind in kinds.items())]
    schema = T.StructType([*packed.schema.fields[:-1], *boxes, T.StructField("moved", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, slacks = Cuts.of(batch), pc.fill_null(batch.column(slack).cast(pa.int64(), safe=False), 0).to_numpy()
            grounds, rects, moved = np.full(batch.num_rows, -1), own.rects.copy(), [p[:0] for p in own.pixels]
            for rows, keys in own.tables():
                grounds[rows], box, now, _ = as_drawn(keys, commonest(keys), slacks[rows], worth, level)
                rects[rows] = box + own.rects[rows] * (1, 1, 0, 0)
                for k in np.flatnonzero((now != keys).any(axis=(1, 2))).tolist():
                    at = np.flatnonzero(now[k] != keys[k])
                    moved[rows[k]] = (at << 32) + now[k].ravel()[at]
            ends = np.cumsum([0, *map(len, moved)])
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns.append(pa.array(grounds, mask=grounds < 0))
            columns += [pa.array(rects[:, k]).cast(batch.column(c).type) for k, c in enumerate("xywh")]
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(moved), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    with small_batches(px.sparkSession):
        flat = materialize(packed.mapInArrow(run, schema), "flat")
    place = flat.select("image_id", *"xyw", F.explode("moved").alias("p")).withColumn("at", F.shiftright("p", 32))
    x, y = F.col("x") + F.col("at") % F.col("w"), F.col("y") + F.floor(F.col("at") / F.col("w"))
    moved = place.select("image_id", *(v.cast(px.schema[c].dataType).alias(c) for c, v in (("x", x), ("y", y))), F.col("p").alias("new"))
    found = px.join(moved.hint("merge"), ["image_id", "x", "y"], "left")
    byte = lambda n: F.shiftright("new", n).bitwiseAND(F.lit(255)).cast("int")
    drawn = found.select("image_id", "x", "y", *(F.coalesce(byte(n), F.col(c)).alias(c) for c, n in (("r", 16), ("g", 8), ("b", 0))), "a")
    flat = flat.drop("moved")
    return drawn, flat, fills_of(flat)


def least_slack(px: DataFrame, cuts: DataFrame, worth: int, percent: int, level: int = 1) -> DataFrame:
    """(image_id, slack): the least slack, in sixteenths of a level and 512 at most, with which a picture's draws are fewer by ``percent``
    of those of its cuts as they are; 0 if grounds alone do it.

    The search halves an interval, as more slack is taken to cost no more draws. A task has all cuts of a picture, which come to it in
    order and a row each, and searches the pictures of an Arrow batch at once; it holds one picture and one batch at a time."""
    packed = _packed(px, cuts.select("image_id", "seq", *"xywh")).repartition("image_id").sortWithinPartitions("image_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(ids: pa.Array, starts: np.ndarray, own: Cuts) -> pa.RecordBatch:
            pictures = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            slacks = pa.array(searched_slack(pictures, own, worth, percent, level), pa.int32())
            return pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), slacks], ["image_id", "slack"])

        ids, own = None, Cuts(np.zeros((0, 4), np.int64), [])
        for batch in batches:
            now = batch.column("image_id")
            ids = now if ids is None else pa.concat_arrays([ids, now])
            own = own + Cuts.of(batch)
            values = ids.to_pylist()
            starts = np.array([k for k, v in enumerate(values) if not k or v != values[k - 1]], np.int64)
            if len(starts) > 1:  # the last picture may go on in the next batch
                last = int(starts[-1])
                yield searched(ids.slice(0, last), starts[:-1], own[:last])
                ids, own = ids.slice(last), own[last:]
        if ids is not None and len(ids):
            yield searched(ids, np.zeros(1, np.int64), own)

    return packed.mapInArrow(run, T.StructType([T.StructField("image_id", packed.schema["image_id"].dataType), T.StructField("slack", T.IntegerType())]))
