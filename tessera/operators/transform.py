"""Transforms of pictures given as pixel rows; pictures never mix, every shuffle is by image_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crop(px: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The rectangle's pixels, moved to the corner: a filter and a projection."""
    inside = (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)
    return px.where(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def negate(px: DataFrame) -> DataFrame:
    """Colours or grey levels (``v``) turned around; alpha stays."""
    return px.withColumns({c: 255 - F.col(c) for c in ("r", "g", "b", "v") if c in px.columns})


def sized(px: DataFrame) -> DataFrame:
    """``px`` with each picture's width and height; one aggregate by picture, joined back on it."""
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return px.join(sizes, "image_id")


def target_size(width: int | None, height: int | None, mode: str, w: Column, h: Column) -> tuple[Column, Column]:
    """The size a picture is resized to: ``exact``, ``inside`` or ``cover`` a box (the other side to the nearest
    pixel; missing sides follow, rounded down), or ``percent``."""
    least = lambda v: F.greatest(F.lit(1), v.cast("int"))
    if mode == "percent":
        return least(F.floor(w * width / 100)), least(F.floor(h * width / 100))
    if width is None:
        return least(F.floor(w * height / h)), F.lit(height)
    if height is None:
        return F.lit(width), least(F.floor(h * width / w))
    if mode == "exact":
        return F.lit(width), F.lit(height)
    by_width = (F.lit(width) * h >= F.lit(height) * w) if mode == "cover" else (F.lit(width) * h <= F.lit(height) * w)
    nearest = lambda side, to, of: least(F.floor((side * to + F.floor(of / 2)) / of))
    return F.when(by_width, width).otherwise(nearest(w, height, h)), F.when(by_width, nearest(h, width, w)).otherwise(height)


def resize(px: DataFrame, width: int | None = None, height: int | None = None, mode: str = "exact") -> DataFrame:
    """Nearest neighbour. Each source pixel makes the target pixels that fall on it, so nothing is joined but the sizes."""
    rows = sized(px)
    to_w, to_h = target_size(width, height, mode, F.col("w"), F.col("h"))
    rows = rows.withColumn("tw", to_w).withColumn("th", to_h)

    def targets(at: str, size: str, to: str) -> Column:
        # Target t takes source floor(t * size / to): so source s has t from ceil(s * to / size) to below ceil((s + 1) * to / size).
        first = F.ceil(F.col(at) * F.col(to) / F.col(size)).cast("int")
        after = F.ceil((F.col(at) + 1) * F.col(to) / F.col(size)).cast("int")
        return F.when(after > first, F.sequence(first, after - 1)).otherwise(F.array().cast("array<int>"))

    rows = rows.withColumn("nx", F.explode(targets("x", "w", "tw"))).withColumn("ny", F.explode(targets("y", "h", "th")))
    kept = [c for c in px.columns if c not in ("image_id", "x", "y")]
    return rows.select("image_id", F.col("nx").alias("x"), F.col("ny").alias("y"), *kept)


def resize_pad(px: DataFrame, width: int, height: int) -> DataFrame:
    """Fitted inside the box and centred on it; the sides take the colour of the picture's edge, or are clear where it has none."""
    fitted = resize(px, width, height, "inside")
    sizes = fitted.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    at = sizes.select("image_id", F.floor((width - F.col("w")) / 2).cast("int").alias("px"), F.floor((height - F.col("h")) / 2).cast("int").alias("py"))
    moved = fitted.join(at, "image_id").select("image_id", (F.col("x") + F.col("px")).alias("x"), (F.col("y") + F.col("py")).alias("y"), *"rgba")
    ground = at.select("image_id").join(edge_colour(fitted).withColumnsRenamed({c: f"g{c}" for c in "rgba"}), "image_id", "left")
    frame = ground.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return frame.join(moved, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *(F.coalesce(c, f"g{c}", F.lit(0)).alias(c) for c in "rgba"))


def moved_cuts(cuts: DataFrame, dx: Column | int, dy: Column | int, width: Column, height: Column) -> DataFrame:
    """``cuts`` (x, y, w, h and more) moved and trimmed to a canvas; those that leave it are dropped."""
    left, top = F.greatest(F.col("x") + dx, F.lit(0)), F.greatest(F.col("y") + dy, F.lit(0))
    right, bottom = F.least(F.col("x") + dx + F.col("w"), width), F.least(F.col("y") + dy + F.col("h"), height)
    return cuts.withColumns({"x": left, "y": top, "w": right - left, "h": bottom - top}).where("w > 0 and h > 0")


def scaled_cuts(cuts: DataFrame, from_size: tuple[Column, Column], to_size: tuple[Column, Column]) -> DataFrame:
    """``cuts`` of a picture that was resized: both edges are scaled, so cuts that touched still touch, and none is under a pixel."""
    edge = lambda at, of, to: F.floor(at * to / of).cast("int")
    (fw, fh), (tw, th) = from_size, to_size
    left, top = edge(F.col("x"), fw, tw), edge(F.col("y"), fh, th)
    w, h = edge(F.col("x") + F.col("w"), fw, tw) - left, edge(F.col("y") + F.col("h"), fh, th) - top
    return moved_cuts(cuts.withColumns({"x": left, "y": top, "w": F.greatest(w, F.lit(1)), "h": F.greatest(h, F.lit(1))}), 0, 0, tw, th)


def radius(px: DataFrame, size: int) -> DataFrame:
    """Round corners: alpha is cleared beyond the circle in the corner boxes."""
    rows = sized(px)
    r = F.least(F.lit(size), F.floor(F.least("w", "h") / 2).cast("int"))

    def off(at: str, side: str) -> Column:
        c = F.col(at)
        return F.when(c < r, r - 1 - c).when(c >= F.col(side) - r, c - (F.col(side) - r))

    outside = off("x", "w") * off("x", "w") + off("y", "h") * off("y", "h") > r * r
    return rows.withColumn("a", F.when(outside & (r > 0), 0).otherwise(F.col("a"))).select(*px.columns)


def _box_pass(px: DataFrame, size: int, along: str, across: str, channels: list[str]) -> DataFrame:
    """One moving mean along lines. Past the rim the edge counts again: what the window's frame lacks is added from the edges."""
    window = 2 * size + 1
    line = Window.partitionBy("image_id", across)
    by = line.orderBy(along)
    frame = by.rowsBetween(-size, size)
    before = F.greatest(F.lit(0), F.lit(size) - F.col(along))
    after = F.greatest(F.lit(0), F.col(along) + size - F.max(along).over(line))
    edges = {c: (F.first(c).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(c).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for c in channels}
    means = {c: F.floor((F.sum(c).over(frame) + before * edges[c][0] + after * edges[c][1] + size) / window).cast("int").alias(c) for c in channels}
    return px.select(*(means.get(c, F.col(c)) for c in px.columns))


def blur(px: DataFrame, size: int, passes: int = 3) -> DataFrame:
    """Repeated box means across and down, rounded, all channels alike."""
    channels = [c for c in ("r", "g", "b", "a", "u", "v") if c in px.columns]
    px = px.repartition("image_id") if size > 0 else px  # all passes go by lines of a picture, so they need no further exchange
    for _ in range(passes if size > 0 else 0):
        px = _box_pass(_box_pass(px, size, "x", "y", channels), size, "y", "x", channels)
    return px


def blur_yuv420(luma: DataFrame, chroma: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Planes of 4:2:0 pictures blurred in place; chroma by half the size, rounded up."""
    return blur(luma, size), blur(chroma, (size + 1) // 2)


def resize_yuv420(luma: DataFrame, chroma: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Planes of pictures with even sides, resized to even sides plane by plane."""
    return resize(luma, width, height), resize(chroma, width // 2, height // 2)


def edge_colour(px: DataFrame) -> DataFrame:
    """(image_id, r, g, b, a): the upper median of the rim for each channel, where nine in ten of the rim are within 8 of it."""
    rows = sized(px)
    rim = rows.where("x = 0 or y = 0 or x = w - 1 or y = h - 1")
    # Levels are 0 to 255, so a rim comes down to at most 256 counts a channel, however large the picture.
    level = rim.select("image_id", F.posexplode(F.array(*"rgba")).alias("c", "v")).groupBy("image_id", "c", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("image_id", "c").orderBy("v")
    ranked = level.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("image_id", "c")))
    median = ranked.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("image_id", "c").agg(F.min("v").alias("m"))
    wide = median.groupBy("image_id").agg(*(F.max(F.when(F.col("c") == k, F.col("m"))).alias(f"m{c}") for k, c in enumerate("rgba")))
    close = F.lit(True)
    for c in "rgba":
        close = close & (F.abs(F.col(c) - F.col(f"m{c}")) <= 8)
    judged = rim.join(wide, "image_id").groupBy("image_id", *(f"m{c}" for c in "rgba")).agg(F.sum(close.cast("int")).alias("near"), F.count("*").alias("n"))
    return judged.where(F.col("near") * 10 >= F.col("n") * 9).select("image_id", *(F.col(f"m{c}").alias(c) for c in "rgba"))


def histogram(px: DataFrame) -> DataFrame:
    """Pixels of each colour over all pictures; counted in each task first."""
    return px.groupBy("r", "g", "b", "a").agg(F.count("*").alias("n"))
