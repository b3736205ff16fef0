"""Generated pictures: every pixel is an expression of its place on a canvas of (image_id, x, y, w, h)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import mix

Colour = tuple[int, int, int, int]


def solid(canvas: DataFrame, colour: Colour) -> DataFrame:
    return canvas.select("image_id", "x", "y", *(F.lit(v).alias(c) for c, v in zip("rgba", colour, strict=True)))


def blank(canvas: DataFrame) -> DataFrame:
    return solid(canvas, (0, 0, 0, 0))


def _painted(canvas: DataFrame, start: Colour, end: Colour, share: Column) -> DataFrame:
    rows = canvas.withColumn("share", share)
    return rows.select("image_id", "x", "y", *(v.cast("int").alias(c) for c, v in mix(start, end, F.col("share")).items()))


WHITE, BLACK = (255, 255, 255, 255), (0, 0, 0, 255)
# For each direction the ends of the line, as shares of the width and height.
_DIRECTIONS = {
    "north": (0, 1, 0, 0), "northeast": (0, 1, 1, 0), "east": (0, 0, 1, 0), "southeast": (0, 0, 1, 1),
    "south": (0, 0, 0, 1), "southwest": (1, 0, 0, 1), "west": (1, 0, 0, 0), "northwest": (1, 1, 0, 0),
}


def pair(first: Colour | None = None, second: Colour | None = None) -> tuple[Colour, Colour]:
    """Both colours of a brush: white and black where none is given; one alone runs to white if it is dark, else to black."""
    if first is None:
        return WHITE, BLACK
    if second is None:
        light = 0.212656 * first[0] + 0.715158 * first[1] + 0.072186 * first[2] > 127.5
        return first, BLACK if light else WHITE
    return first, second


def gradient(canvas: DataFrame, start: Colour, end: Colour, direction: str = "south", angle: float | None = None) -> DataFrame:
    """Along a line: from side to side or corner to corner by ``direction``, or through the middle at ``angle`` degrees (180 is
    south). A line of no length, as down a single row, runs from corner to corner instead."""
    w, h = (F.col("w") - 1).cast("double"), (F.col("h") - 1).cast("double")
    if angle is not None:
        turned = ((angle - 90) % 360 + 360) % 360
        sine, cosine = math.sin(math.radians(turned)), math.cos(math.radians(turned))
        if turned % 90 == 0:
            sine, cosine = float(round(sine)), float(round(cosine))
        reach = w * abs(cosine) + h * abs(sine)
        ends = (w - reach * cosine) / 2, (h - reach * sine) / 2, (w + reach * cosine) / 2, (h + reach * sine) / 2
    else:
        a, b, c, d = map(float, _DIRECTIONS[direction])
        ends = w * a, h * b, w * c, h * d
    rows = canvas.withColumns(dict(zip(("x1", "y1", "x2", "y2"), ends, strict=True)))
    point = (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))
    corners = (F.lit(0.0), F.lit(0.0), w, h)
    rows = rows.withColumn("point", point)
    rows = rows.withColumns({n: F.when(F.col("point"), v).otherwise(F.col(n)) for n, v in zip(("x1", "y1", "x2", "y2"), corners, strict=True)})
    rows = rows.withColumns({"dx": F.col("x2") - F.col("x1"), "dy": F.col("y2") - F.col("y1")}).withColumn("length", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    along = ((F.col("x") - F.col("x1")) * F.col("dx") + (F.col("y") - F.col("y1")) * F.col("dy")) / F.when(F.col("length") > 0, F.col("length"))
    return _painted(rows, start, end, F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along)), F.lit(0.0)))


def radial_gradient(canvas: DataFrame, start: Colour, end: Colour, extent: str = "circle", center: tuple[float, float] | None = None, radii: tuple[float, float] | None = None) -> DataFrame:
    """From the middle (or ``center``) to an edge: a circle that reaches the further side, the nearer one (``minimum``) or the
    corner (``diagonal``), an ``ellipse`` that reaches both, or given ``radii``. A radius of nothing is a point."""
    hw, hh = (F.col("w") - 1) / 2.0, (F.col("h") - 1) / 2.0
    cx, cy = map(F.lit, map(float, center)) if center else (hw, hh)
    across = {"circle": F.greatest(hw, hh), "maximum": F.greatest(hw, hh), "minimum": F.least(hw, hh), "diagonal": F.sqrt(hw * hw + hh * hh), "ellipse": hw}[extent]
    rx, ry = map(F.lit, map(float, radii)) if radii else (across, hh if extent == "ellipse" else across)
    rows = canvas.withColumns({"rx": rx, "ry": ry, "ox": F.col("x") - cx, "oy": F.col("y") - cy})
    share = lambda o, r: F.when(F.col(r) > 0, F.col(o) / F.when(F.col(r) > 0, F.col(r))).when(F.col(o) == 0, 0.0).otherwise(1.0)
    rows = rows.withColumns({"ex": share("ox", "rx"), "ey": share("oy", "ry")})
    return _painted(rows, start, end, F.least(F.lit(1.0), F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))))


def hald(spark, level: int = 8) -> DataFrame:
    """The identity colour cube of level squared steps a channel, as a square picture."""
    if not 2 <= level <= 16:
        raise ValueError("a hald level is 2 to 16")
    steps = level * level
    side = steps * level
    at = spark.range(side * side).withColumnRenamed("id", "at")
    step = lambda v: F.floor(v * 255 / (steps - 1)).cast("int")
    part = lambda n: F.floor(F.col("at") / n) % steps
    return at.select(F.lit(0).cast("long").alias("image_id"), (F.col("at") % side).cast("int").alias("x"), F.floor(F.col("at") / side).cast("int").alias("y"), step(part(1)).alias("r"), step(part(steps)).alias("g"), step(part(steps * steps)).alias("b"), F.lit(255).alias("a"))


def blur_radius(sigma: float) -> int:
    """The box size whose three passes come close to a Gaussian of ``sigma``."""
    return math.floor((math.sqrt(4 * sigma * sigma + 1) - 1) / 2 + 0.5)
