"""Pixels as the bytes of a colour format and back, and pictures in planes: projections of pixel rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import from_rgb565, from_rgba5551, from_yuv, gray8, rgb555, rgb565, rgba5551, widen5

Pixel = tuple[Column, Column, Column, Column]


def _bytes(*values: Column) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(v.cast("long")), 2, "0") for v in values)))


def _word(value: Column) -> Column:
    """Two bytes, the lower one first."""
    return _bytes(value % 256, F.floor(value / 256))


def _at(data: Column, k: int) -> Column:
    return F.conv(F.hex(F.substring(data, k + 1, 1)), 16, 10).cast("int")


def _word_at(data: Column) -> Column:
    return _at(data, 0) + _at(data, 1) * 256


def _from_rgb555(v: Column) -> tuple[Column, Column, Column]:
    part = lambda n: widen5(F.shiftright(v, n).bitwiseAND(F.lit(31)))
    return part(10), part(5), part(0)  # the highest bit means nothing


#: Format -> bytes of a pixel's r, g, b, a.
TO_BYTES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "rgb888": lambda r, g, b, a: _bytes(r, g, b),
    "rgba8888": lambda r, g, b, a: _bytes(r, g, b, a),
    "bgr888": lambda r, g, b, a: _bytes(b, g, r),
    "bgra8888": lambda r, g, b, a: _bytes(b, g, r, a),
    "gray8": lambda r, g, b, a: _bytes(gray8(r, g, b)),
    "grayalpha88": lambda r, g, b, a: _bytes(gray8(r, g, b), a),
    "rgb565": lambda r, g, b, a: _word(rgb565(r, g, b)),
    "rgb555": lambda r, g, b, a: _word(rgb555(r, g, b)),
    "rgba5551": lambda r, g, b, a: _word(rgba5551(r, g, b, a)),
}


def _opaque(*rgb: Column) -> Pixel:
    return (*rgb, F.lit(255))


#: Format -> r, g, b, a of a pixel's bytes; formats without alpha are opaque.
FROM_BYTES: dict[str, Callable[[Column], Pixel]] = {
    "rgb888": lambda v: _opaque(_at(v, 0), _at(v, 1), _at(v, 2)),
    "rgba8888": lambda v: (_at(v, 0), _at(v, 1), _at(v, 2), _at(v, 3)),
    "bgr888": lambda v: _opaque(_at(v, 2), _at(v, 1), _at(v, 0)),
    "bgra8888": lambda v: (_at(v, 2), _at(v, 1), _at(v, 0), _at(v, 3)),
    "gray8": lambda v: _opaque(_at(v, 0), _at(v, 0), _at(v, 0)),
    "grayalpha88": lambda v: (_at(v, 0), _at(v, 0), _at(v, 0), _at(v, 1)),
    "rgb565": lambda v: _opaque(*from_rgb565(_word_at(v))),
    "rgb555": lambda v: _opaque(*_from_rgb555(_word_at(v))),
    "rgba5551": lambda v: from_rgba5551(_word_at(v)),
}


def to_bytes(px: DataFrame, kind: str) -> DataFrame:
    """(image_id, x, y, data): every pixel as the bytes of a format."""
    return px.select("image_id", "x", "y", TO_BYTES[kind](*(F.col(c) for c in "rgba")).alias("data"))


def from_bytes(data: DataFrame, kind: str) -> DataFrame:
    """Pixel rows of (image_id, x, y, data)."""
    return data.select("image_id", "x", "y", *(v.cast("int").alias(c) for c, v in zip("rgba", FROM_BYTES[kind](F.col("data")), strict=True)))


def forget(px: DataFrame) -> DataFrame:
    """(image_id, width, height): what is left of pictures in any format without their pixels."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def yuv420(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full-range BT.601 planes: luma (image_id, x, y, v) with even sides, whose spare column and row repeat the edge, and chroma
    (image_id, x, y, u, v) of half the size, each of the average of two by two pixels. Blocks at an odd edge repeat it, too."""
    sizes = forget(px)
    rows = px.join(sizes, "image_id")
    last = lambda at, size: (F.col(at) == F.col(size) - 1) & (F.col(size) % 2 == 1)
    twice = lambda at, size: F.when(last(at, size), F.array(F.col(at), F.col(at) + 1)).otherwise(F.array(F.col(at)))
    rows = rows.withColumn("px", F.explode(twice("x", "width"))).withColumn("py", F.explode(twice("y", "height")))
    luma = rows.select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), F.shiftright(77 * F.col("r") + 150 * F.col("g") + 29 * F.col("b") + 128, 8).alias("v"))
    place = (F.col("py") % 2) * 2 + F.col("px") % 2
    at = lambda c, k: F.max(F.when(place == k, F.col(c)))
    half = lambda a, b: F.shiftright(a + b + 1, 1)
    blocks = rows.groupBy("image_id", F.shiftright("px", 1).alias("x"), F.shiftright("py", 1).alias("y"))
    means = blocks.agg(*(half(half(at(c, 0), at(c, 2)), half(at(c, 1), at(c, 3))).alias(c) for c in "rgb"))
    r, g, b = (F.col(c) for c in "rgb")
    chroma = means.select("image_id", "x", "y", F.shiftright(127 * b - 84 * g - 43 * r + 0x8080, 8).alias("u"), F.shiftright(127 * r - 107 * g - 20 * b + 0x8080, 8).alias("v"))
    return luma, chroma


def of_yuv420(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """Pixel rows of planes; each chroma value serves two by two pixels."""
    own = chroma.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "u", F.col("v").alias("w"))
    rows = luma.withColumns({"cx": F.shiftright("x", 1), "cy": F.shiftright("y", 1)}).join(own, ["image_id", "cx", "cy"])
    return rows.select("image_id", "x", "y", *(v.cast("int").alias(c) for c, v in zip("rgb", from_yuv(F.col("v"), F.col("u"), F.col("w")), strict=True)), F.lit(255).alias("a"))
