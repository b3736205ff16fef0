"""Colour conversions as column builders: a pixel is four columns r, g, b, a of 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: int) -> Column:
    """Whole-number division of numbers that aren't negative."""
    return F.floor(a / F.lit(b)).cast("int")


def gray8(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 weights, rounded."""
    return F.floor(0.212656 * r + 0.715158 * g + 0.072186 * b + 0.5).cast("int")


def _narrow(c: Column, most: int) -> Column:
    return _div(c * most + 127, 255)


def rgb565(r: Column, g: Column, b: Column) -> Column:
    return _narrow(r, 31) * 2048 + _narrow(g, 63) * 32 + _narrow(b, 31)


def rgb555(r: Column, g: Column, b: Column) -> Column:
    return _narrow(r, 31) * 1024 + _narrow(g, 31) * 32 + _narrow(b, 31)


def rgba5551(r: Column, g: Column, b: Column, a: Column) -> Column:
    return _narrow(r, 31) * 2048 + _narrow(g, 31) * 64 + _narrow(b, 31) * 2 + (a >= 128).cast("int")


def widen5(v: Column) -> Column:
    return F.shiftleft(v, 3).bitwiseOR(F.shiftright(v, 2))


def widen6(v: Column) -> Column:
    return F.shiftleft(v, 2).bitwiseOR(F.shiftright(v, 4))


def from_rgb565(v: Column) -> tuple[Column, Column, Column]:
    five, six = F.lit(31), F.lit(63)
    return widen5(F.shiftright(v, 11).bitwiseAND(five)), widen6(F.shiftright(v, 5).bitwiseAND(six)), widen5(v.bitwiseAND(five))


def from_rgba5551(v: Column) -> tuple[Column, Column, Column, Column]:
    part = lambda n: widen5(F.shiftright(v, n).bitwiseAND(F.lit(31)))
    return part(11), part(6), part(1), F.when(v.bitwiseAND(F.lit(1)) == 1, 255).otherwise(0)


def _byte(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), v))


def from_yuv(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Full-range BT.601 in ten-bit fixed point; the shift rounds down, also below zero."""
    cb, cr = u - 128, v - 128
    return _byte(y + F.shiftright(1436 * cr, 10)), _byte(y - F.shiftright(352 * cb + 731 * cr, 10)), _byte(y + F.shiftright(1815 * cb, 10))


def packed(r: Column, g: Column, b: Column, a: Column) -> Column:
    """0xAARRGGBB as a number."""
    return a.cast("long") * 16777216 + r * 65536 + g * 256 + b


def quantum_byte(share: Column) -> Column:
    """A share of 0 to 1 through sixteen bits down to a byte."""
    return _div(F.floor(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), share * 65535.0 + 0.5))), 257)


def mix(start: tuple[int, int, int, int], end: tuple[int, int, int, int], share: Column) -> dict[str, Column]:
    """Two colours blended, each weighted by its alpha."""
    byte = lambda v: _div(F.floor(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), v * 257.0 + 0.5))), 257)
    alpha = start[3] * (1 - share) + end[3] * share
    channel = lambda k: F.when(alpha <= 0, 0).otherwise(byte((start[k] * start[3] * (1 - share) + end[k] * end[3] * share) / F.greatest(alpha, F.lit(1e-12))))
    return {"r": channel(0), "g": channel(1), "b": channel(2), "a": 255 - byte(255 - alpha)}
