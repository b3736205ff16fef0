"""Block textures: 64 bits for 4 by 4 pixels, read by bit fields in expressions.

A block's first half holds two base colours, either as two of 4 bits a channel or as one of 5 bits and a difference, a table for each
half of the block and whether the halves lie one above the other; the second half holds two bits for each pixel, by columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The small and the large step of each table of intensities.
STEPS = [(2, 8), (5, 17), (9, 29), (13, 42), (18, 60), (24, 80), (33, 106), (47, 183)]


def _word(block: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(block, at + 1, 4)), 16, 10).cast("long")


def _bits(word: Column, low: int, n: int) -> Column:
    return F.shiftright(word, low).bitwiseAND(F.lit((1 << n) - 1)).cast("int")


def etc1_pixels(blocks: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b, a) of pictures in blocks (image_id, bx, by, block): opaque, each block at (4 bx, 4 by). A block that isn't
    eight bytes long has no pixels. A base colour out of range by its difference wraps, as the bits do."""
    high, low = _word(F.col("block"), 0), _word(F.col("block"), 4)
    rows = blocks.where(F.octet_length("block") == 8).select("image_id", "bx", "by", high.alias("high"), low.alias("low"))
    apart, flipped = _bits(F.col("high"), 1, 1) == 1, _bits(F.col("high"), 0, 1) == 1
    fields = {"flipped": flipped, "t0": _bits(F.col("high"), 5, 3), "t1": _bits(F.col("high"), 2, 3)}
    wide4, wide5 = (lambda v: v * 17), (lambda v: F.shiftleft(v, 3).bitwiseOR(F.shiftright(v, 2)))
    for k, c in enumerate("rgb"):
        at = 24 - 8 * k
        five, step = _bits(F.col("high"), at + 3, 5), _bits(F.col("high"), at, 3)
        other = (five + step - F.when(step >= 4, 8).otherwise(0)).bitwiseAND(F.lit(31))
        fields |= {f"{c}0": F.when(apart, wide5(five)).otherwise(wide4(_bits(F.col("high"), at + 4, 4))), f"{c}1": F.when(apart, wide5(other)).otherwise(wide4(_bits(F.col("high"), at, 4)))}
    rows = rows.select("image_id", "bx", "by", "low", *(v.alias(n) for n, v in fields.items()))
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumns({"dx": F.floor(F.col("p") / 4).cast("int"), "dy": (F.col("p") % 4).cast("int")})
    second = F.when(F.col("flipped"), F.col("dy") >= 2).otherwise(F.col("dx") >= 2)
    bit = lambda n: F.expr(f"cast(shiftright(low, p + {n}) & 1 as int)")
    rows = rows.withColumns({"second": second, "large": bit(0), "minus": bit(16)})
    steps = F.array(*(F.array(*map(F.lit, s)) for s in STEPS))
    size = F.get(F.get(steps, F.when(F.col("second"), F.col("t1")).otherwise(F.col("t0"))), F.col("large"))
    rows = rows.withColumn("change", F.when(F.col("minus") == 1, -size).otherwise(size))
    level = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.when(F.col("second"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")) + F.col("change"))).alias(c)
    return rows.select("image_id", (F.col("bx") * 4 + F.col("dx")).alias("x"), (F.col("by") * 4 + F.col("dy")).alias("y"), *map(level, "rgb"), F.lit(255).alias("a"))
