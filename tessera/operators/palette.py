"""Palettes: fitting pixels to the nearest of at most 256 colours, with or without an ordered pattern, and limiting colours.

A palette is bounded by its definition, so it becomes literals of the expression: no join, no broadcast, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Named palettes, 0xRRGGBB in their order.
PALETTES: dict[str, list[int]] = {
    "nes": [
        0x808080, 0x003DA6, 0x0012B0, 0x440096, 0xA1005E, 0xC70028, 0xBA0600, 0x8C1700, 0x5C2F00, 0x104500, 0x054A00, 0x00472E, 0x004166, 0x000000, 0x050505, 0x050505,
        0xC7C7C7, 0x0077FF, 0x2155FF, 0x8237FA, 0xEB2FB5, 0xFF2950, 0xFF2200, 0xD63200, 0xC46200, 0x358000, 0x058F00, 0x008A55, 0x0099CC, 0x212121, 0x090909, 0x090909,
        0xFFFFFF, 0x0FD7FF, 0x69A2FF, 0xD480FF, 0xFF45F3, 0xFF618B, 0xFF8833, 0xFF9C12, 0xFABC20, 0x9FE30E, 0x2BF035, 0x0CF0A4, 0x05FBFF, 0x5E5E5E, 0x0D0D0D, 0x0D0D0D,
        0xFFFFFF, 0xA6FCFF, 0xB3ECFF, 0xDAABEB, 0xFFA8F9, 0xFFABB3, 0xFFD2B0, 0xFFEFA6, 0xFFF79C, 0xD7E895, 0xA6EDAF, 0xA2F2DA, 0x99FFFC, 0xDDDDDD, 0x111111, 0x111111,
    ],
    "cga": [
        0x000000, 0x0000AA, 0x00AA00, 0x00AAAA, 0xAA0000, 0xAA00AA, 0xAA5500, 0xAAAAAA, 0x555555, 0x5555FF, 0x55FF55, 0x55FFFF, 0xFF5555, 0xFF55FF, 0xFFFF55, 0xFFFFFF,
    ],
    "pico8": [
        0x000000, 0x1D2B53, 0x7E2553, 0x008751, 0xAB5236, 0x5F574F, 0xC2C3C7, 0xFFF1E8, 0xFF004D, 0xFFA300, 0xFFEC27, 0x00E436, 0x29ADFF, 0x83769C, 0xFF77A8, 0xFFCCAA,
    ],
    "tic80": [
        0x1A1C2C, 0x5D275D, 0xB13E53, 0xEF7D57, 0xFFCD75, 0xA7F070, 0x38B764, 0x257179, 0x29366F, 0x3B5DC9, 0x41A6F6, 0x73EFF7, 0xF4F4F4, 0x94B0C2, 0x566C86, 0x333C57,
    ],
    "cgagraphics": [
        0x050505, 0xFFFFFF, 0xFF45F3, 0x05FBFF,
    ],
    "kokobatoru": [
        0x050505, 0xFFFFFF, 0xFF9C12, 0xFF2200,
    ],
    "mario": [
        0x69A2FF, 0xFF2200, 0xFF9C12, 0xC46200,
    ],
    "world": [
        0x69A2FF, 0x9FE30E, 0x058F00, 0x050505,
    ],
}


def slice_of(spec: str, wanted: int = 16) -> list[int]:
    """``name``, ``name:BANK`` (banks of ``wanted`` colours), ``name:a..b``, ``name:a,b`` and mixtures, counted from 1."""
    name, colon, rest = spec.partition(":")
    if name not in PALETTES or (colon and not rest):
        raise ValueError(f"no palette {spec}")
    colours = PALETTES[name]
    if not colon:
        return colours
    if rest.isdigit():
        first = (int(rest) - 1) * wanted + 1
        picked = range(first, first + wanted)
    else:
        picked = []
        for part in rest.split(","):
            a, dots, b = part.partition("..")
            low, high = int(a), int(b) if dots else int(a)
            if low > high:
                raise ValueError(f"backwards slice {part}")
            picked += range(low, high + 1)
    if not picked or min(picked) < 1 or max(picked) > len(colours):
        raise ValueError(f"{spec} leaves the palette")
    return [colours[k - 1] for k in picked]


def _nearest(r: Column, g: Column, b: Column, palette: list[int]) -> Column:
    """struct(distance, index) of the nearest colour; the first of equals."""
    return F.least(*(F.struct((2 * (r - (c >> 16)) * (r - (c >> 16)) + 4 * (g - (c >> 8 & 255)) * (g - (c >> 8 & 255)) + 3 * (b - (c & 255)) * (b - (c & 255))).alias("d"), F.lit(k).alias("i")) for k, c in enumerate(palette)))


def bayer(side: int) -> list[list[int]]:
    """Thresholds of an ordered pattern; each doubling puts the pattern so far into four quarters."""
    rows = [[0]]
    while len(rows) < side:
        rows = [[4 * v + q for q in pair for v in row] for pair in ((0, 2), (3, 1)) for row in rows]
    return rows


def quantise(px: DataFrame, palette: list[int], dither: str = "nearest") -> DataFrame:
    """(image_id, x, y, idx): each pixel's palette index. ``strict`` gives null where a colour isn't in the
    palette, so that pictures to be refused can be told from the others."""
    if not 1 <= len(palette) <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    r, g, b = (F.col(c) for c in "rgb")
    if dither == "bayer":
        side = next((s for s in (2, 4, 8) if s * s >= len(palette)), 16)
        half, spread = side * side // 2, 256 // max(len(palette), 2)
        offsets = [int((t - half) * spread / half) for row in bayer(side) for t in row]  # towards zero
        offset = F.get(F.array(*map(F.lit, offsets)), (F.col("y") % side * side + F.col("x") % side).cast("int"))
        r, g, b = (F.least(F.lit(255), F.greatest(F.lit(0), c + offset)) for c in (r, g, b))
    found = px.withColumn("n", _nearest(r, g, b, palette))
    index = F.col("n.i")
    if dither == "strict":
        index = F.when(F.col("n.d") == 0, index)
    return found.select("image_id", "x", "y", index.alias("idx"))


def expand(indices: DataFrame, palette: list[int]) -> DataFrame:
    """The colours of palette indices (image_id, x, y, idx), opaque; an index past the palette fails."""
    known = F.when(F.col("idx").between(0, len(palette) - 1), F.get(F.array(*map(F.lit, palette)), F.col("idx")))
    colour = F.when(F.col("idx").isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit("no colour "), F.col("idx").cast("string"))).cast("int")))
    rows = indices.withColumn("colour", colour)
    part = lambda n: F.shiftright("colour", n).bitwiseAND(F.lit(255))
    return rows.select("image_id", "x", "y", part(16).alias("r"), part(8).alias("g"), part(0).alias("b"), F.lit(255).alias("a"), "idx")


def chr_indices(tiles: DataFrame) -> DataFrame:
    """(image_id, x, y, idx) of pictures (image_id, width, data) in 8 by 8 tiles of two bit planes, eight bytes each, a row of tiles
    after the other; the leftmost pixel is the highest bit. Sides are multiples of 8."""
    byte = lambda at: F.conv(F.hex(F.substring("data", (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0), F.floor(F.length("data") / 16).cast("int") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = rows.withColumns({"low": byte(F.col("tile") * 16 + F.col("row")), "high": byte(F.col("tile") * 16 + 8 + F.col("row")), "wide": F.floor(F.col("width") / 8).cast("int")})
    rows = rows.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bit = lambda c: F.expr(f"shiftright({c}, 7 - column) & 1")
    return rows.select("image_id", (F.col("tile") % F.col("wide") * 8 + F.col("column")).alias("x"), (F.floor(F.col("tile") / F.col("wide")) * 8 + F.col("row")).cast("int").alias("y"), (bit("low") + 2 * bit("high")).alias("idx"))


def most_voted(px: DataFrame, palette: list[int], keep: int) -> DataFrame:
    """(image_id, idx, votes, place): the first ``keep`` colours of the whole palette by how many of a picture's pixels are nearest
    to them; ties, those without votes too, go to the lower index. In the order of ``idx`` they are the limited palette, which is
    the whole of one that is no larger than ``keep``.

    Votes are counted before anything is ranked: a picture ranks at most 256 colours, in one array."""
    votes = quantise(px, palette).groupBy("image_id", "idx").agg(F.count("*").alias("votes"))
    counts = votes.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "votes"))).alias("votes"))
    every = F.transform(F.sequence(F.lit(0), F.lit(len(palette) - 1)), lambda k: F.struct((-F.coalesce(F.element_at("votes", k), F.lit(0))).alias("less"), k.alias("idx")))
    ranked = counts.select("image_id", F.posexplode(F.slice(F.array_sort(every), 1, keep)).alias("at", "c"))
    return ranked.select("image_id", "c.idx", (-F.col("c.less")).alias("votes"), (F.col("at") + 1).alias("place"))


def diffuse(px: DataFrame, palette: list[int]) -> DataFrame:
    """(image_id, x, y, idx) with the error of each pixel passed on to the pixels after and below it (7, 3, 5 and 1 sixteenths).

    The one palette fit that is sequential: each picture is a group and goes through a task by itself. What a pixel is owed comes
    from its left and from three pixels of the row above, so all pixels with the same x + 2 y are fitted together."""
    colours = np.array([[c >> 16, c >> 8 & 255, c & 255] for c in palette], np.int64)
    weights = np.array([2, 4, 3])

    def run(picture: pd.DataFrame) -> pd.DataFrame:
        picture = picture.sort_values(["y", "x"])
        w, h = int(picture["x"].max()) + 1, int(picture["y"].max()) + 1
        wanted = picture[["r", "g", "b"]].to_numpy(np.int64).reshape(h, w, 3)
        owed = np.zeros((h + 1, w + 2, 3), np.int64)  # a rim takes what leaves the picture
        index = np.zeros((h, w), np.int32)
        for front in range(w + 2 * (h - 1)):
            y = np.arange(max(0, (front - w + 2) // 2), min(h - 1, front // 2) + 1)
            x = front - 2 * y
            now = np.clip(wanted[y, x] + owed[y, x + 1], 0, 255)
            index[y, x] = k = (weights * (now[:, None] - colours) ** 2).sum(2).argmin(1)
            left = now - colours[k]
            for dy, dx, part in ((0, 2, 7), (1, 0, 3), (1, 1, 5), (1, 2, 1)):  # no two of a front share a pixel here
                owed[y + dy, x + dx] += np.trunc(left * part / 16).astype(np.int64)
        return picture[["image_id", "x", "y"]].assign(idx=index.ravel())

    kind = px.schema["image_id"].dataType.simpleString()
    return px.select("image_id", "x", "y", "r", "g", "b").groupBy("image_id").applyInPandas(run, f"image_id {kind}, x int, y int, idx int")


def most_apart(px: DataFrame, palette: list[int], keep: int) -> DataFrame:
    """(image_id, idx, place): colours chosen one by one for their votes times the distance from those chosen before.

    A palette no larger than ``keep`` stays whole, in its order. A group is a picture's vote counts, at most 256 rows."""
    if len(palette) <= keep:
        whole = F.posexplode(F.array(*(F.lit(k) for k in range(len(palette))))).alias("p", "idx")
        return px.select("image_id").distinct().select("image_id", whole).select("image_id", "idx", (F.col("p") + 1).alias("place"))
    votes = quantise(px, palette).groupBy("image_id", "idx").agg(F.count("*").alias("votes"))
    colours = np.array([[c >> 16, c >> 8 & 255, c & 255] for c in palette], np.int64)
    distance = ((colours[:, None] - colours[None]) ** 2 * np.array([2, 4, 3])).sum(2)

    def run(counts: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(palette), np.int64)
        n[counts["idx"].to_numpy()] = counts["votes"].to_numpy()
        chosen = [int(n.argmax())]
        while len(chosen) < min(keep, len(palette)):
            score = n * distance[:, chosen].min(1)
            score[chosen] = -1
            if score.max() <= 0:
                break
            chosen.append(int(score.argmax()))
        return pd.DataFrame({"image_id": counts["image_id"].iloc[0], "idx": chosen, "place": range(1, len(chosen) + 1)})

    kind = px.schema["image_id"].dataType.simpleString()
    return votes.groupBy("image_id").applyInPandas(run, f"image_id {kind}, idx int, place int")
