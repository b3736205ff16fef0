"""Compositing: a layer's pixels are joined with the base's by place, and each rule is one expression over both.

Channels and alphas are shares of 0 to 1. Three families differ in what they do where the layer doesn't reach, or is clear:
``with`` and ``separable`` keep the base there, ``pixels`` keep it or clear it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import quantum_byte
from tessera.operators.transform import negate


def union_of(sa: Column, da: Column) -> Column:
    return sa + da - sa * da


def reciprocal(v: Column) -> Column:
    return F.when(F.abs(v) >= 1e-12, 1 / F.when(F.abs(v) >= 1e-12, v)).when(v < 0, F.lit(-1e12)).otherwise(F.lit(1e12))


def intensity(p: dict[str, Column]) -> Column:
    return 0.212656 * p["r"] + 0.715158 * p["g"] + 0.072186 * p["b"]


def _if(condition: Column, yes, no) -> Column:
    return F.when(condition, yes).otherwise(no)


def _safe(a: Column, b: Column) -> Column:
    """a / b, null where b is 0; the rules look at that case first."""
    return a / F.when(b != 0, b)


#: Separable rules: what a channel becomes where both are opaque.
SEPARABLE: dict[str, Callable[[Column, Column], Column]] = {
    "multiply": lambda s, d: s * d,
    "screen": lambda s, d: s + d - s * d,
    "overlay": lambda s, d: _if(2 * d <= 1, 2 * s * d, 1 - 2 * (1 - s) * (1 - d)),
    "darken": lambda s, d: F.least(s, d),
    "lighten": lambda s, d: F.greatest(s, d),
    "color_dodge": lambda s, d: _if(s + d >= 1, 1.0, _safe(d, 1 - s)),
    "color_burn": lambda s, d: F.when(d >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), _safe(1 - d, s))),
    "hard_light": lambda s, d: _if(2 * s <= 1, 2 * s * d, 1 - 2 * (1 - s) * (1 - d)),
    "soft_light": lambda s, d: _if(2 * s <= 1, d - (1 - 2 * s) * d * (1 - d), d + (2 * s - 1) * (_if(d <= 0.25, ((16 * d - 12) * d + 4) * d, F.sqrt(d)) - d)),
    "difference": lambda s, d: F.abs(s - d),
    "exclusion": lambda s, d: s + d - 2 * s * d,
    "minus_dst": lambda s, d: s - d,
    "minus_src": lambda s, d: d - s,
    "divide_dst": lambda s, d: F.when(d != 0, _safe(s, d)).when(s == 0, 0.0).otherwise(1.0),
    "divide_src": lambda s, d: F.when(s != 0, _safe(d, s)).when(d == 0, 0.0).otherwise(1.0),
    "linear_dodge": lambda s, d: s + d,
    "linear_burn": lambda s, d: s + d - 1,
    "linear_light": lambda s, d: d + 2 * s - 1,
    "vivid_light": lambda s, d: F.when(s == 1, 1.0).when(2 * s <= 1, 1 - (1 - d) * reciprocal(2 * s)).otherwise(d * reciprocal(2 * (1 - s))),
    "pin_light": lambda s, d: F.when(d < 2 * s - 1, 2 * s - 1).when(d > 2 * s, 2 * s).otherwise(d),
    "pegtop_light": lambda s, d: d * d * (1 - 2 * s) + 2 * s * d,
}

Pixel = dict[str, Column]


def _each(rule: Callable[[Column, Column, Column, Column], Column], alpha: Callable[[Column, Column], Column]) -> Callable[[Pixel, Pixel], Pixel]:
    return lambda s, d: {c: rule(s[c], s["a"], d[c], d["a"]) for c in "rgb"} | {"a": alpha(s["a"], d["a"])}


def _only(channel: str) -> Callable[[Pixel, Pixel], Pixel]:
    return lambda s, d: d | {channel: s[channel]}


def _whole(choose: Callable[[Pixel, Pixel], Column]) -> Callable[[Pixel, Pixel], Pixel]:
    return lambda s, d: {c: _if(choose(s, d), s[c], d[c]) for c in "rgba"}


def _mod(v: Column, n: float) -> Column:
    return v - n * F.floor(v / n)


def _luma(p: Pixel) -> Column:
    return 0.298839 * p["r"] + 0.586811 * p["g"] + 0.114350 * p["b"]


class Hcl(NamedTuple):
    """Hue, chroma and luma from source or destination; where one is clear the other stays whole."""

    hue: str
    chroma: str
    luma: str

    def prepare(self, rows: DataFrame, s: Pixel, d: Pixel) -> tuple[DataFrame, Pixel]:
        """``rows`` with the rule's steps as columns, and the result. Each step refers to columns of the one before, so that
        none is written out again and the generated code stays small."""
        rows = rows.withColumns({f"_{n}{c}": p[c] for n, p in (("s", s), ("d", d)) for c in "rgba"})
        of = {n: {c: F.col(f"_{n}{c}") for c in "rgba"} for n in "sd"}
        s, d = of["s"], of["d"]
        top = lambda p: F.greatest(*(p[c] for c in "rgb"))
        low = lambda p: F.least(*(p[c] for c in "rgb"))
        own, wide = of[self.hue], of[self.chroma]
        rows = rows.withColumns({"_top": top(own), "_width": top(own) - low(own), "_c": top(wide) - low(wide), "_y": _luma(of[self.luma])})
        r, g, b, most, width = *(own[c] for c in "rgb"), F.col("_top"), F.when(F.col("_width") != 0, F.col("_width"))
        hue = F.when(F.col("_width") == 0, 0.0).when(r == most, _mod((g - b) / width + 6.0, 6.0)).when(g == most, (b - r) / width + 2.0).otherwise((r - g) / width + 4.0)
        rows = rows.withColumn("_h", hue)
        rows = rows.withColumn("_x", F.col("_c") * (1.0 - F.abs(_mod(F.col("_h"), 2.0) - 1.0)))
        h, c, x, zero = F.col("_h"), F.col("_c"), F.col("_x"), F.lit(0.0)

        def sixth(*six: Column) -> Column:
            out = F.when(h < 1, six[0])
            for k in range(1, 6):
                out = out.when(h < k + 1, six[k])
            return out.otherwise(zero)

        rows = rows.withColumns({"_r": sixth(c, x, zero, zero, x, c), "_g": sixth(x, c, c, x, zero, zero), "_b": sixth(zero, zero, x, c, c, x)})
        rows = rows.withColumn("_lift", F.col("_y") - _luma({k: F.col(f"_{k}") for k in "rgb"}))
        mixed = {k: F.col(f"_{k}") + F.col("_lift") for k in "rgb"} | {"a": F.greatest(s["a"], d["a"])}
        rows = rows.withColumns({f"_o{k}": F.when(s["a"] == 0, d[k]).when(d["a"] == 0, s[k]).otherwise(mixed[k]) for k in "rgba"})
        return rows, {k: F.col(f"_o{k}") for k in "rgba"}


def _flat(rule: Callable[[Column], Column]) -> Callable[[Column, Column, Column, Column], Column]:
    return lambda s, sa, d, da: rule(s * sa + d * da)


#: Rules over whole pixels, and whether the base is kept where the layer doesn't reach.
PIXELS: dict[str, tuple[bool, Hcl | Callable[[Pixel, Pixel], Pixel]]] = {
    "src_in": (False, _each(lambda s, sa, d, da: s, lambda sa, da: sa * da)),
    "src_out": (False, _each(lambda s, sa, d, da: s, lambda sa, da: sa * (1 - da))),
    "src_atop": (True, _each(lambda s, sa, d, da: s * sa + d * (1 - sa), lambda sa, da: da)),
    "dst_over": (True, _each(lambda s, sa, d, da: (d * da + s * sa * (1 - da)) * reciprocal(union_of(sa, da)), union_of)),
    "dst_out": (True, _each(lambda s, sa, d, da: d, lambda sa, da: da * (1 - sa))),
    "dst_atop": (False, _each(lambda s, sa, d, da: d * da + s * (1 - da), lambda sa, da: sa)),
    "xor": (True, _each(lambda s, sa, d, da: (s * sa * (1 - da) + d * da * (1 - sa)) * reciprocal(sa + da - 2 * sa * da), lambda sa, da: sa + da - 2 * sa * da)),
    "clear": (False, _each(lambda s, sa, d, da: F.lit(0.0), lambda sa, da: F.lit(0.0))),
    "modulus_add": (True, _each(_flat(lambda t: _if(t <= 1, t, t - 1)), union_of)),
    "modulus_subtract": (True, _each(lambda s, sa, d, da: _if(s * sa - d * da < 0, s * sa - d * da + 1, s * sa - d * da), union_of)),
    "hard_mix": (True, _each(lambda s, sa, d, da: _if(s * sa + d * da < 1, 0.0, reciprocal(union_of(sa, da))), union_of)),
    "hue": (True, Hcl("s", "d", "d")),
    "saturate": (True, Hcl("d", "s", "d")),
    "luminize": (True, Hcl("d", "d", "s")),
    "colorize": (True, Hcl("s", "s", "d")),
    "src": (False, lambda s, d: s),
    "dst": (True, lambda s, d: d),
    "copy": (True, lambda s, d: s),
    "copy_red": (True, _only("r")),
    "copy_green": (True, _only("g")),
    "copy_blue": (True, _only("b")),
    "copy_cyan": (True, _only("r")),
    "copy_magenta": (True, _only("g")),
    "copy_yellow": (True, _only("b")),
    "copy_black": (True, lambda s, d: d),
    "copy_opacity": (False, lambda s, d: d | {"a": _if(s["mask"] == 1, intensity(s), s["a"])}),
    "darken_intensity": (True, _whole(lambda s, d: s["a"] * intensity(s) < d["a"] * intensity(d))),
    "lighten_intensity": (True, _whole(lambda s, d: s["a"] * intensity(s) > d["a"] * intensity(d))),
    "change_mask": (False, lambda s, d: d | {"a": _if((d["a"] < 0.5) | ((s["a"] == d["a"]) & ((d["a"] == 0) | ((s["r"] == d["r"]) & (s["g"] == d["g"]) & (s["b"] == d["b"])))), 0.0, 1.0)}),
    "stereo": (True, lambda s, d: d | {"r": s["r"], "a": F.greatest(F.lit(0.0), 1 - 1.5 * (1 - d["a"]))}),
    "bumpmap": (True, lambda s, d: {c: _if(s["a"] == 0, d[c], intensity(s) * d[c]) for c in "rgb"} | {"a": _if(s["a"] == 0, d["a"], 1 - intensity(s) * (1 - s["a"]))}),
}

#: Rules with premultiplied channels: colour and coverage.
WITH: dict[str, tuple[Callable, Callable]] = {
    "over": (lambda s, sa, d, da: _if(sa >= 1, s, s * sa + d * da * (1 - sa)), union_of),
    "plus": (lambda s, sa, d, da: s * sa + d * da, lambda sa, da: sa + da),
}

BLENDS = [*WITH, *SEPARABLE, *PIXELS, "dst_in", "tint"]


def _times(a: Column, b: Column) -> Column:
    return F.floor((a * b + 127) / 255).cast("int")


# For each gravity the side that offsets are measured from, across and down.
GRAVITIES = {
    "northwest": ("near", "near"), "north": ("middle", "near"), "northeast": ("far", "near"), "west": ("near", "middle"), "center": ("middle", "middle"), "east": ("far", "middle"),
    "southwest": ("near", "far"), "south": ("middle", "far"), "southeast": ("far", "far"), "none": ("near", "near"), "forget": ("near", "near"),
}


def place(base: Column, layer: Column, side: str, offset: int | Column) -> Column:
    """Where a layer begins along one axis: from the near side, from the middle (halves towards zero), or from the far side."""
    gap = base - layer
    if side == "middle":
        return F.when(gap < 0, -F.floor(-gap / 2)).otherwise(F.floor(gap / 2)).cast("int") + offset
    return gap - offset if side == "far" else F.lit(0) + offset


def placed(base: DataFrame, layer: DataFrame, gravity: str, dx: int = 0, dy: int = 0) -> DataFrame:
    """``layer`` moved to where it lies over ``base``; only the sizes of the pictures are joined."""
    across, down = GRAVITIES[gravity]
    if (across, down) == ("near", "near"):
        return layer.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    size = lambda px, w, h: px.groupBy("image_id").agg((F.max("x") + 1).alias(w), (F.max("y") + 1).alias(h))
    both = size(base, "bw", "bh").join(size(layer, "lw", "lh"), "image_id")
    at = both.select("image_id", place(F.col("bw"), F.col("lw"), across, dx).alias("px"), place(F.col("bh"), F.col("lh"), down, dy).alias("py"))
    return layer.join(at, "image_id").withColumns({"x": F.col("x") + F.col("px"), "y": F.col("y") + F.col("py")}).select(*layer.columns)


def compose(pictures: list[DataFrame], rule: str, gravity: str = "northwest", dx: int = 0, dy: int = 0) -> DataFrame:
    """Two to four pictures: a base and a layer; a base, a shape and the colours that tint it; or a base, a shape, and colours for
    the shape and for its negative, which goes under it."""
    base, shape, *colours = pictures
    if len(colours) > 2:
        raise ValueError("a base and one to three pictures over it")
    if colours:
        inked = composite(shape, colours[0], "tint")
        shape = composite(composite(negate(shape), colours[1], "tint"), inked, "over") if len(colours) == 2 else inked
    return composite(base, placed(base, shape, gravity, dx, dy), rule)


def composite(base: DataFrame, layer: DataFrame, rule: str, dx: int = 0, dy: int = 0) -> DataFrame:
    """``layer`` over ``base`` (pixel rows with the same image_id) with its corner at (dx, dy).

    One join on (image_id, x, y), which is shuffled by the picture and never by colour; all rules stay in
    generated code: those with many steps keep each of them as a column.
    """
    moved = layer.select(F.col("image_id"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *(F.col(c).alias(f"s{c}") for c in "rgba"))
    if rule == "copy_opacity":  # a layer that is opaque everywhere has no alpha to copy
        masks = layer.groupBy("image_id").agg((F.min("a") == 255).cast("int").alias("smask"))
        moved = moved.join(masks, "image_id")
    rows = base.join(moved, ["image_id", "x", "y"], "left")
    here = F.col("sa").isNotNull()
    s = {c: F.col(f"s{c}") / 255.0 for c in "rgba"}
    d = {c: F.col(c) / 255.0 for c in "rgba"}
    if rule == "tint":
        # Where the layer doesn't reach it is opaque black.
        sa, sc = F.coalesce("sa", F.lit(255)), {c: F.coalesce(f"s{c}", F.lit(0)) for c in "rgb"}
        level = F.floor((0.212656 * F.col("r") + 0.715158 * F.col("g") + 0.072186 * F.col("b")) + 0.5).cast("int")
        a = _times(_times(sa, F.col("a")), 255 - level)
        out = {c: _if(a != 0, sc[c], 0) for c in "rgb"} | {"a": a}
        return rows.select("image_id", "x", "y", *(out[c].cast("int").alias(c) for c in "rgba"))
    if rule == "dst_in":
        la = F.coalesce("sa", F.lit(0))
        a = F.when(la == 255, F.col("a")).when(la == 0, 0).otherwise(255 - quantum_byte(1 - d["a"] * (la / 255.0)))
        out = {c: F.when(la == 255, F.col(c)).when(a == 0, 0).otherwise(F.col(c)) for c in "rgb"} | {"a": a}
        return rows.select("image_id", "x", "y", *(out[c].cast("int").alias(c) for c in "rgba"))
    if rule in PIXELS:
        kept, blend = PIXELS[rule]
        if rule == "copy_opacity":
            s["mask"] = F.col("smask")
        if isinstance(blend, Hcl):
            rows, res = blend.prepare(rows, s, d)
        else:
            res = blend(s, d)
        a = 255 - quantum_byte(1 - res["a"])
        out = {c: _if(a == 0, 0, quantum_byte(res[c])) for c in "rgb"} | {"a": a}
        outside = {c: F.col(c) if kept else F.lit(0) for c in "rgba"}
        use = here
    else:
        if rule in SEPARABLE:
            mix = SEPARABLE[rule]
            colour = lambda sc, sa, dc, da: sc * sa * (1 - da) + dc * da * (1 - sa) + sa * da * mix(sc, dc)
            alpha = union_of
        else:
            colour, alpha = WITH[rule]
        ra = F.least(F.lit(1.0), F.greatest(F.lit(0.0), alpha(s["a"], d["a"])))
        out = {c: _if(ra > 0, quantum_byte(colour(s[c], s["a"], d[c], d["a"]) / F.when(ra > 0, ra)), 0) for c in "rgb"} | {"a": 255 - quantum_byte(1 - ra)}
        outside = {c: F.col(c) for c in "rgba"}
        use = here & (F.col("sa") > 0)
    return rows.select("image_id", "x", "y", *(_if(use, out[c], outside[c]).cast("int").alias(c) for c in "rgba"))
