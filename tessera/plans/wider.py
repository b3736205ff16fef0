"""More registered queries, each beside its SQL: colour formats, planes, brushes, placement, layouts, URLs, names, responses."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import media, names, pixels, sql, url
from tessera.operators import brush, composite, layout, palette, transform
from tessera.plans import oracles as O
from tessera.plans.queries import _canvas, _few_colours, _gray, _layer, _pages, _rgba
from tessera.sources import files, raster

_FORMATS = ("rgb888", "rgba8888", "bgr888", "bgra8888", "gray8", "grayalpha88", "rgb565", "rgb555", "rgba5551")


def pixel_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel as the bytes of every format, in hexadecimal."""
    channels = [F.col(c) for c in "rgba"]
    return _rgba(spark, sf_dir).select("image_id", "x", "y", *(F.lower(F.hex(pixels.TO_BYTES[k](*channels))).alias(k) for k in _FORMATS))


def pixels_of_bytes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Pixels through the bytes of a format and back."""
    return pixels.from_bytes(pixels.to_bytes(_rgba(spark, sf_dir), kind), kind)


def palette_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = palette.slice_of("pico8")
    return palette.expand(palette.quantise(_rgba(spark, sf_dir), colours), colours)


def quantise_named(spark: SparkSession, sf_dir: str, spec: str) -> DataFrame:
    return palette.quantise(_rgba(spark, sf_dir), palette.slice_of(spec))


def palette_kept(spark: SparkSession, sf_dir: str, spec: str, keep: int) -> DataFrame:
    """The limited palette of each picture, in the palette's order."""
    return palette.most_voted(_rgba(spark, sf_dir), palette.slice_of(spec), keep).select("image_id", "idx")


def chr_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 levels of a picture as four tiles, two in a row."""
    packed = _gray(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda p: F.lpad(F.hex(p["v"].cast("long")), 2, "0")), ""))
    return palette.chr_indices(packed.select("image_id", F.lit(16).alias("width"), data.alias("data")))


def _odd(px: DataFrame) -> DataFrame:
    """Pictures of 3 by 3, so that planes have spare rows."""
    return transform.crop(px, 0, 0, 3, 3)


def yuv_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.yuv420(_odd(_rgba(spark, sf_dir)))[0]


def yuv_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.yuv420(_odd(_rgba(spark, sf_dir)))[1]


def yuv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.of_yuv420(*pixels.yuv420(_rgba(spark, sf_dir)))


def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.forget(transform.crop(_rgba(spark, sf_dir), 0, 0, 3, 2))


def negate_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.negate(_gray(spark, sf_dir))


def crop_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.crop(palette.quantise(_rgba(spark, sf_dir), palette.slice_of("cga")), 1, 0, 2, 3)


def resize_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.resize(palette.quantise(_rgba(spark, sf_dir), palette.slice_of("cga")), 6, 3)


def brush_line(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return brush.gradient(_canvas(spark, sf_dir), (255, 0, 0, 128), (0, 0, 255, 255), **how)


def brush_circle(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return brush.radial_gradient(_canvas(spark, sf_dir), *brush.pair((255, 136, 0, 255)), **how)


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.crop(_layer(spark, sf_dir), 0, 0, 3, 1)


def composite_placed(spark: SparkSession, sf_dir: str, gravity: str) -> DataFrame:
    """A smaller layer, by gravity."""
    return composite.compose([_rgba(spark, sf_dir), _small(spark, sf_dir)], "over", gravity, 1, 0)


def composite_of(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The next pictures as the shape and its colours."""
    px = _rgba(spark, sf_dir)
    others = [px.withColumn("image_id", F.col("image_id") - k) for k in range(1, n)]
    return composite.compose([px, *others], "multiply")


def resize_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = transform.crop(_rgba(spark, sf_dir), 0, 0, 4, 2).withColumns({c: F.floor(F.col(c) / 100).cast("int") * 7 for c in "rgba"})
    return transform.resize_pad(px, 6, 6)


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = raster.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select("p_partkey", (k % 20).cast("int").alias("x"), (k % 13).cast("int").alias("y"), (1 + k % 9).cast("int").alias("w"), (1 + k % 5).cast("int").alias("h"))


def cuts_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.moved_cuts(_cuts(spark, sf_dir), -6, -4, F.lit(12), F.lit(9))


def cuts_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.scaled_cuts(_cuts(spark, sf_dir), (F.lit(30), F.lit(20)), (F.lit(7), F.lit(40)))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 4 by 4, nine to a group, with rooms for others of up to 6 by 7."""
    ids = raster.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"))
    return ids.select(F.floor(F.col("seq") / 9).cast("long").alias("group_id"), "seq", F.lit(4).alias("w"), F.lit(4).alias("h"))


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.grid(_sizes(spark, sf_dir), None, quantum=5, gap=1, rows=2)


def grid_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.painted(_rgba(spark, sf_dir), layout.grid(_sizes(spark, sf_dir), 3, quantum=7, gap=2), gravity="southeast")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = raster.table(spark, sf_dir, "pages").select("page_id", url.parse(F.col("url")).alias("u"))
    return parts.select("page_id", *(F.col(f"u.{c}").alias(c) for c in ("scheme", "authority", "host", "port", "path", "query")))


def url_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of several kinds, seen from every page."""
    k = (F.col("page_id") % 6 + 1).cast("int")
    reference = F.element_at(F.array(*map(F.lit, ("x", "?q=1", "/a/b/../c/./d", "//other.org/p/..", "HTTPS://z.net/./k", "s/./t/"))), k)
    pages = raster.table(spark, sf_dir, "pages")
    return pages.select("page_id", url.resolve(url.parse(F.col("url")), url.parse(reference)).alias("target"))


def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = raster.table(spark, sf_dir, "pages").select("page_id", F.posexplode(url.params(url.parse(F.col("url"))["query"])).alias("seq", "p"))
    return pages.select("page_id", "seq", "p.name", "p.value")


def percent_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts (null: empty) as paths, and what comes back; digests, since they are long."""
    docs = raster.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", "text", url.percent_encode_path(F.col("text")).alias("path"))
    return docs.select("doc_id", F.length("path").alias("n"), F.md5("path").alias("path_md5"), F.md5(url.percent_decode(F.col("path"))).alias("text_md5"))


def sizes_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, shares and rectangles made of the parts' numbers, some of them broken."""
    part = raster.table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("s"))
    form = lambda *values: F.element_at(F.array(*values), (F.col("p_partkey") % len(values) + 1).cast("int"))
    k, s, t = F.col("k"), F.col("s"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    rows = part.select("p_partkey", form(k, t("+", k), t("-", k), t(k, "a"), t("++", k)).alias("n"), form(t(k, "x", s), t(k, "X+", s), t(k, "x"), t("0x", s)).alias("wh"), form(t(s, "%"), t(s, "pct"), s).alias("share"), form(t(k, ",", s, ",3,4"), t(k, ",", s, ",3"), t("-", k, ",+", s, ",1,0")).alias("box"), form(t(k, "x", s), t(k, "x", s, "+1-2"), t(k, "x", s, " 7 8"), t(k, "x", s, "+1")).alias("crop"))
    size, box, crop = names.size(F.col("wh")), names.rect(F.col("box")), names.crop_geometry(F.col("crop"))
    return rows.select("p_partkey", names.whole_number(F.col("n")).alias("n"), size["width"].alias("w"), size["height"].alias("h"), names.percent(F.col("share")).alias("share"), box["x"].alias("bx"), box["width"].alias("bw"), crop["x"].alias("cx"), crop["y"].alias("cy"), crop["height"].alias("ch"))


def colours_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the parts' names, shares of grey and hexadecimal forms as colours."""
    part = raster.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    word = F.element_at(F.array(F.lit("Tomato"), F.concat(F.lit("gray"), (k % 120).cast("string")), F.concat(F.lit("#"), F.lpad(F.hex(k), 6, "0")), F.concat(F.lit("#"), F.lpad(F.hex(k % 4096), 3, "0"), F.lit("8")), F.lit("nosuch"), F.lit("grey"), F.lit("none")), (k % 7 + 1).cast("int"))
    return part.select("p_partkey", names.colour(word).alias("argb"))


def formats_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by the paths of the pages, and by content types."""
    pages = _pages(spark, sf_dir)
    ending = F.element_at(F.array(*map(F.lit, (".PNG", ".six", ".jpeg", "/x.y/z", ".tar.tpic", ""))), (F.col("page_id") % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("image/PNG; q=1", " image/tga", "text/html", "image/vnd.zbrush.pcx"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = pages.select("page_id", media.format_of_path(F.concat("path", ending)).alias("by_path"), media.format_of_content_type(kind).alias("by_type"))
    return rows.select("*", media.extension_of(F.col("by_type")).alias("extension"), media.content_type_of(F.col("by_path")).alias("content_type"), media.default_format(F.col("by_path")).alias("default"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests gated by method, answered by kind of failure, refused by size, and their headers."""
    events = raster.table(spark, sf_dir, "events").select("event_id", "event_type")
    k = F.col("event_id")
    of = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (k % len(v) + 1).cast("int"))
    headers = media.response_headers(of("image/png", "image/x-zcis", "text/x-ansi"), F.col("event_type"), k % 5, of("gzip", "identity"), of("identity", "cobs", "hex", "identity"))
    rows = events.select("event_id", media.allowed_method(of("GET", "HEAD", "PUT", None)).alias("allowed"), media.status_of(of("not_found", "upstream", None, "io", "timeout")).alias("status"), media.too_large((k % 3000).cast("int"), (k % 700).cast("int"), F.when(k % 3 == 0, k % 500).otherwise(0), 2048, 400).alias("refused"), headers.alias("h"))
    return rows.select("event_id", "allowed", "status", "refused", F.col("h")["content-disposition"].alias("disposition"), F.col("h")["vary"].alias("vary"), F.col("h")["content-encoding"].alias("encoding"), F.col("h")["x-encoding"].alias("x_encoding"))


def entries_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as cache entries and back; every third entry is cut short by a byte after its name."""
    docs = raster.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    framed = docs.select("doc_id", media.frame(F.lit("image/x-zcis"), F.concat(F.lit("näme "), F.col("source")), F.lit("base64"), F.encode("text", "UTF-8")).alias("entry"), (17 + 5 + F.length("source") + 3).alias("head"))
    framed = framed.withColumn("entry", F.when(F.col("doc_id") % 3 == 0, F.substring("entry", F.lit(1), F.col("head"))).otherwise(F.col("entry")))
    found = framed.select("doc_id", F.octet_length("entry").alias("n"), media.unframe(F.col("entry")).alias("e"))
    return found.select("doc_id", "n", "e.filename", "e.encoding", F.md5("e.body").alias("body_md5"))


def netpbm_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey pictures written as files in a column and read back."""
    written = files.netpbm_gray_file(_gray(spark, sf_dir))
    return files.netpbm_pixels(written.select(F.col("image_id").cast("string").alias("path"), "content"))


def blur_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma planes of 4 by 4, of pictures of 8 by 8 in the colours of their levels, blurred for a size of 1."""
    px = _gray(spark, sf_dir).select("image_id", "x", "y", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), (F.col("v") % 100).alias("b"), F.lit(255).alias("a"))
    return transform.blur_yuv420(*pixels.yuv420(px), 1)[1]


def resize_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.of_yuv420(*transform.resize_yuv420(*pixels.yuv420(_rgba(spark, sf_dir)), 6, 2))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions called by name in Spark SQL."""
    sql.register(spark)
    return spark.sql("SELECT image_id, x, y, gray8(r, g, b) AS gray, rgb565(r, g, b) AS packed, argb(r, g, b, a) AS argb, color_distance(r, g, b, 0, 170, 85) AS distance, base62_pair(image_id % 3844) AS pair, cache_key(CAST(image_id AS STRING)) AS key FROM {px}", px=_rgba(spark, sf_dir))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.draw_counts(_few_colours(spark, sf_dir))


def cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = _cuts(spark, sf_dir).withColumn("image_id", F.col("p_partkey") % 50).withColumnRenamed("p_partkey", "seq")
    lines = layout.index_lines(cuts)
    return lines.select("image_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


# ---- the same in SQL

_PX, _GRAY, _CANVAS = O._PX, O._GRAY, O._CANVAS
_Y8 = "CAST(floor(0.212656e0 * r + 0.715158e0 * g + 0.072186e0 * b + 0.5) AS INT)"
_555 = f"({O._N5.format(c='r')} * 1024 + {O._N5.format(c='g')} * 32 + {O._N5.format(c='b')})"
_WIDE5, _WIDE6 = "(({v}) * 8 + ({v}) // 4)", "(({v}) * 4 + ({v}) // 16)"


def _hex(*values: str) -> str:
    return "printf('" + "%02x" * len(values) + "', " + ", ".join(values) + ")"


def _word(v: str) -> str:
    return _hex(f"({v}) % 256", f"({v}) // 256")


_BYTES_SQL = {
    "rgb888": _hex("r", "g", "b"), "rgba8888": _hex("r", "g", "b", "a"), "bgr888": _hex("b", "g", "r"), "bgra8888": _hex("b", "g", "r", "a"), "gray8": _hex(_Y8), "grayalpha88": _hex(_Y8, "a"),
    "rgb565": _word(O._565), "rgb555": _word(_555), "rgba5551": _word(O._5551),
}


def _back(kind: str) -> str:
    five, six = (lambda c: _WIDE5.format(v=O._N5.format(c=c))), (lambda c: _WIDE6.format(v=O._N6.format(c=c)))
    r, g, b, a = {
        "rgb888": ("r", "g", "b", "255"), "bgr888": ("r", "g", "b", "255"), "rgba8888": ("r", "g", "b", "a"), "bgra8888": ("r", "g", "b", "a"), "gray8": (_Y8, _Y8, _Y8, "255"), "grayalpha88": (_Y8, _Y8, _Y8, "a"),
        "rgb565": (five("r"), six("g"), five("b"), "255"), "rgb555": (five("r"), five("g"), five("b"), "255"), "rgba5551": (five("r"), five("g"), five("b"), "CASE WHEN a >= 128 THEN 255 ELSE 0 END"),
    }[kind]
    return f"WITH {_PX} SELECT image_id, x, y, CAST({r} AS INT) AS r, CAST({g} AS INT) AS g, CAST({b} AS INT) AS b, CAST({a} AS INT) AS a FROM px"


def _colours(spec: str) -> str:
    return "pal(i, pr, pg, pb) AS (VALUES " + ", ".join(f"({k}, {c >> 16}, {c >> 8 & 255}, {c & 255})" for k, c in enumerate(palette.slice_of(spec))) + ")"


def _fit(source: str) -> str:
    d = O._DISTANCE.format(r="r", g="g", b="b")
    return f"SELECT image_id, x, y, arg_min(i, ({d}) * 256 + i) AS idx FROM {source}, pal GROUP BY image_id, x, y"


_ODD = "od AS (SELECT * FROM px WHERE x < 3 AND y < 3)"
_LUMA = "((77 * r + 150 * g + 29 * b + 128) >> 8)"


def _planes(source: str, last: int) -> str:
    """Luma and chroma of pictures whose sides end at ``last``; clamped places stand for what is spare."""
    side = last + 1 + (last + 1) % 2
    avg = lambda c: f"(((({c}00 + {c}01 + 1) >> 1) + (({c}10 + {c}11 + 1) >> 1) + 1) >> 1)"
    at = lambda c, dx, dy: f"max(CASE WHEN q.x = least({last}, 2 * i.x + {dx}) AND q.y = least({last}, 2 * i.y + {dy}) THEN q.{c} END) AS {c}{dx}{dy}"
    corners = ", ".join(at(c, dx, dy) for c in "rgb" for dx in (0, 1) for dy in (0, 1))
    return (
        f"lu AS (SELECT p.image_id, i.x, i.y, {_LUMA} AS v FROM {source} p, (SELECT CAST(k % {side} AS INT) AS x, CAST(k // {side} AS INT) AS y FROM (SELECT unnest(range({side * side})) AS k)) i WHERE p.x = least({last}, i.x) AND p.y = least({last}, i.y)), "
        f"co AS (SELECT q.image_id, i.x, i.y, {corners} FROM {source} q, (SELECT CAST(k % {side // 2} AS INT) AS x, CAST(k // {side // 2} AS INT) AS y FROM (SELECT unnest(range({side * side // 4})) AS k)) i GROUP BY 1, 2, 3), "
        f"me AS (SELECT image_id, x, y, {avg('r')} AS r, {avg('g')} AS g, {avg('b')} AS b FROM co), "
        "ch AS (SELECT image_id, x, y, (127 * b - 84 * g - 43 * r + 32896) >> 8 AS u, (127 * r - 107 * g - 20 * b + 32896) >> 8 AS v FROM me)"
    )


def _line(x1: str, y1: str, x2: str, y2: str) -> str:
    """A gradient along a line given by its ends in w and h, the last column and row."""
    return (
        f"WITH {_CANVAS}, e AS (SELECT image_id, x, y, CAST(w - 1 AS DOUBLE) AS w, CAST(h - 1 AS DOUBLE) AS h FROM cv), "
        f"f AS (SELECT *, {x1} AS a0, {y1} AS b0, {x2} AS a1, {y2} AS b1 FROM e), "
        "g AS (SELECT *, CASE WHEN a0 = a1 AND b0 = b1 THEN 0.0e0 ELSE a0 END AS x1, CASE WHEN a0 = a1 AND b0 = b1 THEN 0.0e0 ELSE b0 END AS y1, CASE WHEN a0 = a1 AND b0 = b1 THEN w ELSE a1 END AS x2, CASE WHEN a0 = a1 AND b0 = b1 THEN h ELSE b1 END AS y2 FROM f), "
        "k AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM g), "
        "s AS (SELECT image_id, x, y, CASE WHEN dx * dx + dy * dy > 0 THEN least(1.0e0, greatest(0.0e0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) ELSE 0.0e0 END AS t FROM k) "
        f"SELECT image_id, x, y, {O._mix((255, 0, 0, 128), (0, 0, 255, 255))} FROM s"
    )


def _circle(rx: str, ry: str, cx: str = "hw", cy: str = "hh") -> str:
    return (
        f"WITH {_CANVAS}, e AS (SELECT image_id, x, y, (w - 1) / 2.0e0 AS hw, (h - 1) / 2.0e0 AS hh FROM cv), f AS (SELECT *, CAST({rx} AS DOUBLE) AS rx, CAST({ry} AS DOUBLE) AS ry, x - {cx} AS ox, y - {cy} AS oy FROM e), "
        "g AS (SELECT *, CASE WHEN rx > 0 THEN ox / rx WHEN ox = 0 THEN 0.0e0 ELSE 1.0e0 END AS ex, CASE WHEN ry > 0 THEN oy / ry WHEN oy = 0 THEN 0.0e0 ELSE 1.0e0 END AS ey FROM f), "
        "s AS (SELECT image_id, x, y, least(1.0e0, sqrt(ex * ex + ey * ey)) AS t FROM g) "
        f"SELECT image_id, x, y, {O._mix((255, 136, 0, 255), (0, 0, 0, 255))} FROM s"
    )


def _over(layer: str) -> str:
    """``over`` of a layer (image_id, x, y, lr, lg, lb, la) that is in place."""
    head = f"j AS (SELECT px.*, lr, lg, lb, la, {', '.join(f'l{c} / 255.0e0 AS s{c}, px.{c} / 255.0e0 AS d{c}' for c in 'rgba')} FROM px LEFT JOIN {layer} USING (image_id, x, y))"
    ra = f"least(1.0, greatest(0.0, {O._UNION}))"
    mixed = lambda c: f"CASE WHEN sa >= 1 THEN s{c} ELSE s{c} * sa + d{c} * da * (1 - sa) END"
    out = ", ".join(f"CAST(CASE WHEN la > 0 THEN CASE WHEN {ra} > 0 THEN {O._q(f'({mixed(c)}) / {ra}')} ELSE 0 END ELSE {c} END AS INT) AS {c}" for c in "rgb")
    return f"{head} SELECT image_id, x, y, {out}, CAST(CASE WHEN la > 0 THEN 255 - {O._q(f'1 - {ra}')} ELSE a END AS INT) AS a FROM j"


def _placed(dx: int, dy: int) -> str:
    alpha = "CASE WHEN image_id % 5 = 0 THEN 0 WHEN image_id % 7 = 0 THEN 255 ELSE a END"
    return f"WITH {_PX}, ly AS (SELECT image_id - 1 AS image_id, x + {dx} AS x, y + {dy} AS y, r AS lr, g AS lg, b AS lb, {alpha} AS la FROM px WHERE x < 3 AND y < 1), " + _over("ly")


def _tinted(name: str, base: str, colour: str) -> str:
    """Pixels of ``base`` inked with those of ``colour``; where there are none the ink is opaque black."""
    times = lambda a, b: f"(({a} * {b} + 127) // 255)"
    level = "CAST(floor((0.212656e0 * p.r + 0.715158e0 * p.g + 0.072186e0 * p.b) + 0.5) AS INT)"
    a = times(times("coalesce(k.a, 255)", "p.a"), f"(255 - {level})")
    return f"{name} AS (SELECT p.image_id, p.x, p.y, " + ", ".join(f"CAST(CASE WHEN {a} <> 0 THEN coalesce(k.{c}, 0) ELSE 0 END AS INT) AS {c}" for c in "rgb") + f", CAST({a} AS INT) AS a FROM {base} p LEFT JOIN {colour} k USING (image_id, x, y))"


def _multiply(layer: str) -> str:
    ra = f"least(1.0, greatest(0.0, {O._UNION}))"
    mixed = lambda c: f"s{c} * sa * (1 - da) + d{c} * da * (1 - sa) + sa * da * (s{c} * d{c})"
    out = ", ".join(f"CAST(CASE WHEN la > 0 THEN CASE WHEN {ra} > 0 THEN {O._q(f'({mixed(c)}) / {ra}')} ELSE 0 END ELSE {c} END AS INT) AS {c}" for c in "rgb")
    head = f"jj AS (SELECT px.*, l.a AS la, {', '.join(f'l.{c} / 255.0e0 AS s{c}, px.{c} / 255.0e0 AS d{c}' for c in 'rgba')} FROM px LEFT JOIN {layer} l USING (image_id, x, y))"
    return f"{head} SELECT image_id, x, y, {out}, CAST(CASE WHEN la > 0 THEN 255 - {O._q(f'1 - {ra}')} ELSE a END AS INT) AS a FROM jj"


def _shifted(k: int) -> str:
    return f"n{k} AS (SELECT image_id - {k} AS image_id, x, y, r, g, b, a FROM px)"


def _over_tables(base: str, layer: str) -> str:
    """``over`` as a table, of a base and a layer that both cover a picture."""
    ra = f"least(1.0, greatest(0.0, {O._UNION}))"
    mixed = lambda c: f"CASE WHEN sa >= 1 THEN s{c} ELSE s{c} * sa + d{c} * da * (1 - sa) END"
    out = ", ".join(f"CAST(CASE WHEN la > 0 THEN CASE WHEN {ra} > 0 THEN {O._q(f'({mixed(c)}) / {ra}')} ELSE 0 END ELSE {c} END AS INT) AS {c}" for c in "rgb")
    join = f"SELECT p.*, l.a AS la, {', '.join(f'l.{c} / 255.0e0 AS s{c}, p.{c} / 255.0e0 AS d{c}' for c in 'rgba')} FROM {base} p LEFT JOIN {layer} l USING (image_id, x, y)"
    return f"SELECT image_id, x, y, {out}, CAST(CASE WHEN la > 0 THEN 255 - {O._q(f'1 - {ra}')} ELSE a END AS INT) AS a FROM ({join})"


_GRID = "sz AS (SELECT vec_id AS seq, vec_id // 9 AS group_id, row_number() OVER (PARTITION BY vec_id // 9 ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY vec_id // 9) AS n FROM embeddings)"
_URL = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"


def _url(k: int) -> str:
    return f"regexp_extract(url, {_URL}, {k})"


_CUTS = "ct AS (SELECT p_partkey, p_partkey % 20 AS x, p_partkey % 13 AS y, 1 + p_partkey % 9 AS w, 1 + p_partkey % 5 AS h FROM part)"
_PICK = "list_extract([{}], CAST({} AS INT) + 1)"

QUERIES = {
    f.__name__: f
    for f in (
        pixel_bytes, palette_expanded, chr_tiles, yuv_luma, yuv_chroma, yuv_round_trip, forgotten, negate_gray, crop_palette, resize_palette, resize_pad, cuts_moved, cuts_scaled, grid_rows, grid_painted,
        url_parts, url_resolved, url_params, percent_round_trip, sizes_parsed, colours_named, formats_found, responses, entries_framed, netpbm_gray, blur_chroma, resize_planes, sql_functions, draws, cut_lines,
    )
}
QUERIES |= {f"pixels_of_{k}": partial(pixels_of_bytes, kind=k) for k in _FORMATS}
QUERIES |= {f"quantise_{n}": partial(quantise_named, spec=s) for n, s in (("nes", "nes"), ("tic80_bank", "tic80:2..5,7"), ("world", "world"), ("mario", "mario"), ("kokobatoru", "kokobatoru"), ("cgagraphics", "cgagraphics"), ("pico8", "pico8"))}
QUERIES |= {"palette_kept": partial(palette_kept, spec="nes", keep=4)}
QUERIES |= {f"gradient_{d}": partial(brush_line, direction=d) for d in brush._DIRECTIONS} | {"gradient_angle": partial(brush_line, angle=90.0)}
QUERIES |= {f"radial_{e}": partial(brush_circle, extent=e) for e in ("minimum", "diagonal", "ellipse")} | {"radial_at": partial(brush_circle, center=(2.0, 1.5), radii=(3.0, 0.0))}
QUERIES |= {f"place_{g}": partial(composite_placed, gravity=g) for g in ("northwest", "north", "center", "southeast", "west")}
QUERIES |= {"composite_three": partial(composite_of, n=3), "composite_four": partial(composite_of, n=4)}

ORACLES = {
    "pixel_bytes": f"WITH {_PX} SELECT image_id, x, y, " + ", ".join(f"{v} AS {k}" for k, v in _BYTES_SQL.items()) + " FROM px",
    "palette_expanded": f"WITH {_PX}, {_colours('pico8')}, fi AS ({_fit('px')}) SELECT image_id, x, y, pr AS r, pg AS g, pb AS b, 255 AS a, idx FROM fi JOIN pal ON i = idx",
    "palette_kept": f"WITH {_PX}, {_colours('nes')}, fi AS ({_fit('px')}), vo AS (SELECT image_id, idx, count(*) AS n FROM fi GROUP BY ALL), en AS (SELECT im.image_id, CAST(pal.i AS INT) AS idx, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM px) im CROSS JOIN pal LEFT JOIN vo ON vo.image_id = im.image_id AND vo.idx = pal.i) "
    "SELECT image_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, idx) AS k FROM en) WHERE k <= 4",
    "chr_tiles": f"WITH {_GRAY}, t AS (SELECT image_id, (y * 8 + x) // 16 AS tile, (y * 8 + x) % 16 AS at, v FROM gr), r AS (SELECT a.image_id, a.tile, a.at AS row, a.v AS low, b.v AS high FROM t a JOIN t b ON a.image_id = b.image_id AND a.tile = b.tile AND b.at = a.at + 8) "
    "SELECT image_id, CAST(tile % 2 * 8 + c AS INT) AS x, CAST(tile // 2 * 8 + row AS INT) AS y, CAST((low >> (7 - c)) & 1 AS INT) + 2 * CAST((high >> (7 - c)) & 1 AS INT) AS idx FROM r, (SELECT CAST(unnest(range(8)) AS INT) AS c)",
    "yuv_luma": f"WITH {_PX}, {_ODD}, {_planes('od', 2)} SELECT * FROM lu",
    "yuv_chroma": f"WITH {_PX}, {_ODD}, {_planes('od', 2)} SELECT * FROM ch",
    "yuv_round_trip": f"WITH {_PX}, {_planes('px', 3)} SELECT lu.image_id, lu.x, lu.y, CAST(least(255, greatest(0, lu.v + floor(1436 * (ch.v - 128) / 1024.0))) AS INT) AS r, CAST(least(255, greatest(0, lu.v - floor((352 * (u - 128) + 731 * (ch.v - 128)) / 1024.0))) AS INT) AS g, "
    "CAST(least(255, greatest(0, lu.v + floor(1815 * (u - 128) / 1024.0))) AS INT) AS b, 255 AS a FROM lu JOIN ch ON lu.image_id = ch.image_id AND lu.x // 2 = ch.x AND lu.y // 2 = ch.y",
    "forgotten": "SELECT vec_id AS image_id, 3 AS width, 2 AS height FROM embeddings",
    "negate_gray": f"WITH {_GRAY} SELECT image_id, x, y, 255 - v AS v FROM gr",
    "crop_palette": f"WITH {_PX}, {_colours('cga')}, fi AS ({_fit('px')}) SELECT image_id, x - 1 AS x, y, idx FROM fi WHERE x BETWEEN 1 AND 2 AND y < 3",
    "resize_palette": f"WITH {_PX}, {_colours('cga')}, fi AS ({_fit('px')}) SELECT image_id, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, idx FROM fi, (SELECT unnest(range(6)) AS tx), (SELECT unnest(range(3)) AS ty) WHERE x = tx * 4 // 6 AND y = ty * 4 // 3",
    "resize_pad": f"WITH {_PX}, ev AS (SELECT image_id, x, y, r // 100 * 7 AS r, g // 100 * 7 AS g, b // 100 * 7 AS b, a // 100 * 7 AS a FROM px WHERE y < 2), "
    "fi AS (SELECT image_id, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, r, g, b, a FROM ev, (SELECT unnest(range(6)) AS tx), (SELECT unnest(range(3)) AS ty) WHERE x = tx * 4 // 6 AND y = ty * 2 // 3), "
    "ri AS (SELECT * FROM fi WHERE x = 0 OR y = 0 OR x = 5 OR y = 2), so AS (SELECT image_id, list_sort(list(r)) AS r, list_sort(list(g)) AS g, list_sort(list(b)) AS b, list_sort(list(a)) AS a FROM ri GROUP BY 1), "
    "md AS (SELECT image_id, " + ", ".join(f"{c}[len({c}) // 2 + 1] AS m{c}" for c in "rgba") + " FROM so), "
    "gd AS (SELECT ri.image_id, any_value(mr) AS mr, any_value(mg) AS mg, any_value(mb) AS mb, any_value(ma) AS ma FROM ri JOIN md USING (image_id) GROUP BY 1 HAVING sum(CASE WHEN abs(r - mr) <= 8 AND abs(g - mg) <= 8 AND abs(b - mb) <= 8 AND abs(a - ma) <= 8 THEN 1 ELSE 0 END) * 10 >= count(*) * 9), "
    "fr AS (SELECT vec_id AS image_id, CAST(k % 6 AS INT) AS x, CAST(k // 6 AS INT) AS y FROM embeddings, (SELECT unnest(range(36)) AS k)) "
    "SELECT fr.image_id, fr.x, fr.y, " + ", ".join(f"CAST(coalesce(fi.{c}, m{c}, 0) AS INT) AS {c}" for c in "rgba") + " FROM fr LEFT JOIN fi ON fi.image_id = fr.image_id AND fi.x = fr.x AND fi.y + 1 = fr.y LEFT JOIN gd ON gd.image_id = fr.image_id",
    "cuts_moved": f"WITH {_CUTS}, m AS (SELECT p_partkey, greatest(x - 6, 0) AS x, greatest(y - 4, 0) AS y, least(x - 6 + w, 12) AS x1, least(y - 4 + h, 9) AS y1 FROM ct) SELECT p_partkey, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x1 - x AS INT) AS w, CAST(y1 - y AS INT) AS h FROM m WHERE x1 > x AND y1 > y",
    "cuts_scaled": f"WITH {_CUTS}, s AS (SELECT p_partkey, x * 7 // 30 AS x, y * 40 // 20 AS y, greatest(1, (x + w) * 7 // 30 - x * 7 // 30) AS w, greatest(1, (y + h) * 40 // 20 - y * 40 // 20) AS h FROM ct), "
    "m AS (SELECT p_partkey, x, y, least(x + w, 7) AS x1, least(y + h, 40) AS y1 FROM s) SELECT p_partkey, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x1 - x AS INT) AS w, CAST(y1 - y AS INT) AS h FROM m WHERE x1 > x AND y1 > y",
    "grid_rows": f"WITH {_GRID} SELECT group_id, seq, 4 AS w, 4 AS h, 5 AS cell_w, 5 AS cell_h, CAST(pos % CAST(ceil(n / 2.0) AS INT) * 6 AS INT) AS px, CAST(pos // CAST(ceil(n / 2.0) AS INT) * 6 AS INT) AS py FROM sz",
    "grid_painted": f"WITH {_PX}, {_GRID} SELECT group_id, CAST(x + pos % 3 * 9 + 3 AS INT) AS x, CAST(y + pos // 3 * 9 + 3 AS INT) AS y, r, g, b, a FROM px JOIN sz ON seq = image_id",
    "url_parts": f"SELECT page_id, lower({_url(1)}) AS scheme, {_url(2)} AS authority, regexp_replace({_url(2)}, ':[0-9]*$', '') AS host, regexp_extract({_url(2)}, ':([0-9]*)$', 1) AS port, {_url(3)} AS path, CASE WHEN contains(split_part(url, '#', 1), '?') THEN {_url(4)} END AS query FROM pages",
    "url_resolved": f"WITH u AS (SELECT page_id, lower({_url(1)}) || '://' || {_url(2)} AS site, lower({_url(1)}) AS scheme, {_url(3)} AS path FROM pages), v AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS folder FROM u) "
    "SELECT page_id, CASE page_id % 6 WHEN 0 THEN site || folder || 'x' WHEN 1 THEN site || path || '?q=1' WHEN 2 THEN site || '/a/c/d' WHEN 3 THEN scheme || '://other.org/' WHEN 4 THEN 'https://z.net/k' ELSE site || folder || 's/t/' END AS target FROM v",
    "url_params": f"WITH u AS (SELECT page_id, string_split({_url(4)}, '&') AS items FROM pages WHERE {_url(4)} <> ''), v AS (SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS seq FROM u) "
    "SELECT page_id, CAST(seq AS INT) AS seq, url_decode(replace(split_part(item, '=', 1), '+', ' ')) AS name, url_decode(replace(regexp_extract(item, '^[^=]*=(.*)$', 1), '+', ' ')) AS value FROM v",
    "percent_round_trip": "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, text, " + "replace(" * 14 + "url_encode(text)" + "".join(f", '%{ord(c):02X}', chr({ord(c)}))" for c in "!$&'()*+,;=:@/") + " AS p FROM t) "
    "SELECT doc_id, CAST(length(p) AS INT) AS n, md5(p) AS path_md5, md5(text) AS text_md5 FROM f",
    "sizes_parsed": "WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT k AS p_partkey, CAST(CASE k % 5 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN -k END AS INT) AS n, "
    "CAST(CASE WHEN k % 4 < 2 AND k > 0 THEN k END AS INT) AS w, CAST(CASE WHEN k % 4 < 2 AND k > 0 THEN s END AS INT) AS h, CAST(CASE WHEN k % 3 < 2 THEN s ELSE 0 END AS INT) AS share, "
    "CAST(CASE WHEN k % 3 = 0 THEN k END AS INT) AS bx, CAST(CASE WHEN k % 3 = 0 THEN 3 END AS INT) AS bw, CASE WHEN k > 0 THEN CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 7 END AS INT) END AS cx, CASE WHEN k > 0 THEN CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN -2 WHEN 2 THEN 8 END AS INT) END AS cy, CAST(CASE WHEN k % 4 < 3 AND k > 0 THEN s END AS INT) AS ch FROM p",
    "colours_named": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 4294927175 WHEN 1 THEN CASE WHEN p_partkey % 120 <= 100 THEN 4278190080 + CAST(floor(p_partkey % 120 * 2.55e0 + 0.5e0) AS BIGINT) * 65793 END WHEN 2 THEN 4278190080 + p_partkey % 16777216 "
    "WHEN 3 THEN 2281701376 + (p_partkey % 4096 // 256) * 1114112 + (p_partkey % 256 // 16) * 4352 + (p_partkey % 16) * 17 WHEN 5 THEN 4290690750 WHEN 6 THEN 0 END AS argb FROM part",
    "formats_found": "WITH p AS (SELECT page_id, " + _PICK.format("'png', 'sixel', 'jpeg', 'raw', 'tga', 'own'", "page_id % 6") + " AS by_path, " + _PICK.format("'png', 'tga', 'raw', 'pcx'", "page_id % 4") + r" AS by_type, lower(regexp_extract(url, '^[a-z]+://[^/?#]*[^?#]*\.([^./?#\\]*)(?:[?#].*)?$', 1)) AS e FROM pages), "
    "q AS (SELECT page_id, CASE WHEN by_path <> 'own' THEN by_path ELSE CASE WHEN e IN ('png', 'gif', 'webp', 'pcx') THEN e WHEN e IN ('jpg', 'jpeg') THEN 'jpeg' ELSE 'raw' END END AS by_path, by_type FROM p) "
    "SELECT page_id, by_path, by_type, CASE by_type WHEN 'raw' THEN 'bin' ELSE by_type END AS extension, CASE by_path WHEN 'png' THEN 'image/png' WHEN 'sixel' THEN 'image/x-sixel' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'tga' THEN 'image/x-tga' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'pcx' THEN 'image/x-pcx' ELSE 'application/octet-stream' END AS content_type, "
    'CASE by_path WHEN \'raw\' THEN \'png\' ELSE by_path END AS "default" FROM q',
    "responses": "WITH e AS (SELECT event_id AS k, event_type FROM events), f AS (SELECT *, " + _PICK.format("'image/png', 'image/x-zcis', 'text/x-ansi'", "k % 3") + " AS ct, " + _PICK.format("'gzip', 'identity'", "k % 2") + " AS acc, " + _PICK.format("'identity', 'cobs', 'hex', 'identity'", "k % 4") + " AS be FROM e) "
    "SELECT k AS event_id, k % 4 < 2 AS allowed, CAST(" + _PICK.format("404, 502, 200, 500, 504", "k % 5") + " AS INT) AS status, CASE WHEN k % 3 = 0 AND k % 500 <> 0 THEN k % 500 > 400 ELSE greatest(k % 3000, k % 700) > 2048 END AS refused, "
    "'inline; filename=\"' || event_type || '\"' AS disposition, CASE WHEN ct <> 'image/png' AND k % 5 > 0 THEN 'Accept-Encoding' END AS vary, CASE WHEN ct <> 'image/png' AND k % 5 > 0 AND acc = 'gzip' THEN 'gzip' END AS encoding, CASE WHEN be <> 'identity' THEN be END AS x_encoding FROM f",
    "entries_framed": "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, doc_id % 3 = 0 AS cut, 4 + 12 + 4 + 6 + octet_length(encode(source)) + 1 AS head FROM documents) "
    "SELECT doc_id, CAST(CASE WHEN cut THEN 25 + octet_length(encode(source)) ELSE head + octet_length(encode(text)) END AS INT) AS n, CASE WHEN NOT cut THEN 'näme ' || source END AS filename, CASE WHEN NOT cut THEN 'base64' END AS encoding, CASE WHEN NOT cut THEN md5(text) END AS body_md5 FROM d",
}
_VIVID = "vi AS (SELECT image_id, x, y, v AS r, 255 - v AS g, v % 100 AS b FROM gr)"


def _box3(source: str, name: str, along: str) -> str:
    """Means of three along an axis of a plane of 4 by 4, the edge repeated."""
    other = "y" if along == "x" else "x"
    joins = " ".join(f"JOIN {source} t{k} ON t{k}.image_id = s.image_id AND t{k}.{other} = s.{other} AND t{k}.{along} = least(3, greatest(0, s.{along} + {k - 1}))" for k in range(3))
    mean = lambda c: f"(t0.{c} + t1.{c} + t2.{c} + 1) // 3 AS {c}"
    return f"{name} AS MATERIALIZED (SELECT s.image_id, s.x, s.y, {mean('u')}, {mean('v')} FROM {source} s {joins})"


ORACLES |= {
    "netpbm_gray": f"WITH {_GRAY} SELECT CAST(image_id AS VARCHAR) AS path, x, y, v AS r, v AS g, v AS b, 255 AS a FROM gr",
    "blur_chroma": f"WITH {_GRAY}, {_VIVID}, {_planes('vi', 7)}, " + ", ".join(_box3("ch" if k == 0 else f"k{k - 1}", f"k{k}", "xy"[k % 2]) for k in range(6)) + " SELECT image_id, x, y, CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM k5",
    "resize_planes": f"WITH {_PX}, {_planes('px', 3)}, tg AS (SELECT CAST(k % 6 AS INT) AS x, CAST(k // 6 AS INT) AS y FROM (SELECT unnest(range(12)) AS k)), "
    "ll AS (SELECT image_id, i.x, i.y, v FROM lu, tg i WHERE lu.x = i.x * 4 // 6 AND lu.y = i.y * 4 // 2), cc AS (SELECT image_id, i.x, i.y, u, v FROM ch, tg i WHERE i.x < 3 AND i.y < 1 AND ch.x = i.x * 2 // 3 AND ch.y = 0) "
    "SELECT ll.image_id, ll.x, ll.y, CAST(least(255, greatest(0, ll.v + floor(1436 * (cc.v - 128) / 1024.0))) AS INT) AS r, CAST(least(255, greatest(0, ll.v - floor((352 * (u - 128) + 731 * (cc.v - 128)) / 1024.0))) AS INT) AS g, "
    "CAST(least(255, greatest(0, ll.v + floor(1815 * (u - 128) / 1024.0))) AS INT) AS b, 255 AS a FROM ll JOIN cc ON ll.image_id = cc.image_id AND ll.x // 2 = cc.x AND ll.y // 2 = cc.y",
    "sql_functions": f"WITH {_PX} SELECT image_id, x, y, {_Y8} AS gray, CAST({O._565} AS INT) AS packed, CAST(a AS BIGINT) * 16777216 + r * 65536 + g * 256 + b AS argb, CAST(2 * r * r + 4 * (g - 170) * (g - 170) + 3 * (b - 85) * (b - 85) AS INT) AS distance, "
    "substring('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(image_id % 3844 // 62 + 1 AS INT), 1) || substring('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(image_id % 3844 % 62 + 1 AS INT), 1) AS pair, md5(CAST(image_id AS VARCHAR)) AS key FROM px",
    "draws": f"WITH {_PX}, {O._FEW}, {O._COMMON}, ru AS (SELECT image_id, y, x, r, g, b, a, CASE WHEN {O._CHANGES} THEN 1 ELSE 0 END AS starts FROM few WINDOW w AS (PARTITION BY image_id, y ORDER BY x)) "
    "SELECT ru.image_id, CAST(sum(CASE WHEN starts = 1 AND (ru.r <> cc.r OR ru.g <> cc.g OR ru.b <> cc.b OR ru.a <> cc.a) THEN 1 ELSE 0 END) AS BIGINT) AS draws, max(n) AS kept FROM ru JOIN cc ON cc.image_id = ru.image_id GROUP BY 1",
    "cut_lines": f"WITH {_CUTS}, l AS (SELECT p_partkey % 50 AS image_id, string_agg(x || ' ' || y || ' ' || w || ' ' || h || chr(13) || chr(10), '' ORDER BY p_partkey) AS t FROM ct GROUP BY 1) SELECT image_id, CAST(length(t) AS INT) AS n, md5(t) AS text_md5 FROM l",
}
ORACLES |= {f"pixels_of_{k}": _back(k) for k in _FORMATS}
ORACLES |= {f"quantise_{n}": f"WITH {_PX}, {_colours(s)} {_fit('px')}" for n, s in (("nes", "nes"), ("tic80_bank", "tic80:2..5,7"), ("world", "world"), ("mario", "mario"), ("kokobatoru", "kokobatoru"), ("cgagraphics", "cgagraphics"), ("pico8", "pico8"))}
ORACLES |= {
    "brush_gradient": _line("0", "0", "0", "h"), "gradient_north": _line("0", "h", "0", "0"), "gradient_northeast": _line("0", "h", "w", "0"), "gradient_east": _line("0", "0", "w", "0"), "gradient_southeast": _line("0", "0", "w", "h"), "gradient_south": _line("0", "0", "0", "h"),
    "gradient_southwest": _line("w", "0", "0", "h"), "gradient_west": _line("w", "0", "0", "0"), "gradient_northwest": _line("w", "h", "0", "0"), "gradient_angle": _line("0", "h / 2", "w", "h / 2"),
    "radial_minimum": _circle("least(hw, hh)", "least(hw, hh)"), "radial_diagonal": _circle("sqrt(hw * hw + hh * hh)", "sqrt(hw * hw + hh * hh)"), "radial_ellipse": _circle("hw", "hh"), "radial_at": _circle("3.0", "0.0", "2.0e0", "1.5e0"),
    "place_northwest": _placed(1, 0), "place_north": _placed(1, 0), "place_center": _placed(1, 1), "place_southeast": _placed(0, 3), "place_west": _placed(1, 1),
    "composite_three": f"WITH {_PX}, {_shifted(1)}, {_shifted(2)}, {_tinted('ti', 'n1', 'n2')}, " + _multiply("ti"),
    "composite_four": f"WITH {_PX}, {_shifted(1)}, {_shifted(2)}, {_shifted(3)}, {_tinted('ti', 'n1', 'n2')}, ne AS (SELECT image_id, x, y, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM n1), {_tinted('tn', 'ne', 'n3')}, ov AS ({_over_tables('tn', 'ti')}), " + _multiply("ov"),
}
