"""Every registered query of pictures and policies, made from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color, text
from tessera.operators import brush, composite, layout, palette, policy, transform
from tessera.sources import files, raster

Query = Callable[[SparkSession, str], DataFrame]


def _rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 pictures of the embeddings."""
    return raster.rgba_of_vectors(raster.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grey pictures of the embeddings."""
    return raster.gray_of_vectors(raster.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canvas for each part, of 1 to 16 by 1 to 12."""
    return raster.canvas(raster.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 1 + F.col("p_size") % 16, 1 + F.col("p_partkey") % 12)


def _layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next picture, as the layer over each picture. A fifth of its pixels are clear and a seventh opaque."""
    px = _rgba(spark, sf_dir)
    a = F.when(F.col("image_id") % 5 == 0, 0).when(F.col("image_id") % 7 == 0, 255).otherwise(F.col("a"))
    return px.withColumn("a", a).withColumn("image_id", F.col("image_id") - 1)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: client, key, id and the time in seconds."""
    events = raster.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), F.concat_ws("|", "event_type", F.col("user_id") % 20).alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey pictures, cropped and negated, counted by level."""
    px = transform.crop(_gray(spark, sf_dir), 2, 1, 4, 6)
    return px.select((255 - F.col("v")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


def convert_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b, a = (F.col(c) for c in "rgba")
    return _rgba(spark, sf_dir).select("image_id", "x", "y", color.gray8(r, g, b).alias("gray8"), color.rgb565(r, g, b).alias("rgb565"), color.rgb555(r, g, b).alias("rgb555"), color.rgba5551(r, g, b, a).alias("rgba5551"), color.packed(r, g, b, a).alias("argb"))


def convert_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b, a = (F.col(c) for c in "rgba")
    px = _rgba(spark, sf_dir).select("image_id", "x", "y", color.rgb565(r, g, b).cast("int").alias("p"), color.rgba5551(r, g, b, a).cast("int").alias("q"))
    one, two = color.from_rgb565(F.col("p")), color.from_rgba5551(F.col("q"))
    return px.select("image_id", "x", "y", *(v.alias(f"p{n}") for n, v in zip("rgb", one, strict=True)), *(v.alias(f"q{n}") for n, v in zip("rgba", two, strict=True)))


def convert_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = color.from_yuv(F.col("r"), F.col("g"), F.col("b"))
    return _rgba(spark, sf_dir).select("image_id", "x", "y", r.alias("r1"), g.alias("g1"), b.alias("b1"))


def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.crop(_rgba(spark, sf_dir), 1, 1, 2, 3)


def negate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.negate(_rgba(spark, sf_dir))


def resize(spark: SparkSession, sf_dir: str, width: int | None, height: int | None, mode: str) -> DataFrame:
    return transform.resize(_gray(spark, sf_dir), width, height, mode)


def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.radius(_rgba(spark, sf_dir), 2)


def blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.blur(_gray(spark, sf_dir), 2)


def edge_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rims of pictures in few levels, so that some are even enough."""
    px = _rgba(spark, sf_dir)
    return transform.edge_colour(px.withColumns({c: F.floor(F.col(c) / 100).cast("int") * 7 for c in "rgba"}))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.histogram(_rgba(spark, sf_dir).withColumns({c: F.floor(F.col(c) / 64).cast("int") for c in "rgba"}))


def brush_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brush.solid(_canvas(spark, sf_dir), (17, 130, 251, 200))


def brush_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brush.blank(_canvas(spark, sf_dir))


def brush_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brush.gradient(_canvas(spark, sf_dir), (255, 0, 0, 128), (0, 0, 255, 255))


def brush_radial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brush.radial_gradient(_canvas(spark, sf_dir), (255, 255, 255, 255), (0, 0, 0, 255))


def brush_hald(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brush.hald(spark, 4)


def composite_query(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return composite.composite(_rgba(spark, sf_dir), _layer(spark, sf_dir), rule, 1, -1)


def quantise(spark: SparkSession, sf_dir: str, dither: str) -> DataFrame:
    px = _rgba(spark, sf_dir)
    if dither == "strict":
        px = px.withColumns({c: F.floor(F.col(c) / 86).cast("int") * 85 for c in "rgb"})
    return palette.quantise(px, palette.slice_of("cga"), dither)


def diffuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.diffuse(_rgba(spark, sf_dir), palette.slice_of("cga"))


def most_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.most_apart(_rgba(spark, sf_dir), palette.slice_of("cga"), 4)


def most_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.most_voted(_rgba(spark, sf_dir), palette.slice_of("cga"), 3)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = raster.table(spark, sf_dir, "part").select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("seq"), (1 + F.col("p_size") % 16).cast("int").alias("w"), (1 + F.col("p_partkey") % 12).cast("int").alias("h"))
    return layout.grid(part, 5, quantum=4, gap=1)


def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a brand that have the same type are a group."""
    part = raster.table(spark, sf_dir, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("group_id"), F.col("p_partkey").alias("seq"), (1 + F.col("p_size") % 16).cast("int").alias("w"), (1 + F.col("p_partkey") % 12).cast("int").alias("h"))
    return layout.shelves(part, quantum=4, gap=1)


def netpbm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written as files in a column and read back as pixels."""
    written = files.netpbm_file(raster.pack(_rgba(spark, sf_dir)))
    return files.netpbm_pixels(written.select(F.col("image_id").cast("string").alias("path"), "content"))


def negotiated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request headers made of the events."""
    q = (F.col("event_id") % 11 / 10).cast("string")
    header = F.element_at(F.array(F.concat(F.lit("gzip;q="), q, F.lit(", deflate")), F.concat(F.lit("deflate;q="), q, F.lit(",*;q=0.5")), F.lit("identity"), F.concat(F.lit("*;q="), q), F.lit("br, GZIP ; q=0")), (F.col("event_id") % 5 + 1).cast("int"))
    return raster.table(spark, sf_dir, "events").select("event_id", text.negotiate_encoding(header).alias("encoding"))


def _few_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgba(spark, sf_dir).withColumns({c: F.floor(F.col(c) / 128).cast("int") for c in "rgba"})


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.runs(_few_colours(spark, sf_dir))


def commonest_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.commonest_colour(_few_colours(spark, sf_dir))


def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _few_colours(spark, sf_dir)
    return layout.bounding_box(px, layout.commonest_colour(px))


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = raster.pack(_rgba(spark, sf_dir))
    return whole.select("image_id", "width", "height", text.hex_lower(F.col("data")).alias("data"))


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as bodies."""
    docs = raster.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return docs.select("doc_id", F.md5(text.base64_line(F.col("body"))).alias("base64_md5"), F.md5(text.hex_lower(F.col("body"))).alias("hex_md5"), text.cache_key(F.col("body")).alias("key"))


def cobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the pictures, zero and others, as bodies."""
    whole = raster.pack(_rgba(spark, sf_dir).withColumns({c: F.when(F.col(c) < 110, 0).otherwise(F.col(c)) for c in "rgba"}))
    return whole.select("image_id", text.cobs(F.col("data")).alias("cobs"))


def base62(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.table(spark, sf_dir, "part").select("p_partkey", text.base62_pair(F.col("p_partkey") % 3844).alias("pair"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return raster.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", text.route(F.col("path"), F.col("query")).alias("status"), text.download_name(F.col("path"), F.lit("png")).alias("name"), text.cache_key(F.col("query")).alias("key"))


def url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _pages(spark, sf_dir).select("page_id", F.posexplode(text.url_words(F.col("query"))).alias("seq", "w"))
    return words.select("page_id", "seq", "w.name", "w.value", "w.kind")


def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.single_flight(_log(spark, sf_dir))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.cache_hits(_log(spark, sf_dir), 3600.0).groupBy("key").agg(F.sum(F.col("hit").cast("int")).alias("hits"), F.count("*").alias("n"))


def cache_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.sessions(_log(spark, sf_dir), 7200.0)


def client_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.quota(_log(spark, sf_dir), 3, 86400.0)


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a rate of one request in three hours, so that some are refused."""
    return policy.rate_limit(_log(spark, sf_dir).withColumn("t", F.col("t") / 10800.0), 1.0)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        flagship, convert_packed, convert_unpacked, convert_yuv, crop, negate, radius, blur, edge_colour, histogram, brush_solid, brush_null, brush_gradient, brush_radial, brush_hald,
        most_voted, grid, runs, commonest_colour, bounding_box, pack, encodings, cobs, base62, request_lines, url_words, single_flight, cache_hits, cache_sessions, client_quota, rate_limit,
        diffuse, most_apart, shelves, netpbm_round_trip, negotiated,
    )
}
QUERIES |= {f"resize_{n}": partial(resize, width=w, height=h, mode=m) for n, w, h, m in (("exact", 5, 11, "exact"), ("inside", 6, 3, "inside"), ("cover", 6, 3, "cover"), ("percent", 150, None, "percent"), ("width", 3, None, "exact"))}
QUERIES |= {f"quantise_{d}": partial(quantise, dither=d) for d in ("nearest", "bayer", "strict")}
QUERIES |= {f"composite_{rule}": partial(composite_query, rule=rule) for rule in composite.BLENDS}
