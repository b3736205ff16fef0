"""Functions of request lines and response bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the digits of base 62, in order.
BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def base64_line(data: Column) -> Column:
    """Base 64 with padding, on one line."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def base62_pair(n: Column) -> Column:
    """0 to 3843 as two digits."""
    digit = lambda k: F.substring(F.lit(BASE62), (k + 1).cast("int"), F.lit(1))
    return F.concat(digit(F.floor(n / 62)), digit(n % 62))


def cache_key(query: Column) -> Column:
    """MD5 of the query as it stands: its order counts."""
    return F.md5(query)


def download_name(path: Column, extension: Column) -> Column:
    """The last segment without unsafe characters and extension, ``download`` where nothing is left."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), "[^A-Za-z0-9._-]", "")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.concat(F.when(F.regexp_replace(stem, r"\.", "") == "", F.lit("download")).otherwise(stem), F.lit("."), extension)


def cobs(data: Column) -> Column:
    """Consistent-overhead byte stuffing of a binary, as lower-case hex, without a delimiter at the end.

    Blocks lie between zero bytes; a block is cut after 254 bytes. A full block opens a new one only if something follows.
    """
    pieces = F.split(F.regexp_replace(F.lower(F.hex(data)), "(..)", "$1 "), "00 ", -1)
    # Each piece is cut into strings of 254 bytes ("xx " each); all but the last of a piece are full blocks.
    length = lambda p: F.floor(F.length(p) / 3)
    blocks = lambda p: F.greatest(F.lit(1), F.ceil(length(p) / 254)).cast("int")
    block = lambda p, k: F.substring(p, (k * 762 + 1).cast("int"), F.lit(762))
    code = lambda p, k: F.lpad(F.lower(F.hex((F.length(block(p, k)) / 3 + 1).cast("long"))), 2, "0")
    parts = F.transform(pieces, lambda p, i: F.array_join(F.transform(F.sequence(F.lit(0), blocks(p) - 1), lambda k: F.concat(code(p, k), block(p, k))), ""))
    # A piece that ends in a full block and has another after it needs the empty block that stands for the zero byte.
    ends = F.zip_with(pieces, parts, lambda p, x: F.struct((F.length(p) % 762 == 0).alias("full"), (F.length(p) > 0).alias("some"), x.alias("x")))
    joined = F.transform(ends, lambda e, i: F.concat(e["x"], F.when(e["full"] & e["some"] & (i < F.size(pieces) - 1), "01").otherwise("")))
    return F.regexp_replace(F.array_join(joined, ""), " ", "")


def route(path: Column, query: Column) -> Column:
    """Status of a request line: only /cdn is served, and an empty query just answers."""
    return F.when(path.isin("/cdn", "/cdn/"), F.lit(200)).otherwise(F.lit(404))


def url_words(query: Column) -> Column:
    """The words of a query: array<struct<name, value, kind>>, with plus signs as blanks. The first colon or equals sign
    decides; ``begin`` and ``end`` open and close a scope; what has neither sign, or a colon first, is a plain source."""
    words = F.filter(F.split(F.regexp_replace(query, r"\+", " "), "&"), lambda w: w != "")

    def word(w: Column) -> Column:
        sign = F.regexp_extract(w, "^[^:=]*([:=])", 1)
        name = F.regexp_extract(w, "^([^:=]*)", 1)
        kind = F.when(w == "begin", "open").when(w == "end", "close").when(sign == "=", "named").when((sign == "") & ~w.rlike(r"[./]"), "named").otherwise("plain")
        return F.struct(F.when(kind == "plain", w).otherwise(name).alias("name"), F.when((kind == "named") & (sign == "="), F.regexp_extract(w, "^[^:=]*=(.*)$", 1)).otherwise("").alias("value"), kind.alias("kind"))

    return F.transform(words, word)


def negotiate_encoding(header: Column) -> Column:
    """The body encoding a client prefers: gzip, deflate or identity. A star stands for those not named, zero refuses, and a
    tie goes to gzip."""

    def offer(item: Column) -> Column:
        name = F.lower(F.trim(F.substring_index(item, ";", 1)))
        given = F.regexp_extract(item, r"^[^;]*;[ \t]*[qQ]=([0-9]*\.?[0-9]+)", 1)
        return F.struct(name.alias("name"), F.when(given != "", given.try_cast("double")).otherwise(1.0).alias("q"))

    offers = F.transform(F.split(F.coalesce(header, F.lit("")), ","), offer)

    def of(*names: str) -> Column:
        return F.element_at(F.filter(offers, lambda o: o["name"].isin(*names)), -1)["q"]

    last = lambda *names: F.when(F.size(F.filter(offers, lambda o: o["name"].isin(*names))) > 0, of(*names))
    any_q = F.coalesce(last("*"), F.lit(-1.0))
    gzip, deflate = F.coalesce(last("gzip", "x-gzip"), any_q), F.coalesce(last("deflate"), any_q)
    return F.when((gzip <= 0) & (deflate <= 0), "identity").when(gzip >= deflate, "gzip").otherwise("deflate")
