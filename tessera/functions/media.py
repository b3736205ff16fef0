"""Containers by extension, content type and first bytes, and what a served response says of itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each container its content types and extensions, the one that is written first.
CONTAINERS: dict[str, tuple[str, str]] = {
    "png": ("image/png", "png"),
    "ppm": ("image/x-portable-pixmap image/x-portable-anymap", "ppm pgm pbm pnm"),
    "jpeg": ("image/jpeg", "jpg jpeg"),
    "ktx": ("image/ktx", "ktx"),
    "ktx2": ("image/ktx2", "ktx2"),
    "dds": ("image/vnd-ms.dds image/vnd.ms-dds", "dds"),
    "pvr": ("image/x-pvr", "pvr"),
    "zcis": ("image/x-zcis", "zcis"),
    "webp": ("image/webp", "webp"),
    "ansi": ("text/x-ansi", "ansi"),
    "ansi_halfblock": ("text/x-ansi-halfblock", "utf8"),
    "sixel": ("image/x-sixel", "sixel six"),
    "pcx": ("image/x-pcx image/vnd.zbrush.pcx", "pcx"),
    "rom": ("application/x-nes-rom application/x-tic80-cart", "nes tic"),
    "tga": ("image/x-tga image/x-targa image/tga", "tga targa tpic"),
    "gif": ("image/gif", "gif"),
}
# The status of each kind of failure; all others are 500.
_STATUS = {"not_found": 404, "unsupported_format": 415, "upstream": 502, "timeout": 504, "invalid_input": 400}


def _lookup(key: Column, pairs: list[tuple[str, str]], otherwise: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(v) for p in pairs for v in p))[key], F.lit(otherwise))


def format_of_path(path: Column) -> Column:
    """The container that a path's extension names, in any case; ``raw`` where it names none."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return _lookup(extension, [(e, n) for n, (_, es) in CONTAINERS.items() for e in es.split()], "raw")


def format_of_content_type(header: Column) -> Column:
    """The container of a content type; parameters, case and blanks around it don't count."""
    plain = F.lower(F.regexp_replace(F.substring_index(header, ";", 1), r"^[\x09-\x0D ]+|[\x09-\x0D ]+$", ""))
    return _lookup(plain, [(t, n) for n, (ts, _) in CONTAINERS.items() for t in ts.split()], "raw")


def extension_of(container: Column) -> Column:
    return _lookup(container, [(n, es.split()[0]) for n, (_, es) in CONTAINERS.items()], "bin")


def content_type_of(container: Column) -> Column:
    return _lookup(container, [(n, ts.split()[0]) for n, (ts, _) in CONTAINERS.items()], "application/octet-stream")


def status_of(failure: Column) -> Column:
    """The status that a kind of failure is answered with; 200 without one."""
    known = F.create_map(*(F.lit(v) for p in _STATUS.items() for v in p))
    return F.when(failure.isNull(), 200).otherwise(F.coalesce(known[failure], F.lit(500)))


def allowed_method(method: Column) -> Column:
    return F.coalesce(method, F.lit("")).isin("GET", "HEAD")


def default_format(first: Column) -> Column:
    """What is written if nothing is asked for: the first source's container, PNG for painted, raw and portable ones."""
    return F.when(first.isNull() | first.isin("raw", "ppm"), "png").otherwise(first)


def too_large(width: Column, height: Column, share: Column, most_pixels: int, most_percent: int) -> Column:
    """Whether a resize is refused: a share over its limit, else a side over its own; a limit of 0 is none."""
    by_share = F.lit(most_percent > 0) & (share > most_percent)
    return F.when(F.coalesce(share, F.lit(0)) != 0, by_share).otherwise(F.lit(most_pixels > 0) & (F.greatest(width, height) > most_pixels))


def grid_too_large(cell: Column, gap: Column, most_pixels: int) -> Column:
    """Whether a grid is refused: a side of its cells or of the gaps between them over the limit; a limit of 0 is none. ``cell`` and
    ``gap`` are structs of width and height, null where they aren't given."""
    sides = [F.coalesce(v[c], F.lit(0)) for v in (cell, gap) for c in ("width", "height")]
    return F.lit(most_pixels > 0) & (F.greatest(*sides) > most_pixels)


def over_limits(sources: Column, steps: Column, most_sources: int = 0, most_steps: int = 0) -> Column:
    """Why a request is refused before anything is fetched: "steps", "sources" or "nothing" that is asked for; null where it isn't. A
    limit of 0 is none."""
    many = lambda n, most: F.lit(most > 0) & (n > most)
    return F.when(F.coalesce(sources, F.lit(0)) + F.coalesce(steps, F.lit(0)) == 0, "nothing").when(many(steps, most_steps), "steps").when(many(sources, most_sources), "sources")


def blob_format(by_bytes: Column, content_type: Column, path: Column) -> Column:
    """struct<format, content_type> of a blob: its container by its first bytes, else by its declared type, else by its path's ending. A
    container that none of them tells keeps the declared type."""
    known = F.when(by_bytes == "netpbm", "ppm").when(by_bytes.isin(*CONTAINERS), by_bytes)
    told = lambda v: F.when(v != "raw", v)
    found = F.coalesce(known, told(format_of_content_type(content_type)), told(format_of_path(path)), F.lit("raw"))
    kind = F.when(found != "raw", content_type_of(found)).when(content_type != "", content_type).otherwise("application/octet-stream")
    return F.struct(found.alias("format"), kind.alias("content_type"))


def response_headers(content_type: Column, filename: Column, length: Column, accepted: Column, body_encoding: Column) -> Column:
    """map<string, string> of a response's headers; ``accepted`` is the encoding negotiated with the client. Pictures that are
    compressed already, and empty bodies, are sent as they are."""
    worth = ~content_type.isin("image/png", "image/jpeg", "image/gif") & (length > 0)
    entries = [
        ("content-type", content_type, F.lit(True)),
        ("content-disposition", F.concat(F.lit('inline; filename="'), filename, F.lit('"')), F.lit(True)),
        ("x-original-content-length", length.cast("string"), F.lit(True)),
        ("vary", F.lit("Accept-Encoding"), worth),
        ("content-encoding", accepted, worth & (accepted != "identity")),
        ("x-encoding", body_encoding, body_encoding != "identity"),
    ]
    all_of = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value"), on.alias("on")) for k, v, on in entries))
    return F.map_from_entries(F.transform(F.filter(all_of, lambda e: e["on"]), lambda e: F.struct(e["key"], e["value"])))


def _u32(n: Column) -> Column:
    return F.unhex(F.regexp_replace(F.lpad(F.hex(n.cast("long")), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))


# The encodings of a stored body, by their number.
BODY_ENCODINGS = ("identity", "cobs", "base64", "hex")


def frame(content_type: Column, filename: Column, encoding: Column, body: Column) -> Column:
    """A cache entry as one binary: length and text of type and name (low byte first), the encoding's number, and the body."""
    kind, name = F.encode(content_type, "UTF-8"), F.encode(filename, "UTF-8")
    number = F.unhex(F.lpad(F.hex((F.array_position(F.array(*map(F.lit, BODY_ENCODINGS)), encoding) - 1).cast("long")), 2, "0"))
    return F.concat(_u32(F.octet_length(kind)), kind, _u32(F.octet_length(name)), name, number, body)


def unframe(entry: Column) -> Column:
    """struct<content_type, filename, encoding, body> of a framed entry; null, a miss, where it is cut short."""
    u32 = lambda at: F.conv(F.regexp_replace(F.hex(F.substring(entry, at + 1, F.lit(4))), "(..)(..)(..)(..)", "$4$3$2$1"), 16, 10).cast("long")
    n = F.octet_length(entry)
    kind = F.when(n >= 4, u32(F.lit(0)))
    name_at = F.when(n >= 8 + kind, (4 + kind).cast("int"))
    name = u32(name_at)
    at = F.when(n >= name_at + 4 + name + 1, (name_at + 4 + name).cast("int"))
    number = F.conv(F.hex(F.substring(entry, at + 1, F.lit(1))), 16, 10).cast("int")
    found = F.struct(
        F.decode(F.substring(entry, F.lit(5), kind.cast("int")), "UTF-8").alias("content_type"),
        F.decode(F.substring(entry, name_at + 5, name.cast("int")), "UTF-8").alias("filename"),
        F.get(F.array(*map(F.lit, BODY_ENCODINGS)), number).alias("encoding"),
        F.substring(entry, at + 2, n).alias("body"),
    )
    return F.when(number < len(BODY_ENCODINGS), found)
