"""URLs by their parts, references resolved against a base, and percent escapes, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a URL may hold: no blanks, controls or quotes, and only whole escapes.
_WELL_FORMED = r"""^(?:[^\x00-\x20\x7F-\x{10FFFF}"<>\\^`{|}%]|%[0-9A-Fa-f]{2})*$"""
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://((?:[^/?]*@)?)(\[[^/?\]]*\]|[^/?:\[][^/?:]*|)(:[0-9]*)?(?=[/?]|$))?([^?]*)(\?.*)?$"
#: Characters that a path keeps as they are.
_PLAIN = r"A-Za-z0-9\-._~!$&'()*+,;=:@/"


def percent_decode(text: Column, plus_as_space: bool = False) -> Column:
    """Escapes as the bytes they stand for; a broken escape stays as it is written."""
    text = F.replace(text, F.lit("+"), F.lit(" ")) if plus_as_space else text
    # Whole escapes and what lies between them, as bytes in hexadecimal, are joined before they are read as UTF-8.
    parts = F.regexp_extract_all(text, F.lit("%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    as_hex = F.transform(parts, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.upper(F.substring(p, 2, 2))).otherwise(F.hex(F.encode(p, "UTF-8"))))
    return F.decode(F.unhex(F.array_join(as_hex, "")), "UTF-8")


def percent_encode_path(text: Column) -> Column:
    """All bytes escaped that a path doesn't hold as they are."""
    parts = F.regexp_extract_all(text, F.lit(f"[{_PLAIN}]+|[^{_PLAIN}]+"), F.lit(0))
    escaped = lambda p: F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^[{_PLAIN}]"), p).otherwise(escaped(p))), "")


def parse(url: Column) -> Column:
    """struct<scheme, authority, userinfo, host, port, path, query> of a URL or reference without its fragment; null where it is
    malformed. A missing authority or query is null, an empty one is empty; the scheme is in small letters."""
    text = F.substring_index(url, "#", 1)
    part = lambda k: F.regexp_extract(text, _PARTS, k)
    has_authority = text.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    port = F.regexp_replace(part(4), "^:", "")
    host = part(3)
    authority = F.when(has_authority, F.when(port == "", host).otherwise(F.concat(host, F.lit(":"), port)))
    whole = F.struct(
        F.lower(part(1)).alias("scheme"),
        authority.alias("authority"),
        F.regexp_replace(part(2), "@$", "").alias("userinfo"),
        F.when(has_authority, host).alias("host"),
        port.alias("port"),
        part(5).alias("path"),
        F.when(part(6) != "", F.substring(part(6), 2, 2**30)).alias("query"),
    )
    return F.when(text.rlike(_WELL_FORMED) & (~has_authority | text.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?]*@)?(?:\[[^/?\]]*\]|[^/?:\[][^/?:]*|)(?::[0-9]*)?(?:[/?]|$)")), whole)


def without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments worked out (RFC 3986, 5.2.4)."""
    rooted = path.startswith("/")
    pieces = F.split(F.when(rooted, F.substring(path, 2, 2**30)).otherwise(path), "/", -1)
    n = F.size(pieces)

    def step(out: Column, x: Column) -> Column:
        up = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(x["p"] == ".", F.when(x["last"], F.concat(out, F.array(F.lit("")))).otherwise(out)).when(x["p"] == "..", F.when(x["last"], F.concat(up, F.array(F.lit("")))).otherwise(up)).otherwise(F.concat(out, F.array(x["p"])))

    marked = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), (i == n - 1).alias("last")))
    joined = F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)


def write(scheme: Column, authority: Column, userinfo: Column, path: Column, query: Column) -> Column:
    """The URL of its parts; null authority and query are left out."""
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority.isNotNull(), F.concat(F.lit("//"), F.when(userinfo != "", F.concat(userinfo, F.lit("@"))).otherwise(""), authority)).otherwise(""),
        path,
        F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""),
    )


def resolve(base: Column, reference: Column) -> Column:
    """``reference`` seen from ``base`` (both of ``parse``), as a URL; null where either is malformed."""
    b, r = base, reference
    folder = F.regexp_extract(b["path"], "^(.*/)", 1)
    merged = F.when(r["path"].startswith("/"), r["path"]).when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
    own = write(r["scheme"], r["authority"], r["userinfo"], without_dots(r["path"]), r["query"])
    other_host = write(b["scheme"], r["authority"], r["userinfo"], without_dots(r["path"]), r["query"])
    same_path = write(b["scheme"], b["authority"], b["userinfo"], b["path"], F.coalesce(r["query"], b["query"]))
    found = F.when(r["scheme"] != "", own).when(r["authority"].isNotNull(), other_host).when(r["path"] == "", same_path).otherwise(write(b["scheme"], b["authority"], b["userinfo"], without_dots(merged), r["query"]))
    return F.when(b.isNotNull() & r.isNotNull(), found)


def params(query: Column, plus_as_space: bool = True) -> Column:
    """array<struct<name, value>> of a query's items, decoded; what has no equals sign has an empty value."""
    item = lambda x: F.struct(percent_decode(F.substring_index(x, "=", 1), plus_as_space).alias("name"), percent_decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1), plus_as_space).alias("value"))
    return F.when(F.coalesce(query, F.lit("")) == "", F.array().cast("array<struct<name:string,value:string>>")).otherwise(F.transform(F.split(query, "&", -1), item))


def segments(path: Column) -> Column:
    """The decoded segments of a path; none for an empty one."""
    rest = F.regexp_replace(path, "^/", "")
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(rest, "/", -1), lambda s: percent_decode(s)))
