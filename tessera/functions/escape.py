"""Names of written pictures from a pattern with escapes, compiled to one expression when a query is planned."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The escapes by letter, and those that have a long name.
LETTERS = {
    "t": "basename", "f": "filename", "e": "extension", "i": "input", "M": "input", "w": "width", "h": "height", "p": "scene", "s": "scene", "n": "count", "m": "magick", "B": "bytes", "G": "original", "A": "alpha",
    "d": "index",
}
LONG_NAMES = ("basename", "extension", "directory", "input", "width", "height", "scene", "magick")
NUMBERS = ("index", "scene", "count", "width", "height", "bytes")
PER_PICTURE = ("basename", "filename", "input", "scene", "index")

_ESCAPE = re.compile(r"%(?:(?P<percent>%)|(?P<flags>[-0]*)(?P<width>[0-9]*)(?:\.(?P<precision>[0-9]*))?(?:\[(?P<long>[^\]]*)\]|(?P<letter>[^\[])))", re.S)


def parts_of(pattern: str) -> list[str | tuple[str, int, str, int | None]]:
    """Literals, and (name, width, padding: left, zeros or right, precision) of the escapes; ValueError for what isn't one."""
    out: list = []
    at = 0
    for percent in iter(lambda: pattern.find("%", at), -1):
        out.append(pattern[at:percent])
        found = _ESCAPE.match(pattern, percent)
        if not found:
            raise ValueError(f"an escape that ends too early in {pattern!r}")
        at = found.end()
        if found["percent"]:
            out.append("%")
            continue
        name = found["long"] if found["long"] is not None else LETTERS.get(found["letter"])
        if name is None or found["long"] is not None and name not in LONG_NAMES:
            raise ValueError(f"no escape {found[0]} in {pattern!r}")
        pad = "left" if "-" in found["flags"] else "zeros" if "0" in found["flags"] else "right"
        if pad == "zeros" and name not in NUMBERS:
            raise ValueError(f"zeros before {name}, which is no number, in {pattern!r}")
        out.append((name, int(found["width"] or 0), pad, None if found["precision"] is None else int(found["precision"] or 0)))
    out.append(pattern[at:])
    return out


def names_each(pattern: str) -> bool:
    """Whether a pattern tells pictures apart, so that it can name many."""
    try:
        return any(not isinstance(p, str) and p[0] in PER_PICTURE for p in parts_of(pattern))
    except ValueError:
        return False


def of_path(path: Column) -> dict[str, Column]:
    """What a file's path gives: input, filename, basename, extension, directory. A leading dot belongs to the name."""
    filename = F.regexp_extract(path, r"([^/]*)\z", 1)
    ending = F.regexp_extract(filename, r"(?s)^.+(\.[^.]*)\z", 1)
    ending = F.when(filename == "..", F.lit("")).otherwise(ending)
    basename = F.substring(filename, F.lit(1), F.length(filename) - F.length(ending))
    folder = F.regexp_extract(path, r"(?s)^(.*?)/+[^/]*\z", 1)
    directory = F.when(folder != "", folder).when(path.startswith("/"), "/").otherwise(".")
    return {"input": path, "filename": filename, "basename": basename, "extension": F.substring(ending, F.lit(2), F.length(ending)), "directory": directory}


def expand(pattern: str, values: dict[str, Column]) -> Column:
    """The name that ``pattern`` gives with ``values`` by long name (``index`` stands for ``scene`` as well). A name with a value that is
    null, as a painted picture's path, is null."""
    columns = {"scene": values.get("index"), **values}
    pieces = []
    for part in parts_of(pattern):
        if isinstance(part, str):
            pieces += [F.lit(part)] if part else []
            continue
        name, width, pad, precision = part
        if columns.get(name) is None:
            raise ValueError(f"no value for {name}")
        text = columns[name].cast("string")
        text = text if precision is None else F.substring(text, F.lit(1), F.lit(precision))
        if width:
            padded = F.rpad(text, width, " ") if pad == "left" else F.lpad(text, width, "0" if pad == "zeros" else " ")
            text = F.when(F.length(text) < width, padded).otherwise(text)
        pieces.append(text)
    return F.concat(*pieces) if pieces else F.lit("")
