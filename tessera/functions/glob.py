"""Paths by pattern: ``*`` within a folder's name, ``**`` across folders, ``a.png|jpg`` for alternatives of an ending."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def alternatives(pattern: str) -> list[str]:
    """The patterns that one with bars stands for: what stands before the last dot before the first bar belongs to each of them."""
    if "|" not in pattern:
        return [pattern]
    dot = pattern.rfind(".", 0, pattern.index("|"))
    return [pattern[: dot + 1] + tail for tail in pattern[dot + 1 :].split("|")]


def fixed_folder(pattern: str) -> tuple[str, str]:
    """The folders before the first one with a wildcard, with their slash, and the rest: a listing starts there."""
    pattern = pattern.replace("\\", "/")
    wild = pattern.find("*")
    cut = pattern.rfind("/", 0, len(pattern) if wild < 0 else wild) + 1
    return pattern[:cut], pattern[cut:]


def expression(rest: str) -> str:
    """A regular expression of Java for the path below the fixed folder; names that begin with a dot are never met."""
    out, at = [], 0
    for found in re.finditer(r"\*\*/|\*\*|\*", rest):
        out.append(re.escape(rest[at : found.start()]))
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}[found[0]])
        at = found.end()
    out.append(re.escape(rest[at:]))
    return r"(?s)\A(?!(?:.*/)?\.)" + "".join(out) + r"\z"


def matches(path: Column, pattern: str, keep_case: bool = True) -> Column:
    """Whether a path fits a pattern. The fixed folder is a prefix, which scans and listings can be pruned by."""

    def one(single: str) -> Column:
        folder, rest = fixed_folder(single)
        inner = expression(rest) if keep_case else "(?iu)" + expression(rest)
        return path.startswith(folder) & F.substring(path, F.lit(len(folder) + 1), F.length(path)).rlike(inner)

    return reduce(lambda a, b: a | b, map(one, alternatives(pattern)))
