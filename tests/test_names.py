"""Escapes in names, paths by pattern, block textures and request limits, with values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import blocks, escape, glob, media
from tessera.sources import files


def named(spark, pattern, path="shots/a.tar.gz", **values):
    columns = {**escape.of_path(F.col("path")), "index": F.lit(7), "width": F.lit(640), "bytes": F.lit(1234), **values}
    return spark.createDataFrame([(path,)], "path string").select(escape.expand(pattern, columns).alias("n")).first().n


@pytest.mark.parametrize(("pattern", "want"), [
    ("", ""), ("plain", "plain"), ("%d.png", "7.png"), ("%03d", "007"), ("%-4d|", "7   |"), ("%4d|", "   7|"), ("%-04d|", "7   |"), ("100%%", "100%"), ("%%%d%%", "%7%"), ("%t", "a.tar"), ("%e", "gz"), ("%f", "a.tar.gz"),
    ("%[directory]/%[basename]", "shots/a.tar"), ("%.3f", "a.t"), ("%.0f|", "|"), ("%.f|", "|"), ("%8.3f|", "     a.t|"), ("%2f", "a.tar.gz"), ("%i", "shots/a.tar.gz"), ("%w-%010B", "640-0000001234"), ("%s%p", "77"),
])
def test_escapes(spark, pattern, want):
    assert named(spark, pattern) == want


@pytest.mark.parametrize("pattern", ["%", "a%", "%5", "%.", "%[width", "%[nosuch]", "%q", "%05t", "%03[basename]", "%[bytes]"])
def test_refused_escapes(pattern):
    with pytest.raises(ValueError):
        escape.parts_of(pattern)
    assert not escape.names_each(pattern)


def test_paths_and_nulls(spark):
    got = {p: [named(spark, e, p) for e in ("%t", "%e", "%[directory]")] for p in (".bashrc", "a.", "/x", "/x/y.z", "..", "dir/", "n", "a//b.c")}
    assert got == {".bashrc": [".bashrc", "", "."], "a.": ["a", "", "."], "/x": ["x", "", "/"], "/x/y.z": ["y", "z", "/x"], "..": ["..", "", "."], "dir/": ["", "", "dir"], "n": ["n", "", "."], "a//b.c": ["b", "c", "a"]}
    assert named(spark, "%t", None) is None and named(spark, "%d", None) == "7"
    assert escape.names_each("%d.png") and escape.names_each("%[basename]") and not escape.names_each("%w.png") and not escape.names_each("x")
    with pytest.raises(ValueError):
        named(spark, "%h")


def plain_match(pattern, path):
    """By trying every place, one sign after the other."""
    if not pattern:
        return not path
    if pattern.startswith("**"):
        rest = pattern[2:]
        return rest.startswith("/") and plain_match(rest[1:], path) or any(plain_match(rest, path[k:]) for k in range(len(path) + 1))
    if pattern[0] == "*":
        stop = path.find("/")
        return any(plain_match(pattern[1:], path[k:]) for k in range((len(path) if stop < 0 else stop) + 1))
    return bool(path) and path[0] == pattern[0] and plain_match(pattern[1:], path[1:])


def test_globs_equal_matching_by_hand(spark):
    rng = random.Random(2)
    paths = ["/".join("".join(rng.choice("ab.+") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))) for _ in range(300)] + ["src/a.png", "src/x/a.png", "src/.x/a.png"]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    for pattern in ("*", "**", "a*", "**/a", "**/*a*", "a**b", "*/**/b", "**a", "src/**/a.png", "a/*", "+*", "**/", "*.a|b", "a/**/*.b|a"):
        got = {r.path for r in table.where(glob.matches(F.col("path"), pattern)).collect()}
        want = set()
        for single in glob.alternatives(pattern):
            folder, rest = glob.fixed_folder(single)
            want |= {p for p in paths if p.startswith(folder) and plain_match(rest, p[len(folder) :]) and not any(x.startswith(".") for x in p[len(folder) :].split("/"))}
        assert got == want, pattern
    assert glob.alternatives("x/*.png|jpg|a/b") == ["x/*.png", "x/*.jpg", "x/*.a/b"] and glob.alternatives("a|b") == ["a", "b"]
    assert glob.fixed_folder("a/b/c*/d") == ("a/b/", "c*/d") and glob.fixed_folder("a/b") == ("a/", "b") and glob.fixed_folder("*") == ("", "*")
    assert spark.createDataFrame([("A/B.PNG",)], "p string").where(glob.matches(F.col("p"), "a/*.png", keep_case=False)).count() == 0  # folders are taken as they are
    assert spark.createDataFrame([("a/B.PNG",)], "p string").where(glob.matches(F.col("p"), "a/*.png", keep_case=False)).count() == 1


def test_a_folder_and_a_column_agree(spark, tmp_path):
    names = ["a.png", "b.jpg", "sub/a.png", "sub/deep/c.png", "sub/.hidden/d.png", "sub/deep/.e.png", "sub/f.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    table = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names], "path string")
    for pattern, want in (("*.png|jpg", {"a.png", "b.jpg"}), ("**/*.png", {"a.png", "sub/a.png", "sub/deep/c.png"}), ("sub/*", {"sub/a.png", "sub/f.txt"}), ("sub/deep/c.png", {"sub/deep/c.png"})):
        whole = f"{tmp_path}/{pattern}"
        listed = {bytes(r.content).decode() for r in files.globbed(spark, whole).collect()}
        column = {r.path.removeprefix(f"{tmp_path}/") for r in table.where(glob.matches(F.col("path"), whole)).collect()}
        assert listed == column == want


def plain_block(block):
    """{(x, y): (r, g, b)} of a block, bit by bit."""
    bits = "".join(f"{b:08b}" for b in block)
    n = lambda at, many: int(bits[at : at + many], 2)
    bases = []
    for at in (0, 8, 16):
        if bits[30] == "1":
            five, step = n(at, 5), n(at + 5, 3)
            both = five, (five + (step - 8 if step > 3 else step)) % 32
            bases.append([v * 8 + v // 4 for v in both])
        else:
            bases.append([n(at, 4) * 17, n(at + 4, 4) * 17])
    tables, flipped = (n(24, 3), n(27, 3)), bits[31] == "1"
    out = {}
    for p in range(16):
        x, y = p // 4, p % 4
        half = int((y if flipped else x) >= 2)
        step = blocks.STEPS[tables[half]][int(bits[63 - p])] * (-1 if bits[47 - p] == "1" else 1)
        out[x, y] = tuple(min(255, max(0, bases[c][half] + step)) for c in range(3))
    return out


def test_blocks_bit_by_bit(spark):
    rng = random.Random(8)
    made = [bytearray(rng.randrange(256) for _ in range(8)) for _ in range(60)]
    rows = [(1, k % 8, k // 8, b) for k, b in enumerate(made)] + [(2, 0, 0, bytearray(7)), (2, 0, 0, None)]
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in blocks.etc1_pixels(spark.createDataFrame(rows, "image_id long, bx int, by int, block binary")).collect()}
    want = {(k % 8 * 4 + x, k // 8 * 4 + y): c for k, b in enumerate(made) for (x, y), c in plain_block(b).items()}
    assert got == want
    white = plain_block(bytes([0xFF, 0xFF, 0xFF, 0, 0, 0, 0, 0]))
    assert set(white.values()) == {(255, 255, 255)}


def test_formats_and_limits(spark):
    index = b"!<arch>\n" + b"0000000000.txt/ " + b" " * 42 + b"`\n"
    rows = [(1, bytearray(index), "", "x.png"), (2, bytearray(b"!<arch>\nother"), "", "x.PNG"), (3, None, "text/html", None), (4, bytearray(b"P6\n"), "image/png", "x.gif"), (5, bytearray(), "", ""), (6, None, None, None)]
    table = spark.createDataFrame(rows, "id int, content binary, type string, path string")
    got = {r.id: (r.b.format, r.b.content_type) for r in table.select("id", media.blob_format(files.kind_of(F.col("content")), F.col("type"), F.col("path")).alias("b")).collect()}
    none = "application/octet-stream"
    assert got == {1: ("zcis", "image/x-zcis"), 2: ("png", "image/png"), 3: ("raw", "text/html"), 4: ("ppm", "image/x-portable-pixmap"), 5: ("raw", none), 6: ("raw", none)}
    side = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    one = spark.range(1)
    assert one.select(media.grid_too_large(side(10, 11), side(0, 0), 10).alias("v")).first().v and not one.select(media.grid_too_large(side(10, 10), side(9, 10), 10).alias("v")).first().v
    assert [one.select(media.over_limits(F.lit(a), F.lit(b), 2, 3).alias("v")).first().v for a, b in ((0, 0), (2, 3), (3, 3), (3, 4), (None, 1))] == ["nothing", None, "sources", "steps", None]
