"""Functions and operators on small made pictures, with values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import color, text
from tessera.operators import brush, layout, palette, policy, transform
from tessera.sources import raster

HEAD = "image_id long, x int, y int, r int, g int, b int, a int"


def picture(spark, rows, width, image_id=1):
    return spark.createDataFrame([(image_id, k % width, k // width, *p) for k, p in enumerate(rows)], HEAD)


def pixels(df):
    return {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in df.collect()}


def test_flat_picture_survives_blur(spark):
    px = picture(spark, [(17, 130, 251, 200)] * 117, 13)
    assert set(pixels(transform.blur(px, 5)).values()) == {(17, 130, 251, 200)}


def test_blurred_edge(spark):
    px = picture(spark, [(0 if k % 20 < 10 else 255,) * 3 + (255,) for k in range(60)], 20)
    row = [pixels(transform.blur(px, 3))[(x, 1)][0] for x in range(20)]
    assert row == sorted(row) and row[0] == 0 and row[-1] == 255 and all(row[x] + row[19 - x] == 255 for x in range(20))


def test_blur_sizes():
    assert [brush.blur_radius(s) for s in (8, 20, 1.5, 2, 4, 0, 1)] == [8, 20, 1, 2, 4, 0, 1]


@pytest.mark.parametrize(("start", "end", "row", "want"), [((255, 0, 0, 255), (0, 0, 255, 255), 1, (191, 0, 63, 255)), ((18, 52, 86, 255), (254, 220, 186, 255), 1, None), ((255, 0, 0, 128), (0, 0, 255, 255), 1, (153, 0, 101, 160))])
def test_gradients(spark, start, end, row, want):
    canvas = raster.canvas(spark.range(1), "id", F.lit(1), F.lit(5))
    got = pixels(brush.gradient(canvas, start, end))
    assert got[(0, 0)] == start and got[(0, 4)] == end and want in (None, got[(0, row)])


def test_radial(spark):
    got = pixels(brush.radial_gradient(raster.canvas(spark.range(1), "id", F.lit(7), F.lit(3)), (255,) * 4, (0, 0, 0, 255)))
    assert got[(3, 1)][0] == 255 and got[(2, 1)][0] == 0xAA and got[(1, 0)][0] == 0x40 and got[(0, 1)][0] == 0


def test_hald(spark):
    got = pixels(brush.hald(spark, 2))
    assert len(got) == 64 and got[(1, 0)] == (0x55, 0, 0, 255) and got[(4, 0)] == (0, 0x55, 0, 255)
    with pytest.raises(ValueError):
        brush.hald(spark, 17)


def test_packed_colours(spark):
    r = spark.range(1).select(color.rgb555(F.lit(255), F.lit(0), F.lit(0)).alias("a"), color.rgba5551(F.lit(255), F.lit(0), F.lit(0), F.lit(255)).alias("b"), color.rgba5551(F.lit(0), F.lit(0), F.lit(0), F.lit(127)).alias("c")).first()
    assert (r.a, r.b, r.c) == (0x7C00, 0xF801, 0)


def test_cobs(spark):
    def plain(data):
        out, block, last_full = bytearray(), bytearray(), False
        for k, v in enumerate(data):
            if v:
                block.append(v)
            if not v or len(block) == 254:
                if v and k == len(data) - 1:
                    break
                out += bytes([len(block) + 1]) + block
                block = bytearray()
                last_full = bool(v)
        del last_full
        return bytes(out + bytes([len(block) + 1]) + block)

    rng = random.Random(1)
    cases = [b"", b"\0", b"\0\0", bytes([0x11, 0x22, 0, 0x33]), bytes([0x11, 0, 0, 0]), bytes(range(1, 255)), bytes(range(1, 256)), bytes([7]) * 254 + b"\0", bytes([7]) * 254 + b"\0\x09", bytes([7]) * 508, bytes([7]) * 508 + b"\0" + bytes([5]) * 254 + b"\0\0"]
    cases += [bytes(rng.choice([0, 1, 2]) if rng.random() < 0.02 else 9 for _ in range(rng.randrange(900))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, data binary").select("id", text.cobs(F.col("data")).alias("c")).collect()
    for r in rows:
        assert r.c == plain(cases[r.id]).hex(), cases[r.id]
    assert plain(bytes(range(1, 255))).hex().startswith("ff01") and plain(bytes(range(1, 256))).hex().endswith("02ff")


def test_palette_slices():
    assert len(palette.slice_of("cga")) == 16 and palette.slice_of("cga:2", 3) == palette.slice_of("cga:4,5,6") == palette.slice_of("cga:4..6")
    for bad in ("nosuch", "cga:0", "cga:", "cga:3..1", "cga:1..99", "cga:99"):
        with pytest.raises(ValueError):
            palette.slice_of(bad)
    assert palette.bayer(2) == [[0, 2], [3, 1]] and sorted(sum(palette.bayer(8), [])) == list(range(64))


def test_dithers(spark):
    grey, white = picture(spark, [(128, 128, 128, 255)] * 64, 8), picture(spark, [(255, 255, 255, 255)] * 64, 8)
    both = [0x000000, 0xFFFFFF]
    assert {r.idx for r in palette.quantise(white, both, "strict").collect()} == {1}
    assert {r.idx for r in palette.quantise(grey, both, "strict").collect()} == {None}
    assert {r.idx for r in palette.quantise(grey, both, "bayer").collect()} == {0, 1}
    assert len({r.idx for r in palette.quantise(grey, both).collect()}) == 1


def test_corners(spark):
    got = pixels(transform.radius(picture(spark, [(1, 2, 3, 255)] * 100, 10), 4))
    for (x, y), p in got.items():
        dx, dy = (3 - x if x < 4 else x - 6 if x >= 6 else 0), (3 - y if y < 4 else y - 6 if y >= 6 else 0)
        assert p[3] == (0 if (x < 4 or x >= 6) and (y < 4 or y >= 6) and dx * dx + dy * dy > 16 else 255)


@pytest.mark.parametrize(("w", "h", "tw", "th"), [(7, 5, 3, 11), (4, 4, 9, 2), (5, 3, 1, 1)])
def test_nearest(spark, w, h, tw, th):
    px = picture(spark, [(k, 0, 0, 255) for k in range(w * h)], w)
    got = pixels(transform.resize(px, tw, th))
    assert {k: v[0] for k, v in got.items()} == {(x, y): y * h // th * w + x * w // tw for x in range(tw) for y in range(th)}


def test_runs_and_box(spark):
    px = picture(spark, [(c, 0, 0, 255) for c in (0, 0, 1, 0, 0, 0, 0, 2, 0, 0, 0, 0)], 4)
    assert sorted((r.y, r.start, r.length, r.r) for r in layout.runs(px).collect()) == [(0, 0, 2, 0), (0, 2, 1, 1), (0, 3, 1, 0), (1, 0, 3, 0), (1, 3, 1, 2), (2, 0, 4, 0)]
    box = layout.bounding_box(px, layout.commonest_colour(px)).first()
    assert (box.x0, box.y0, box.x1, box.y1) == (2, 0, 3, 1)


def log(spark, rows):
    return spark.createDataFrame(rows, "client string, key string, id long, t double")


def test_rate_limit_and_quota(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), "k", k, rng.random() * 20) for k in range(120)]
    allowed = {r.id: r.allowed for r in policy.rate_limit(log(spark, rows), 2.0).collect()}
    stored = {r.id: r.stored for r in policy.quota(log(spark, rows), 3, 5.0).collect()}
    bucket, window = {}, {}
    for c, _, k, t in sorted(rows, key=lambda r: (r[3], r[2])):
        tokens, at = bucket.get(c, (2.0, t))
        tokens = min(2.0, tokens + (t - at) * 2.0)
        assert allowed[k] == (tokens >= 1)
        bucket[c] = (tokens - (tokens >= 1), t)
        n, resets = window.get(c, (0, -1.0))
        if t >= resets:
            n, resets = 0, t + 5.0
        assert stored[k] == (n < 3)
        window[c] = (n + (n < 3), resets)


def test_rate_limit_stream(spark, tmp_path):
    from tessera.streaming.policy import rate_limited

    rows = [("a", "k", k, k * 0.2) for k in range(30)]
    log(spark, rows).select("client", "id", "t").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, id long, t double").parquet(str(tmp_path / "in"))
    q = rate_limited(stream, 2.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.id: r.allowed for r in policy.rate_limit(log(spark, rows), 2.0).collect()}
    assert {r.id: r.allowed for r in spark.sql("SELECT * FROM limited").collect()} == want


def test_files_and_archives(spark, tmp_path):
    import gzip
    import io
    import tarfile
    import zipfile

    from tessera.sources import files

    (tmp_path / "a.ppm").write_bytes(b"P6\n# note\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "b.pgm").write_bytes(b"P2 2 2 15 0 15\n5 10")
    (tmp_path / "c.ppm").write_bytes(b"P6\n2 2\n255\nshort")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("logo.png", b"P" * 4096)
        z.writestr("../climbs", b"x")
    with tarfile.open(tmp_path / "e.tar", "w") as t:
        info = tarfile.TarInfo("./nested/" + "long" * 40)
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "f.gz").write_bytes(gzip.compress(b"\0" * 5000))
    (tmp_path / "g.zip").write_bytes(b"PK\3\4broken")
    every = files.blobs(spark, f"file://{tmp_path}")
    kinds = {r.path.rsplit("/", 1)[1]: r.k for r in every.select("path", files.kind_of(F.col("content")).alias("k")).collect()}
    assert kinds == {"a.ppm": "netpbm", "b.pgm": "netpbm", "c.ppm": "netpbm", "d.zip": "zip", "e.tar": None, "f.gz": "gzip", "g.zip": "zip"}
    got = sorted((r.path[-5:], r.x, r.y, r.r, r.g, r.b) for r in files.netpbm_pixels(every.where("path like '%.p_m'")).collect())
    assert got == [("a.ppm", 0, 0, 1, 2, 3), ("a.ppm", 1, 0, 4, 5, 6), ("b.pgm", 0, 0, 0, 0, 0), ("b.pgm", 0, 1, 85, 85, 85), ("b.pgm", 1, 0, 255, 255, 255), ("b.pgm", 1, 1, 170, 170, 170)]
    rows = {(r.path[-5:], r.entry): r for r in files.archive_entries(every.where("path not like '%.p_m'"), most_bytes=4500).collect()}
    assert rows[("d.zip", "logo.png")].content == b"P" * 4096 and rows[("e.tar", "nested/" + "long" * 40)].content == b"abc"
    assert rows[("/f.gz", "")].error == "too large" and rows[("g.zip", None)].error and len(rows) == 4


def test_shelves(spark):
    sizes = [(1, k, w, h) for k, (w, h) in enumerate([(64, 64)] * 4)] + [(2, k, w, h) for k, (w, h) in enumerate([(16, 16), (48, 48), (16, 32), (80, 16)])]
    got = layout.shelves(spark.createDataFrame(sizes, "group_id int, seq int, w int, h int"), quantum=4).collect()
    assert {(r.canvas_w, r.canvas_h) for r in got if r.group_id == 1} == {(128, 128)}
    size = {(g, k): (w, h) for g, k, w, h in sizes}
    rects = [(r.px, r.py, *size[r.group_id, r.seq]) for r in got if r.group_id == 2]
    for i, (x, y, w, h) in enumerate(rects):
        assert all(x + w <= a or a + c <= x or y + h <= b or b + d <= y for a, b, c, d in rects[i + 1 :])


def test_error_diffusion_keeps_the_mean(spark):
    idx = [r.idx for r in palette.diffuse(picture(spark, [(128, 128, 128, 255)] * 256, 16), [0x000000, 0xFFFFFF]).collect()]
    assert 0.4 < sum(idx) / len(idx) < 0.6 and len(idx) == 256


def test_most_apart(spark):
    px = picture(spark, [(0, 0, 0, 255)] * 5 + [(1, 1, 1, 255)] * 4 + [(255, 0, 0, 255)] * 2, 11)
    colours = [0x000000, 0x010101, 0xFF0000, 0x00FF00]
    assert [r.idx for r in palette.most_apart(px, colours, 3).orderBy("place").collect()] == [0, 2, 1]
    assert [r.idx for r in palette.most_apart(px, colours, 4).orderBy("place").collect()] == [0, 1, 2, 3]


def test_most_voted_takes_from_the_whole_palette(spark):
    px = picture(spark, [(0, 0, 0, 255)] * 2 + [(255, 0, 0, 255)] * 5, 7)
    colours = [0x000000, 0x00FF00, 0x0000FF, 0xFF0000]
    assert [(r.idx, r.votes, r.place) for r in palette.most_voted(px, colours, 3).orderBy("place").collect()] == [(3, 5, 1), (0, 2, 2), (1, 0, 3)]
    assert {r.idx for r in palette.most_voted(px, colours, 9).collect()} == {0, 1, 2, 3}


def test_diffusion_equals_pixel_by_pixel(spark):
    rng = random.Random(5)
    w, h, colours = 9, 7, [0x000000, 0xFFFFFF, 0xAA3311, 0x2255CC, 0x55FF55]
    values = [tuple(rng.randrange(256) for _ in range(3)) + (255,) for _ in range(w * h)]
    now = {(k % w, k // w): list(v[:3]) for k, v in enumerate(values)}
    owed, want = {}, {}
    for y in range(h):
        for x in range(w):
            c = [min(255, max(0, now[x, y][k] + owed.get((x, y, k), 0))) for k in range(3)]
            rgb = [(p >> 16, p >> 8 & 255, p & 255) for p in colours]
            want[x, y] = best = min(range(len(rgb)), key=lambda i: (sum(q * (a - b) ** 2 for q, a, b in zip((2, 4, 3), c, rgb[i], strict=True)), i))
            for dx, dy, part in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                for k in range(3):
                    owed[x + dx, y + dy, k] = owed.get((x + dx, y + dy, k), 0) + int((c[k] - rgb[best][k]) * part / 16)
    for shape in (w, w * h, 1):
        got = palette.diffuse(picture(spark, values, shape), colours).collect()
        assert len(got) == w * h
        if shape == w:
            assert {(r.x, r.y): r.idx for r in got} == want


def test_urls(spark):
    from tessera.functions import url

    rows = [("HTTP://u:p@[::1]:80/a?b#c",), ("http://a b/",), ("http://h:x/",), ("mailto:a@b",), ("//h",), ("",), ("x/../y?",), ("http://h%2/",), ("http://[::1/x",)]
    u = url.parse(F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "u string").select(u["scheme"], u["userinfo"], u["host"], u["port"], u["path"], u["query"]).collect()]
    none = (None,) * 6
    assert got == [("http", "u:p", "[::1]", "80", "/a", "b"), none, none, ("mailto", "", None, "", "a@b", None), ("", "", "h", "", "", None), ("", "", None, "", "", None), ("", "", None, "", "x/../y", ""), none, none]
    # RFC 3986, 5.4.1 and 5.4.2.
    base, cases = "http://a/b/c/d;p?q", {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
        "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y",
    }
    found = spark.createDataFrame([(r,) for r in cases], "r string").select("r", url.resolve(url.parse(F.lit(base)), url.parse(F.col("r"))).alias("t")).collect()
    assert {r.r: r.t for r in found} == cases
    texts = ["a%20b+c", "%zz%4", "%C3%A9", "100%", "é/ ?"]
    back = spark.createDataFrame([(t,) for t in texts], "t string").select(url.percent_decode(F.col("t"), True), url.percent_encode_path(F.col("t"))).collect()
    assert [r[0] for r in back] == ["a b c", "%zz%4", "é", "100%", "é/ ?"] and back[4][1] == "%C3%A9/%20%3F" and back[3][1] == "100%25"


def test_names_and_frames(spark):
    from tessera.functions import media, names

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(names.colour(F.lit(x))) for x in ("AliceBlue", "#F00", "#12345678", "gray50", "grey101", "#12", "transparent")] == [0xFFF0F8FF, 0xFFFF0000, 0x78123456, 0xFF7F7F7F, None, None, 0]
    assert value(names.unescape(F.lit(r"a\nb\\c\qd" + "\\"))) == "a\nb\\c\\qd\\"
    assert tuple(value(names.crop_geometry(F.lit("8x4+1-2")))) == (1, -2, 8, 4) and value(names.crop_geometry(F.lit("8x4+1"))) is None and value(names.size(F.lit("0x4"))) is None
    whole = media.frame(F.lit("image/x-zcis"), F.lit("name with spaces.zcis"), F.lit("hex"), F.unhex(F.lit("00FF1000")))
    entry = value(media.unframe(whole))
    assert (entry.content_type, entry.filename, entry.encoding, bytes(entry.body)) == ("image/x-zcis", "name with spaces.zcis", "hex", b"\x00\xff\x10\x00")
    assert value(media.unframe(F.substring(whole, 1, 20))) is None
    assert value(media.format_of_path(F.lit("a.b/c"))) == "raw" and value(media.format_of_path(F.lit("x.JPG"))) == "jpeg"


def test_grid_that_does_not_fit(spark):
    sizes = spark.createDataFrame([("g", k, 1, 1) for k in range(5)], "group_id string, seq int, w int, h int")
    assert layout.grid(sizes, 3, rows=2).count() == 5
    with pytest.raises(Exception, match="more pictures"):
        layout.grid(sizes, 2, rows=2).collect()


def test_free_requests(spark):
    log = spark.createDataFrame([(k, c, 0.0) for k, c in enumerate(["", None, "a", "a", ""])], "id long, client string, t double")
    assert {r.id: r.allowed for r in policy.rate_limit(log, 1.0).collect()} == {0: True, 1: True, 2: True, 3: False, 4: True}
    assert all(r.allowed for r in policy.rate_limit(log, 0.0).collect())


def test_small_palettes_stay_whole(spark):
    px = picture(spark, [(255, 255, 255, 255)] * 4, 2)
    assert [(r.idx, r.place) for r in palette.most_apart(px, [0, 0xFFFFFF], 4).orderBy("place").collect()] == [(0, 1), (1, 2)]


def test_bitmaps(spark):
    from tessera.sources import files

    plain, raw = b"P1\n# note\n4 2\n0101 1 0 1 0\n", b"P4\n4 2\n" + bytes([0b01010000, 0b10100000])
    rows = files.netpbm_pixels(spark.createDataFrame([("a", plain), ("b", raw), ("c", b"P4\n9 9\nx"), ("d", b"P1 2")], "path string, content binary")).collect()
    of = lambda p: {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in rows if r.path == p}
    assert of("a") == of("b") and len(rows) == 16 and of("a")[0, 0] == (255, 255, 255, 255) and of("a")[1, 0] == (0, 0, 0, 255) and of("b")[0, 1] == (0, 0, 0, 255)
