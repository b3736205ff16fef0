"""Fills, boxes, runs and slack against plain Python, pixel by pixel."""

import random
from collections import Counter

import numpy as np
import pytest

from tessera.operators import drawing

HEAD = "image_id long, x int, y int, r int, g int, b int, a int"
CUTS = "image_id long, seq int, x int, y int, w int, h int"


def near(one, two, slack):
    return one[3] == two[3] and all(abs(one[k] - two[k]) <= slack for k in range(3))


def plain_flatten(px, cuts, worth, slack=0, bytes_per_pixel=4, even=False):
    """cut -> (ground or None, box)."""
    out = {}
    for seq, x, y, w, h in cuts:
        own = {(i, j): px[i, j] for j in range(y, y + h) for i in range(x, x + w)}
        counts = Counter(own.values())
        most = max(counts.values())
        ground = min((c for c, n in counts.items() if n == most), key=lambda c: (c[3], *c[:3]))
        off = [p for p, c in own.items() if not near(c, ground, slack)]
        box = (x, y, 0, 0)
        if off:
            x0, y0 = min(p[0] for p in off), min(p[1] for p in off)
            box = (x0, y0, max(p[0] for p in off) - x0 + 1, max(p[1] for p in off) - y0 + 1)
            if even:
                bx, by = box[0] - box[0] % 2, box[1] - box[1] % 2
                bw, bh = box[2] + box[0] - bx, box[3] + box[1] - by
                box = (bx, by, bw + bw % 2, bh + bh % 2)
        fits = not off or not even or (box[0] + box[2] <= x + w and box[1] + box[3] <= y + h)
        if fits and (w * h - box[2] * box[3]) * bytes_per_pixel > worth:
            out[seq] = (ground, box)
        else:
            out[seq] = (None, (x, y, w, h))
    return out


def plain_merge(fills):
    """[(x, y, w, h, colour)], first across, then down."""
    for key, same, at, size in ((lambda f: (f[1], f[0]), (1, 3, 4), 0, 2), (lambda f: (f[0], f[1]), (0, 2, 4), 1, 3)):
        out = []
        for f in sorted(fills, key=key):
            if out and all(out[-1][k] == f[k] for k in same) and out[-1][at] + out[-1][size] == f[at]:
                last = list(out[-1])
                last[size] += f[size]
                out[-1] = tuple(last)
            else:
                out.append(f)
        fills = out
    return fills


def plain_draws(px, boxes, n_fills, stretched=True):
    total = n_fills
    for x, y, w, h in boxes:
        for j in range(y, y + h):
            paints = 2 if stretched and h > 1 and (j - y) % 2 else 1
            total += paints * sum(i == x or px[i, j] != px[i - 1, j] for i in range(x, x + w))
    return total


def plain_walk(px, boxes, slack):
    """boxes: (ground or None, box); pixels after pulling."""
    px = dict(px)
    if slack <= 0:
        return px
    for ground, (x, y, w, h) in boxes:
        for j in range(y, y + h):
            level, run = (slack + (j - y) * 7 % 16) // 16, None
            for i in range(x, x + w):
                own = px[i, j]
                if ground is not None and near(own, ground, level):
                    run = ground
                elif run is None or not near(own, run, level):
                    run = own
                    if j > y and near(own, px[i, j - 1], level) and (i + 1 == x + w or near(px[i + 1, j], px[i, j - 1], level)):
                        run = px[i, j - 1]
                px[i, j] = run
    return px


def plain_search(px, cuts, worth, percent):
    plain = plain_draws(px, [c[1:] for c in cuts], 0)
    target = plain - plain * percent // 100

    def at(slack):
        flat = plain_flatten(px, cuts, worth, slack // 16)
        fills = plain_merge([(*c[1:], flat[c[0]][0]) for c in cuts if flat[c[0]][0] is not None])
        return plain_draws(plain_walk(px, flat.values(), slack), [b for _, b in flat.values()], len(fills))

    if at(0) <= target:
        return 0
    low, high = 1, 512
    while low < high:
        middle = low + (high - low) // 2
        low, high = (low, middle) if at(middle) <= target else (middle + 1, high)
    return low


def made(seed, n=6):
    """Pictures of 9 by 8 with colours near each other, each with cuts of a grid, and clear pixels in some."""
    rng = random.Random(seed)
    pictures, cuts = {}, {}
    for d in range(n):
        ground = tuple(rng.randrange(256) for _ in range(3)) + (255,)
        px = {}
        for j in range(8):
            for i in range(9):
                if rng.random() < 0.45:
                    px[i, j] = ground
                else:
                    around = px.get((i - 1, j), ground)
                    px[i, j] = tuple(min(255, max(0, c + rng.randrange(-9, 10))) for c in around[:3]) + (rng.choice([255, 255, 255, 0]) if d % 3 == 0 else 255,)
        xs, ys = ([0, 4, 9], [0, 4, 8]) if d % 2 else ([0, 9], [0, 3, 8])
        pictures[d] = px
        cuts[d] = [(k, x, y, x2 - x, y2 - y) for k, (y, y2, x, x2) in enumerate((y, y2, x, x2) for y, y2 in zip(ys, ys[1:], strict=False) for x, x2 in zip(xs, xs[1:], strict=False))]
    return pictures, cuts


def tables(spark, pictures, cuts):
    px = spark.createDataFrame([(d, i, j, *c) for d, p in pictures.items() for (i, j), c in p.items()], HEAD)
    return px.repartition(3), spark.createDataFrame([(d, *c) for d, cs in cuts.items() for c in cs], CUTS)


def key(c):
    return c[3] << 24 | c[0] << 16 | c[1] << 8 | c[2]


@pytest.mark.parametrize(("worth", "even", "slack"), [(0, False, 0), (30, False, 6), (30, True, 0), (10_000, False, 0)])
def test_flatten_and_merge(spark, worth, even, slack):
    from pyspark.sql import functions as F

    pictures, cuts = made(worth + slack)
    px, rects = tables(spark, pictures, cuts)
    flat = drawing.flatten(px, rects.withColumn("near", F.lit(slack)), worth, 2 if even else 4, even, "near")
    got = {(r.image_id, r.seq): (r.ground, (r.box_x, r.box_y, r.box_w, r.box_h)) for r in flat.collect()}
    want = {(d, s): (None if g is None else key(g), b) for d in pictures for s, (g, b) in plain_flatten(pictures[d], cuts[d], worth, slack, 2 if even else 4, even).items()}
    assert got == want
    merged = {}
    for r in drawing.fills_of(flat).orderBy("image_id", "place").collect():
        merged.setdefault(r.image_id, []).append((r.x, r.y, r.w, r.h, r.ground))
    for d in pictures:
        assert merged.get(d, []) == plain_merge([(*c[1:], want[d, c[0]][0]) for c in cuts[d] if want[d, c[0]][0] is not None])


def test_merge_of_a_grid(spark):
    """Eight equal cuts in a row are one fill, rows of equal extent another, and what doesn't line up stays."""
    rows = [(1, k, 4 * (k % 4), 4 * (k // 4), 4, 4, 7, k != 2) for k in range(8)] + [(1, 9, 0, 8, 8, 4, 7, True), (1, 10, 8, 8, 8, 4, 9, True), (2, 0, 0, 0, 4, 4, 7, True), (2, 1, 5, 0, 4, 4, 7, True), (2, 2, 0, 4, 4, 3, 7, True)]
    fills = spark.createDataFrame(rows, "image_id long, seq int, x int, y int, w int, h int, ground long, solid boolean")
    got = sorted((r.image_id, r.place, r.x, r.y, r.w, r.h, r.ground, r.solid) for r in drawing.merge_fills(fills).collect())
    assert got == [(1, 1, 0, 0, 16, 8, 7, False), (1, 2, 0, 8, 8, 4, 7, True), (1, 3, 8, 8, 8, 4, 9, True), (2, 1, 0, 0, 4, 7, 7, True), (2, 2, 5, 0, 4, 4, 7, True)]


@pytest.mark.parametrize("slack", [0, 5, 60, 200, 512])
def test_pulled_equals_pixel_by_pixel(slack):
    pictures, cuts = made(slack + 1, 4)
    for d, px in pictures.items():
        for ground, (x, y, w, h) in plain_flatten(px, cuts[d], 0, slack // 16).values():
            if w:
                keys = np.array([[[key(px[i, j]) for i in range(x, x + w)] for j in range(y, y + h)]])
                under = np.full(keys.shape, -1 if ground is None else key(ground))
                want = plain_walk(px, [(ground, (x, y, w, h))], slack)
                assert drawing.pulled(keys, under, np.array([slack]))[0].tolist() == [[key(want[i, j]) for i in range(x, x + w)] for j in range(y, y + h)]


def test_plan_and_search(spark):
    from pyspark.sql import functions as F

    pictures, cuts = made(77, 5)
    px, rects = tables(spark, pictures, cuts)
    drawn, boxes, fills = drawing.planned(px, rects.withColumn("slack", (F.col("image_id") * 40).cast("int")), 24, "slack")
    now = {d: {} for d in pictures}
    for r in drawn.collect():
        now[r.image_id][r.x, r.y] = (r.r, r.g, r.b, r.a)
    counts = {r.image_id: r.draws for r in drawing.draws(drawn, boxes, fills).collect()}
    for d in pictures:
        flat = plain_flatten(pictures[d], cuts[d], 24, d * 40 // 16)
        assert now[d] == plain_walk(pictures[d], flat.values(), d * 40)
        merged = plain_merge([(*c[1:], flat[c[0]][0]) for c in cuts[d] if flat[c[0]][0] is not None])
        assert counts[d] == plain_draws(now[d], [b for _, b in flat.values()], len(merged))
    for percent in (0, 55):
        got = {r.image_id: r.slack for r in drawing.least_slack(px, rects, 24, percent).collect()}
        assert got == {d: plain_search(pictures[d], cuts[d], 24, percent) if percent else 0 for d in pictures}


def plain_masks(px, flat, worth, stretched):
    """[(seq, refine, x, y, w, h, spared, bytes)], from bitmaps that are written out and packed."""
    out = []
    for seq, (ground, (x, y, w, h)) in flat.items():
        if not w or ground is None:
            plain = {}
        else:
            plain = {p: px[p] == ground for p in ((i, j) for j in range(y, y + h) for i in range(x, x + w))}
        twice = {}
        if stretched and h > 1:
            for j in range(y, y + h - 1, 2):
                for i in range(x, x + w):
                    twice[i, j] = not plain.get((i, j), False) and px[i, j] == px[i, j + 1]
        for refine, spared in ((False, plain), (True, twice)):
            some = [p for p, v in spared.items() if v]
            if not some:
                continue
            runs = sum((2 if not refine and stretched and h > 1 and (j - y) % 2 else 1) for i, j in some if not (i > x and spared.get((i - 1, j), False)))
            x0, y0, x1, y1 = min(p[0] for p in some), min(p[1] for p in some), max(p[0] for p in some), max(p[1] for p in some)
            size = 128 + 769
            for j in range(y0, y1 + 1):
                bits = "".join("0" if spared.get((i, j), False) else "1" for i in range(x0, x1 + 1))
                row = [int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8)]
                row += [0] * (len(row) % 2)
                while row:
                    n = 1
                    while n < min(63, len(row)) and row[n] == row[0]:
                        n += 1
                    size += 2 if n > 1 or row[0] >= 0xC0 else 1
                    row = row[n:]
            if runs * 124 > worth + size:
                out.append((seq, refine, x0, y0, x1 - x0 + 1, y1 - y0 + 1, runs, size))
    return sorted(out)


@pytest.mark.parametrize("stretched", [True, False])
def test_masks(spark, stretched):
    rng = random.Random(31)
    sizes = {0: (1100, 4), 1: (40, 17), 2: (9, 3), 3: (130, 9)}
    colours = [(9, 9, 9, 255), (200, 10, 30, 255), (0, 0, 250, 255)]
    pictures, cuts = {}, {}
    for d, (w, h) in sizes.items():
        now, px = colours[0], {}
        for j in range(h):
            for i in range(w):
                now = rng.choice(colours) if rng.random() < (0.02 if d == 0 else 0.3) else now
                px[i, j] = px[i, j - 1] if j % 2 and rng.random() < 0.8 else now
        pictures[d], cuts[d] = px, [(0, 0, 0, w // 2, h), (1, w // 2, 0, w - w // 2, h)]
    px, rects = tables(spark, pictures, cuts)
    # Cuts that are drawn whole on a fill of all of them, as a worth below nothing makes them.
    flat = {d: {s: (g, b) for s, (g, b) in plain_flatten(pictures[d], cuts[d], -1).items()} for d in pictures}
    boxes = drawing.flatten(px, rects, -1).cache()
    fills = drawing.fills_of(boxes)
    found = drawing.masks(px, boxes, fills, 50, stretched)
    rows = {d: [] for d in pictures}
    for r in found.collect():
        rows[r.image_id].append((r.seq, r.refine, r.x, r.y, r.w, r.h, r.spared, r.bytes))
    want = {d: plain_masks(pictures[d], flat[d], 50, stretched) for d in pictures}
    assert {d: sorted(v) for d, v in rows.items()} == want and sum(map(len, want.values())) >= 3
    counts = {r.image_id: r.draws for r in drawing.draws(px, boxes, fills, stretched, found).collect()}
    for d in pictures:
        n_fills = len(plain_merge([(*c[1:], flat[d][c[0]][0]) for c in cuts[d] if flat[d][c[0]][0] is not None]))
        assert counts[d] == max(0, plain_draws(pictures[d], [b for _, b in flat[d].values()], n_fills, stretched) - sum(m[6] for m in want[d]))


def broadcasts(spark, run):
    """What ``run`` returns, and the rows of each table that was broadcast meanwhile."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    before = store.executionsCount()
    result = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions = store.executionsList().drop(before).iterator()
    while executions.hasNext():
        number = executions.next().executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while node.name() == "BroadcastExchange" and metrics.hasNext():
                m = metrics.next()
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return result, out


def test_search_broadcasts_nothing(spark):
    pictures, cuts = made(5, 3)
    px, rects = tables(spark, pictures, cuts)
    got, sent = broadcasts(spark, lambda: {r.image_id: r.slack for r in drawing.least_slack(px, rects, 24, 55).collect()})
    assert sent == [] and got == {d: plain_search(pictures[d], cuts[d], 24, 55) for d in pictures}


def test_search_over_batches(spark):
    """Pictures begin and end anywhere in an Arrow batch, or go on over several; their ids may be of any type."""
    from pyspark.sql import functions as F

    pictures, cuts = made(9, 7)
    px, rects = tables(spark, pictures, cuts)
    rects = rects.union(spark.createDataFrame([(7, 0, 0, 0, 2, 2), (8, 0, 0, 0, 0, 3)], CUTS))  # cuts without pixels
    named = lambda df: df.withColumn("image_id", F.struct(F.concat(F.lit("p"), "image_id").alias("name"), F.lit(1).alias("k")))
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    try:
        for n in (1, 3):
            spark.conf.set(most, n)
            got = {r.image_id.name: r.slack for r in drawing.least_slack(named(px), named(rects), 24, 40).collect()}
            assert got == {f"p{d}": plain_search(pictures[d], cuts[d], 24, 40) for d in pictures} | {"p7": 0, "p8": 0}
    finally:
        spark.conf.set(most, before)


def test_search_with_missing_pixels(spark):
    """A box that misses pixels stays as it is, and so its runs aren't fewer with any slack."""
    rows = [(d, i, 0, v, v, v, 255) for d, own in ((0, [10, 11, None, 10, 11, None]), (1, [10, 11, 10, 11, 10, 11])) for i, v in enumerate(own) if v is not None]
    px, rects = spark.createDataFrame(rows, HEAD), spark.createDataFrame([(d, 0, 0, 0, 6, 1) for d in (0, 1)], CUTS)
    assert {r.image_id: r.slack for r in drawing.least_slack(px, rects, 1000, 50).collect()} == {0: 512, 1: 16}


@pytest.mark.parametrize("at_once", [1, 100, 1 << 20])
def test_cuts_in_a_task(monkeypatch, at_once):
    monkeypatch.setattr(drawing, "_AT_ONCE", at_once)
    pictures, cuts = made(at_once, 4)
    for slack, worth in ((0, 24), (70, 24), (300, 0)):
        rows = [(d, c) for d in pictures for c in cuts[d]]
        packed = [np.array([((j * w + i) << 32) + key(pictures[d][x + i, y + j]) for j in range(h) for i in range(w)]) for d, (_, x, y, w, h) in rows]
        seen = set()
        for at, keys in drawing.Cuts(np.array([c[1:] for _, c in rows]), packed).tables():
            ground, boxes, now, cost = drawing.as_drawn(keys, drawing.commonest(keys), np.full(len(at), slack), worth, 1)
            for k, n in enumerate(at.tolist()):
                d, c = rows[n]
                want, box = plain_flatten(pictures[d], [c], worth, slack // 16)[c[0]]
                walked = plain_walk(pictures[d], [(want, box)], slack)
                assert ground[k] == (-1 if want is None else key(want))
                assert (boxes[k] + (c[1], c[2], 0, 0)).tolist() == list(box) and cost[k] == plain_draws(walked, [box], 0)
                assert now[k].tolist() == [[key(walked[c[1] + i, c[2] + j]) for i in range(c[3])] for j in range(c[4])]
                seen.add(n)
        assert len(seen) == len(rows)


def test_walk_broadcasts_no_pixels(spark):
    """Tables of a row a picture at most, however small the files are in which cuts and fills are kept."""
    from tessera.plans import further

    rows, sent = broadcasts(spark, lambda: further.slack_walk(spark, "/root/testdata/sf0.001").collect())
    assert len(rows) == 500 and max(sent) <= 500


def test_walk_with_missing_pixels(spark):
    """A box that misses pixels stays as it is, also beside one that doesn't; pixels outside of cuts stay too."""
    own = {0: [10, 11, None, 10, 11, None, 90], 1: [10, 11, 10, 11, 10, 11, 91]}
    rows = [(d, i, 0, v, v, v, 255) for d, values in own.items() for i, v in enumerate(values) if v is not None]
    px, rects = spark.createDataFrame(rows, HEAD), spark.createDataFrame([(0, 0, 0, 0, 6, 1), (1, 0, 0, 0, 6, 1), (1, 1, 7, 0, 2, 2), (2, 0, 0, 0, 0, 4)], CUTS)
    from pyspark.sql import functions as F

    drawn, boxes, fills = drawing.planned(px, rects.withColumn("slack", F.lit(16)), 1000, "slack")
    got = {(r.image_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in drawn.collect()}
    assert got == {(d, i, 0): (v, v, v, 255) for d, values in {0: own[0], 1: [10] * 6 + [91]}.items() for i, v in enumerate(values) if v is not None}
    flat = sorted((r.image_id, r.seq, r.ground, r.box_x, r.box_y, r.box_w, r.box_h) for r in boxes.collect())
    assert flat == [(0, 0, None, 0, 0, 6, 1), (1, 0, None, 0, 0, 6, 1), (1, 1, None, 7, 0, 2, 2), (2, 0, None, 0, 0, 0, 4)] and fills.count() == 0
    assert {r.image_id: r.draws for r in drawing.draws(drawn, boxes, fills).collect()} == {0: 4, 1: 1, 2: 0}
