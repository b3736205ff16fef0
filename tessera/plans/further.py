"""Registered queries beside their SQL: the cache bounded by bytes, and what fills, boxes and slack save in drawing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import blocks, escape, glob, media
from tessera.operators import byte_cache, drawing
from tessera.plans import oracles as O
from tessera.plans.queries import _gray
from tessera.sources import files, raster
from tessera.sources.storage import materialize

_BYTES, _TTL = 60_000, 43_200.0


def _sized_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of 200 users' keys for each type; the size of a key's entry is a hundred times its largest value, at least 1."""
    events = raster.table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("id"), F.concat_ws("|", "event_type", F.col("user_id") % 200).alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), "value")
    sizes = rows.groupBy("key").agg(F.greatest(F.lit(1), F.floor(F.max("value") * 10 + 0.5)).cast("long").alias("size"))
    return rows.drop("value").join(sizes, "key")


def byte_lru(spark: SparkSession, sf_dir: str, ranges: int) -> DataFrame:
    log = _sized_log(spark, sf_dir)
    found = byte_cache.byte_lru(log.withColumn("size", F.when(F.col("size") % 40 == 0, _BYTES + F.col("size")).otherwise(F.col("size"))), _BYTES, _TTL, rows_per_range=ranges)
    return found.select("id", "hit", "outcome", "distance")


def byte_lru_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cache.lru_totals(byte_cache.byte_lru(_sized_log(spark, sf_dir), _BYTES, _TTL), _BYTES)


def framed(spark: SparkSession, sf_dir: str, step: int = 64) -> DataFrame:
    """Pictures of 8 by 8 in grey levels, with an even frame whose width depends on the picture."""
    inside = F.col("x").between(1 + F.col("image_id") % 3, 5) & F.col("y").between(F.col("image_id") % 2, 6)
    level = F.when(inside, F.floor(F.col("v") / step).cast("int") * step).otherwise((F.col("image_id") % 2 * 64).cast("int"))
    px = _gray(spark, sf_dir).withColumn("v", level)
    return px.select("image_id", "x", "y", *(F.col("v").alias(c) for c in "rgb"), F.lit(255).alias("a"))


#: The cuts of pictures by the remainder of their number: (x, y, w, h).
_CUTS = {0: [(0, 0, 8, 8)], 1: [(0, 0, 4, 4), (4, 0, 4, 4), (0, 4, 4, 4), (4, 4, 4, 4)], 2: [(0, 0, 5, 8), (5, 0, 3, 3), (5, 3, 3, 5)], 3: [(x, y, 2, 2) for y in (0, 2, 4, 6) for x in (0, 2, 4, 6)]}


def cuts_of(px: DataFrame) -> DataFrame:
    rows = [(m, k, *c) for m, cs in _CUTS.items() for k, c in enumerate(cs)]
    table = F.broadcast(px.sparkSession.createDataFrame(rows, "m int, seq int, x int, y int, w int, h int"))
    return px.select("image_id").distinct().withColumn("m", (F.col("image_id") % len(_CUTS)).cast("int")).join(table, "m").drop("m")


def fills_kept(spark: SparkSession, sf_dir: str, even: bool, levels: int = 0) -> DataFrame:
    px = framed(spark, sf_dir)
    return drawing.flatten(px, cuts_of(px).withColumn("levels", F.lit(levels)), 20, 2 if even else 4, even, "levels").drop("levels")


def fills_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = framed(spark, sf_dir)
    return drawing.fills_of(drawing.flatten(px, cuts_of(px), 0))


def draw_cost(spark: SparkSession, sf_dir: str, stretched: bool) -> DataFrame:
    px = framed(spark, sf_dir)
    flat = drawing.flatten(px, cuts_of(px), 20)
    return drawing.draws(px, flat, drawing.fills_of(flat), stretched)


def masks_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = framed(spark, sf_dir, 128)
    flat = materialize(drawing.flatten(px, cuts_of(px).where("image_id % 4 in (0, 2)"), 0), "flat")
    return drawing.masks(px, flat, drawing.fills_of(flat), 0)


def draw_cost_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = framed(spark, sf_dir, 128)
    flat = materialize(drawing.flatten(px, cuts_of(px).where("image_id % 4 in (0, 2)"), 0), "flat")
    fills = materialize(drawing.fills_of(flat), "fills")
    return drawing.draws(px, flat, fills, True, drawing.masks(px, flat, fills, 0))


def slack_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst error and the draws of each picture, at slacks from 3 to 34 levels."""
    px = framed(spark, sf_dir, 1)
    cuts = cuts_of(px).withColumn("slack", (F.lit(50) + F.col("image_id") % 6 * 100).cast("int"))
    drawn, boxes, fills = drawing.planned(px, cuts, 20, "slack")
    worst = px.join(drawn.select("image_id", "x", "y", F.col("r").alias("now")).hint("merge"), ["image_id", "x", "y"]).groupBy("image_id").agg(F.max(F.abs(F.col("r") - F.col("now"))).alias("worst"))
    return worst.join(drawing.draws(drawn, boxes, fills), "image_id")


def slack_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = framed(spark, sf_dir, 1)
    return drawing.least_slack(px, cuts_of(px), 20, 40)


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = raster.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_replace("url", "^[a-z]+://|[?#].*$", "").alias("path"), F.coalesce(F.length("html"), F.lit(0)).alias("bytes"))


def names_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of written pictures by patterns with escapes, padded, cut and zero-filled."""
    k = F.col("page_id")
    values = {**escape.of_path(F.col("path")), "index": k, "count": F.lit(250), "width": k * 7 % 500, "height": k * 11 % 300, "bytes": F.col("bytes"), "alpha": F.when(k % 2 == 0, "True").otherwise("False")}
    of = lambda pattern: escape.expand(pattern, values)
    return _page_paths(spark, sf_dir).select("page_id", of("%t-%03d.%e").alias("plain"), of("%-12t|%10B|%[directory]").alias("padded"), of("%.3t%%%05h %f").alias("short"), of("out/%s of %n, %wx%[height] %A.png").alias("sizes"))


#: Patterns of paths.
_GLOBS = {"endings": "*.example.com/**/*.html|htm", "folder": "m.*/en/*", "deep": "**/1*", "middle": "www.**/de/*"}


def paths_globbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).select("page_id", *(glob.matches(F.col("path"), p).alias(n) for n, p in _GLOBS.items()))


def blob_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs by what their bytes, else their types, else their paths say."""
    k = F.col("page_id")
    of = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (k % len(v) + 1).cast("int"))
    first = F.unhex(of("89504E470D0A1A0A00", "50350A", "213C617263683E0A" + b"0000000000.txt/ ".hex() + "20" * 42 + "600A", "213C617263683E0A" + b"other.txt/".hex(), "", "3C68746D6C3E", "504B0304"))
    path = F.concat("path", of(".dds", "", ".tar"))
    found = media.blob_format(files.kind_of(first), of("image/GIF; q=1", "text/html", "", "image/x-pcx"), path)
    return _page_paths(spark, sf_dir).select("page_id", found.alias("b")).select("page_id", "b.format", "b.content_type")


def requests_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over the limits of sources and steps, and grids over those of cells and gaps."""
    k = F.col("event_id")
    rows = raster.table(spark, sf_dir, "events").select("event_id")
    side = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    cell, gap = F.when(k % 3 > 0, side(k % 3000, k % 700)), F.when(k % 2 > 0, side(k % 2500, F.lit(1)))
    return rows.select("event_id", media.over_limits(k % 5, k % 9, 3, 6).alias("refused"), media.grid_too_large(cell, gap, 2048).alias("grid"), media.grid_too_large(cell, gap, 0).alias("unlimited"))


def etc1_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of grey pictures taken as blocks of a texture, four blocks wide."""
    rows = _gray(spark, sf_dir).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("p"))
    block = F.unhex(F.array_join(F.transform("p", lambda p: F.lpad(F.hex(p["v"].cast("long")), 2, "0")), ""))
    return blocks.etc1_pixels(rows.select("image_id", (F.col("y") % 4).alias("bx"), F.floor(F.col("y") / 4).cast("int").alias("by"), block.alias("block")))


QUERIES = {f.__name__: f for f in (byte_lru_totals, fills_merged, masks_kept, draw_cost_masked, slack_walk, slack_least, names_written, paths_globbed, blob_formats, requests_refused, etc1_decoded)}
QUERIES |= {"byte_lru": partial(byte_lru, ranges=1 << 18), "byte_lru_ranges": partial(byte_lru, ranges=300)}
QUERIES |= {"fills_kept": partial(fills_kept, even=False), "fills_even": partial(fills_kept, even=True), "fills_near": partial(fills_kept, even=False, levels=64)}
QUERIES |= {"draw_cost": partial(draw_cost, stretched=True), "draw_cost_flat": partial(draw_cost, stretched=False)}


# ---- the same in SQL


def _lru(size: str) -> str:
    """By the definition: different keys between two requests of a key, each by its last request there."""
    return (
        "e AS (SELECT event_id AS id, event_type || '|' || (user_id % 200) AS key, epoch_us(ts) / 1000000.0 AS t, value FROM events), "
        "z AS (SELECT key, greatest(1, CAST(floor(max(value) * 10 + 0.5) AS BIGINT)) AS size FROM e GROUP BY key), "
        f"s AS (SELECT id, key, t, {size} AS size FROM e JOIN z USING (key)), "
        f"n AS (SELECT *, CASE WHEN size <= {_BYTES} THEN size ELSE 0 END AS own, row_number() OVER (ORDER BY t, id) AS pos FROM s), "
        "l AS (SELECT *, lag(pos) OVER w AS prev, lag(t) OVER w AS before_t, lead(pos) OVER w AS next FROM n WINDOW w AS (PARTITION BY key ORDER BY pos)), "
        "d AS (SELECT i.id, i.key, i.pos, i.size, i.own, i.t, i.before_t, i.prev, i.next, coalesce(sum(m.own), 0) AS apart FROM l i LEFT JOIN l m ON m.pos > i.prev AND m.pos < i.pos AND coalesce(m.next, 9e15) > i.pos GROUP BY ALL), "
        f"f AS (SELECT *, CASE WHEN size > {_BYTES} THEN 'oversize' WHEN prev IS NULL THEN 'first' WHEN apart + own > {_BYTES} THEN 'evicted' WHEN t - before_t >= {_TTL} THEN 'expired' ELSE 'hit' END AS outcome FROM d)"
    )


_FRAMED = "fr AS (SELECT image_id, x, y, CAST(CASE WHEN x BETWEEN 1 + image_id % 3 AND 5 AND y BETWEEN image_id % 2 AND 6 THEN v // {step} * {step} ELSE image_id % 2 * 64 END AS INT) AS v FROM gr)"
_CUT_ROWS = "cu AS (SELECT image_id, seq, c.x, c.y, c.w, c.h FROM (SELECT DISTINCT image_id FROM fr) i JOIN (VALUES " + ", ".join(f"({m}, {k}, {x}, {y}, {w}, {h})" for m, cs in _CUTS.items() for k, (x, y, w, h) in enumerate(cs)) + f") c(m, seq, x, y, w, h) ON i.image_id % {len(_CUTS)} = c.m)"
_WHITE = "(4278190080 + {v} * 65793)"


def _flat(worth: int, bytes_per_pixel: int = 4, even: bool = False, levels: str = "0", step: int = 64) -> str:
    box = "coalesce(x0, x) AS b0, coalesce(y0, y) AS b1, coalesce(x1 - x0 + 1, 0) AS b2, coalesce(y1 - y0 + 1, 0) AS b3"
    if even:
        box = "coalesce(x0 - x0 % 2, x) AS b0, coalesce(y0 - y0 % 2, y) AS b1, coalesce(((x1 + 1) - (x0 - x0 % 2) + 1) // 2 * 2, 0) AS b2, coalesce(((y1 + 1) - (y0 - y0 % 2) + 1) // 2 * 2, 0) AS b3"
    fits = "b0 + b2 <= x + w AND b1 + b3 <= y + h" if even else "true"
    return (
        f"{O._GRAY}, {_FRAMED.format(step=step)}, {_CUT_ROWS}, "
        "he AS (SELECT cu.image_id, cu.seq, fr.x AS px, fr.y AS py, fr.v FROM cu JOIN fr ON fr.image_id = cu.image_id AND fr.x >= cu.x AND fr.x < cu.x + cu.w AND fr.y >= cu.y AND fr.y < cu.y + cu.h), "
        "gd AS (SELECT image_id, seq, v AS g FROM (SELECT image_id, seq, v, row_number() OVER (PARTITION BY image_id, seq ORDER BY count(*) DESC, v) AS k FROM he GROUP BY image_id, seq, v) WHERE k = 1), "
        f"ed AS (SELECT he.image_id, he.seq, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM he JOIN gd ON he.image_id = gd.image_id AND he.seq = gd.seq WHERE abs(v - g) > {levels} GROUP BY 1, 2), "
        f"bo AS (SELECT cu.*, g, {box} FROM cu JOIN gd USING (image_id, seq) LEFT JOIN ed USING (image_id, seq)), "
        f"kp AS (SELECT *, (w * h - b2 * b3) * {bytes_per_pixel} > {worth} AND ({fits}) AS kept FROM bo), "
        "fl AS (SELECT image_id, seq, x, y, w, h, CASE WHEN kept THEN g END AS g, CAST(CASE WHEN kept THEN b0 ELSE x END AS INT) AS box_x, CAST(CASE WHEN kept THEN b1 ELSE y END AS INT) AS box_y, CAST(CASE WHEN kept THEN b2 ELSE w END AS INT) AS box_w, CAST(CASE WHEN kept THEN b3 ELSE h END AS INT) AS box_h FROM kp)"
    )


_MERGE = (
    "f0 AS (SELECT image_id, seq, x, y, w, h, g, box_w = 0 AS solid FROM fl WHERE g IS NOT NULL), "
    "f1 AS (SELECT *, CASE WHEN lag(y) OVER o = y AND lag(h) OVER o = h AND lag(x + w) OVER o = x AND lag(g) OVER o = g THEN 0 ELSE 1 END AS opens FROM f0 WINDOW o AS (PARTITION BY image_id ORDER BY y, x)), "
    "f2 AS (SELECT *, sum(opens) OVER (PARTITION BY image_id ORDER BY y, x) AS island FROM f1), "
    "f3 AS (SELECT image_id, min(x) AS x, min(y) AS y, CAST(sum(w) AS INT) AS w, min(h) AS h, min(g) AS g, bool_and(solid) AS solid FROM f2 GROUP BY image_id, island), "
    "f4 AS (SELECT *, CASE WHEN lag(x) OVER o = x AND lag(w) OVER o = w AND lag(y + h) OVER o = y AND lag(g) OVER o = g THEN 0 ELSE 1 END AS opens FROM f3 WINDOW o AS (PARTITION BY image_id ORDER BY x, y)), "
    "f5 AS (SELECT *, sum(opens) OVER (PARTITION BY image_id ORDER BY x, y) AS island FROM f4), "
    "f6 AS (SELECT image_id, min(x) AS x, min(y) AS y, min(w) AS w, CAST(sum(h) AS INT) AS h, min(g) AS g, bool_and(solid) AS solid FROM f5 GROUP BY image_id, island)"
)


def _cost(stretched: bool, source: str) -> str:
    """Runs of the boxes of ``fl`` in ``source`` (image_id, x, y, v), and the fills of ``f6``."""
    paints = "CASE WHEN box_h > 1 AND (y - box_y) % 2 = 1 THEN 2 ELSE 1 END" if stretched else "1"
    return (
        f"bp AS (SELECT fl.image_id, fl.seq, p.x, p.y, p.v, fl.box_y, fl.box_h FROM fl JOIN {source} p ON p.image_id = fl.image_id AND p.x >= box_x AND p.x < box_x + box_w AND p.y >= box_y AND p.y < box_y + box_h), "
        f"ru AS (SELECT image_id, CASE WHEN lag(v) OVER o = v THEN 0 ELSE {paints} END AS n FROM bp WINDOW o AS (PARTITION BY image_id, seq, y ORDER BY x)), "
        "co AS (SELECT image_id, CAST(sum(n) AS BIGINT) AS draws FROM (SELECT image_id, n FROM ru UNION ALL SELECT image_id, 1 FROM f6) GROUP BY image_id)"
    )


def _fill_rows(flat: str) -> str:
    return f"WITH {flat} SELECT image_id, seq, x, y, w, h, CASE WHEN g IS NOT NULL THEN {_WHITE.format(v='g')} END AS ground, box_x, box_y, box_w, box_h FROM fl"


_MASKED = (
    "mo AS (SELECT fl.image_id, fl.seq, p.x, p.y, fl.box_y, fl.box_h, coalesce(p.v = g, false) AS plain, p.v, lead(p.v) OVER (PARTITION BY fl.image_id, fl.seq, p.x ORDER BY p.y) AS below FROM fl JOIN fr p ON p.image_id = fl.image_id AND p.x >= box_x AND p.x < box_x + box_w AND p.y >= box_y AND p.y < box_y + box_h), "
    "ml AS (SELECT image_id, seq, x, y, false AS refine, plain AS spared, CASE WHEN box_h > 1 AND (y - box_y) % 2 = 1 THEN 2 ELSE 1 END AS paints FROM mo UNION ALL "
    "SELECT image_id, seq, x, y, true, (y - box_y) % 2 = 0 AND NOT plain AND coalesce(v = below, false), 1 FROM mo), "
    "mr AS (SELECT *, CASE WHEN spared AND NOT coalesce(lag(spared) OVER (PARTITION BY image_id, seq, refine, y ORDER BY x), false) THEN paints ELSE 0 END AS n FROM ml), "
    "mf AS (SELECT image_id, seq, refine, CAST(sum(n) AS BIGINT) AS runs, min(x) FILTER (spared) AS x0, min(y) FILTER (spared) AS y0, max(x) FILTER (spared) AS x1, max(y) FILTER (spared) AS y1 FROM mr GROUP BY ALL HAVING sum(n) > 0), "
    # Pictures are of 8 pixels at most, so a row is a byte of bits and one of padding.
    "mb AS (SELECT mf.image_id, mf.seq, mf.refine, mr.y, sum(CASE WHEN spared THEN 0 ELSE 1 << CAST(7 - (mr.x - x0) AS INT) END) AS b FROM mf JOIN mr ON mr.image_id = mf.image_id AND mr.seq = mf.seq AND mr.refine = mf.refine AND mr.x BETWEEN x0 AND x1 AND mr.y BETWEEN y0 AND y1 GROUP BY ALL), "
    "ms AS (SELECT image_id, seq, refine, CAST(897 + sum(CASE WHEN b = 0 THEN 2 WHEN b >= 192 THEN 3 ELSE 2 END) AS BIGINT) AS size FROM mb GROUP BY ALL), "
    "mk AS (SELECT image_id, seq, refine, x0 AS x, y0 AS y, CAST(x1 - x0 + 1 AS INT) AS w, CAST(y1 - y0 + 1 AS INT) AS h, runs AS spared, size AS bytes FROM mf JOIN ms USING (image_id, seq, refine) WHERE runs * 124 > size)"
)
_WALKED = (
    "sl AS (SELECT fl.*, 50 + image_id % 6 * 100 AS s FROM fl WHERE box_w > 0), "
    "ks AS (SELECT sl.image_id, sl.seq, any_value(box_w) AS box_w, any_value(box_h) AS box_h, any_value(box_x) AS box_x, any_value(box_y) AS box_y, any_value(g) AS g, any_value(s) AS s, list(p.v ORDER BY p.y, p.x) AS k "
    "FROM sl JOIN fr p ON p.image_id = sl.image_id AND p.x >= box_x AND p.x < box_x + box_w AND p.y >= box_y AND p.y < box_y + box_h GROUP BY sl.image_id, sl.seq), "
    "wk AS (SELECT image_id, seq, 0 AS p, 0 AS run, CAST([] AS INT[]) AS o FROM ks UNION ALL SELECT image_id, seq, p + 1, now, list_append(o, now) FROM (SELECT wk.image_id, wk.seq, p, o, "
    "CASE WHEN g IS NOT NULL AND abs(k[p + 1] - g) <= (s + p // box_w * 7 % 16) // 16 THEN g WHEN p % box_w > 0 AND abs(k[p + 1] - run) <= (s + p // box_w * 7 % 16) // 16 THEN run "
    "WHEN p >= box_w AND abs(k[p + 1] - o[p - box_w + 1]) <= (s + p // box_w * 7 % 16) // 16 AND (p % box_w = box_w - 1 OR abs(k[p + 2] - o[p - box_w + 1]) <= (s + p // box_w * 7 % 16) // 16) THEN o[p - box_w + 1] ELSE k[p + 1] END AS now "
    "FROM wk JOIN ks ON ks.image_id = wk.image_id AND ks.seq = wk.seq WHERE p < box_w * box_h)), "
    "en AS (SELECT wk.image_id, box_x, box_y, box_w, unnest(o) AS v, unnest(range(len(o))) AS i FROM wk JOIN ks ON ks.image_id = wk.image_id AND ks.seq = wk.seq WHERE p = box_w * box_h), "
    "mv AS (SELECT image_id, CAST(box_x + i % box_w AS INT) AS x, CAST(box_y + i // box_w AS INT) AS y, v FROM en), "
    "nw AS (SELECT fr.image_id, fr.x, fr.y, coalesce(mv.v, fr.v) AS v, abs(fr.v - coalesce(mv.v, fr.v)) AS off FROM fr LEFT JOIN mv ON mv.image_id = fr.image_id AND mv.x = fr.x AND mv.y = fr.y)"
)

_OVER = f"CASE WHEN z.size % 40 = 0 THEN {_BYTES} + z.size ELSE z.size END"
_OUTCOMES = f"WITH {_lru(_OVER)} SELECT id, outcome = 'hit' AS hit, outcome, CASE WHEN prev IS NOT NULL THEN CAST(apart AS BIGINT) END AS distance FROM f"
_MASK_FLAT = _flat(0, step=128).replace(_CUT_ROWS, _CUT_ROWS.removesuffix(")") + " WHERE i.image_id % 4 IN (0, 2))")
_STEPPED = _flat(20, levels="(50 + he.image_id % 6 * 100) // 16", step=1)
ORACLES = {
    "byte_lru": _OUTCOMES,
    "byte_lru_ranges": _OUTCOMES,
    "byte_lru_totals": f"WITH {_lru('z.size')}, la AS (SELECT key, own, sum(own) OVER (ORDER BY pos DESC) AS held FROM f WHERE next IS NULL) "
    f"SELECT count(*) AS requests, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome <> 'hit') AS misses, count(*) FILTER (outcome = 'evicted') + (SELECT count(*) FROM la WHERE held > {_BYTES}) AS evictions FROM f",
    "fills_kept": _fill_rows(_flat(20)),
    "fills_even": _fill_rows(_flat(20, 2, True)),
    "fills_near": _fill_rows(_flat(20, levels="64")),
    "fills_merged": f"WITH {_flat(0)}, {_MERGE} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY x, y) AS INT) AS place, x, y, w, h, {_WHITE.format(v='g')} AS ground, solid FROM f6",
    "draw_cost": f"WITH {_flat(20)}, {_MERGE}, {_cost(True, 'fr')} SELECT * FROM co",
    "draw_cost_flat": f"WITH {_flat(20)}, {_MERGE}, {_cost(False, 'fr')} SELECT * FROM co",
    "masks_kept": f"WITH {_MASK_FLAT}, {_MASKED} SELECT * FROM mk",
    "draw_cost_masked": f"WITH {_MASK_FLAT}, {_MERGE}, {_MASKED}, {_cost(True, 'fr')} SELECT co.image_id, CAST(greatest(0, draws - coalesce(m.spared, 0)) AS BIGINT) AS draws FROM co LEFT JOIN (SELECT image_id, sum(spared) AS spared FROM mk GROUP BY 1) m USING (image_id)",
    "slack_walk": f"WITH RECURSIVE {_STEPPED}, {_MERGE}, {_WALKED}, {_cost(True, 'nw')}, wo AS (SELECT image_id, max(off) AS worst FROM nw GROUP BY 1) SELECT image_id, worst, draws FROM wo JOIN co USING (image_id)",
}

_PATHS = (
    "pp AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, coalesce(length(html), 0) AS bytes FROM pages), "
    "pf AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS f FROM pp), pe AS (SELECT *, regexp_extract(f, '^.+([.][^.]*)$', 1) AS e FROM pf), "
    "pt AS (SELECT *, left(f, length(f) - length(e)) AS t, CASE WHEN contains(path, '/') THEN left(path, length(path) - length(f) - 1) ELSE '.' END AS d FROM pe)"
)
_PAD = "CASE WHEN length({v}) < {n} THEN {f}({v}, {n}, '{c}') ELSE {v} END"


def _pad(v: str, n: int, f: str = "lpad", c: str = " ") -> str:
    return _PAD.format(v=f"CAST({v} AS VARCHAR)", n=n, f=f, c=c)


def _picked(k: str, *values: str) -> str:
    return "[" + ", ".join(values) + f"][CAST({k} % {len(values)} AS INT) + 1]"


def _texture(c: str, k: int) -> str:
    five = f"(v[{k}] >> 3)"
    other = f"(({five} + (v[{k}] & 7) - CASE WHEN (v[{k}] & 7) >= 4 THEN 8 ELSE 0 END) & 31)"
    wide = lambda x: f"({x} * 8 + ({x} >> 2))"
    return f"CASE WHEN (v[4] & 2) = 2 THEN {wide(five)} ELSE (v[{k}] >> 4) * 17 END AS {c}0, CASE WHEN (v[4] & 2) = 2 THEN {wide(other)} ELSE (v[{k}] & 15) * 17 END AS {c}1"


_BLOCK_ROWS = (
    "bl AS (SELECT image_id, y % 4 AS bx, y // 4 AS b_y, list(v ORDER BY x) AS v FROM gr GROUP BY image_id, y), "
    f"bc AS (SELECT image_id, bx, b_y, (v[4] & 1) = 1 AS flipped, (v[4] >> 5) & 7 AS t0, (v[4] >> 2) & 7 AS t1, ((CAST(v[5] AS BIGINT) * 256 + v[6]) * 256 + v[7]) * 256 + v[8] AS low, {', '.join(_texture(c, k + 1) for k, c in enumerate('rgb'))} FROM bl), "
    "bp AS (SELECT *, p // 4 AS dx, p % 4 AS dy, CASE WHEN flipped THEN p % 4 >= 2 ELSE p // 4 >= 2 END AS second, (low >> p) & 1 AS large, (low >> (p + 16)) & 1 AS minus FROM (SELECT *, unnest(range(16)) AS p FROM bc)), "
    f"bs AS (SELECT *, {[list(x) for x in blocks.STEPS]}[CAST(CASE WHEN second THEN t1 ELSE t0 END AS INT) + 1][CAST(large AS INT) + 1] * (1 - 2 * minus) AS change FROM bp)"
)
_FIRST = ("png", "ppm", "zcis", "none", "none", "none", "none")
_TYPES = {"png": "image/png", "ppm": "image/x-portable-pixmap", "zcis": "image/x-zcis", "gif": "image/gif", "pcx": "image/x-pcx", "dds": "image/vnd-ms.dds"}
_DECLARED = _picked("page_id", "'gif'", "'none'", "'none'", "'pcx'")
_ENDED = _picked("page_id", "'dds'", "'none'", "'none'")
ORACLES |= {
    "names_written": f"WITH {_PATHS} SELECT page_id, t || '-' || {_pad('page_id', 3, c='0')} || '.' || substr(e, 2) AS plain, {_pad('t', 12, 'rpad')} || '|' || {_pad('bytes', 10)} || '|' || d AS padded, "
    f"left(t, 3) || '%' || {_pad('(page_id * 11 % 300)', 5, c='0')} || ' ' || f AS short, 'out/' || page_id || ' of 250, ' || (page_id * 7 % 500) || 'x' || (page_id * 11 % 300) || ' ' || CASE WHEN page_id % 2 = 0 THEN 'True' ELSE 'False' END || '.png' AS sizes FROM pt",
    "paths_globbed": f"WITH {_PATHS}, h AS (SELECT page_id, path, NOT regexp_matches(path, '(^|/)[.]') AS seen FROM pp) SELECT page_id, seen AND regexp_matches(path, '^[^/]*[.]example[.]com/(.*/)?[^/]*[.](html|htm)$') AS endings, "
    "seen AND regexp_matches(path, '^m[.][^/]*/en/[^/]*$') AS folder, seen AND regexp_matches(path, '^(.*/)?1[^/]*$') AS deep, seen AND regexp_matches(path, '^www[.](.*/)?de/[^/]*$') AS middle FROM h",
    "blob_formats": f"WITH {_PATHS}, k AS (SELECT page_id, {_picked('page_id', *(repr(x) for x in _FIRST))} AS a, {_DECLARED} AS b, {_ENDED} AS c, {_picked('page_id', repr('image/GIF; q=1'), repr('text/html'), repr(''), repr('image/x-pcx'))} AS said FROM pp), "
    "f AS (SELECT page_id, said, CASE WHEN a <> 'none' THEN a WHEN b <> 'none' THEN b WHEN c <> 'none' THEN c ELSE 'raw' END AS format FROM k) "
    f"SELECT page_id, format, CASE {' '.join(f'WHEN format = {n!r} THEN {t!r}' for n, t in _TYPES.items())} WHEN said <> '' THEN said ELSE 'application/octet-stream' END AS content_type FROM f",
    "requests_refused": "WITH k AS (SELECT event_id, event_id AS k FROM events), s AS (SELECT *, CASE WHEN k % 3 > 0 THEN greatest(k % 3000, k % 700) ELSE 0 END AS c, CASE WHEN k % 2 > 0 THEN greatest(k % 2500, 1) ELSE 0 END AS g FROM k) "
    "SELECT event_id, CASE WHEN k % 5 + k % 9 = 0 THEN 'nothing' WHEN k % 9 > 6 THEN 'steps' WHEN k % 5 > 3 THEN 'sources' END AS refused, greatest(c, g) > 2048 AS grid, false AS unlimited FROM s",
    "etc1_decoded": f"WITH {O._GRAY}, {_BLOCK_ROWS} SELECT image_id, CAST(bx * 4 + dx AS INT) AS x, CAST(b_y * 4 + dy AS INT) AS y, "
    + ", ".join(f"CAST(least(255, greatest(0, CASE WHEN second THEN {c}1 ELSE {c}0 END + change)) AS INT) AS {c}" for c in "rgb")
    + ", 255 AS a FROM bs",
}
