"""The same results in SQL for DuckDB, written from the rules and not from the DataFrame code."""

from __future__ import annotations

_LEVEL = "CAST(least(255, greatest(0, floor((CAST(v[{k}] AS DOUBLE) + 1) * 127.5))) AS INT)"
_PX = (
    "px AS (SELECT image_id, CAST(p % 4 AS INT) AS x, CAST(p // 4 AS INT) AS y, "
    + ", ".join(f"{_LEVEL.format(k=f'4*p+{k + 1}')} AS {c}" for k, c in enumerate("rgba"))
    + " FROM (SELECT vec_id AS image_id, embedding AS v, unnest(range(16)) AS p FROM embeddings))"
)
_GRAY = "gr AS (SELECT image_id, CAST(p % 8 AS INT) AS x, CAST(p // 8 AS INT) AS y, " + _LEVEL.format(k="p+1") + " AS v FROM (SELECT vec_id AS image_id, embedding AS v, unnest(range(64)) AS p FROM embeddings))"
_CANVAS = "cv AS (SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, w, h FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT p_partkey AS image_id, 1 + p_size % 16 AS w, 1 + p_partkey % 12 AS h, unnest(range(1 + p_partkey % 12)) AS y FROM part)))"
_LOG = "lg AS (SELECT event_id AS id, user_id AS client, event_type || '|' || (user_id % 20) AS key, epoch_us(ts) / 1000000.0 AS t FROM events)"
_FEW = "few AS (SELECT image_id, x, y, r // 128 AS r, g // 128 AS g, b // 128 AS b, a // 128 AS a FROM px)"
_N5, _N6 = "(({c} * 31 + 127) // 255)", "(({c} * 63 + 127) // 255)"
_565 = f"({_N5.format(c='r')} * 2048 + {_N6.format(c='g')} * 32 + {_N5.format(c='b')})"
_5551 = f"({_N5.format(c='r')} * 2048 + {_N5.format(c='g')} * 64 + {_N5.format(c='b')} * 2 + CASE WHEN a >= 128 THEN 1 ELSE 0 END)"


def _q(share: str) -> str:
    return f"(CAST(floor(least(65535.0, greatest(0.0, ({share}) * CAST(65535.0 AS DOUBLE) + 0.5))) AS BIGINT) // 257)"


def _mix(start, end) -> str:
    alpha = f"({start[3]} * (1 - t) + {end[3]} * t)"
    byte = lambda v: f"(CAST(floor(least(65535.0, greatest(0.0, ({v}) * CAST(257.0 AS DOUBLE) + 0.5))) AS BIGINT) // 257)"
    own = [f"CASE WHEN {alpha} <= 0 THEN 0 ELSE {byte(f'({start[k]} * {start[3]} * (1 - t) + {end[k]} * {end[3]} * t) / greatest({alpha}, 1e-12)')} END" for k in range(3)] + [f"255 - {byte(f'255 - {alpha}')}"]
    return ", ".join(f"CAST({v} AS INT) AS {c}" for v, c in zip(own, "rgba", strict=True))


_RCP = "(CASE WHEN abs({v}) >= 1e-12 THEN 1 / ({v}) WHEN {v} < 0 THEN -1e12 ELSE 1e12 END)"
_UNION = "(sa + da - sa * da)"
_Y = "(0.212656e0 * {p}r + 0.715158e0 * {p}g + 0.072186e0 * {p}b)"
_SEPARABLE = {
    "multiply": "s * d", "screen": "s + d - s * d", "overlay": "CASE WHEN 2 * d <= 1 THEN 2 * s * d ELSE 1 - 2 * (1 - s) * (1 - d) END",
    "darken": "least(s, d)", "lighten": "greatest(s, d)", "color_dodge": "CASE WHEN s + d >= 1 THEN 1.0 ELSE d / (1 - s) END",
    "color_burn": "CASE WHEN d >= 1 THEN 1.0 WHEN s <= 0 THEN 0.0 ELSE 1 - least(1.0, (1 - d) / s) END",
    "hard_light": "CASE WHEN 2 * s <= 1 THEN 2 * s * d ELSE 1 - 2 * (1 - s) * (1 - d) END",
    "soft_light": "CASE WHEN 2 * s <= 1 THEN d - (1 - 2 * s) * d * (1 - d) ELSE d + (2 * s - 1) * (CASE WHEN d <= 0.25 THEN ((16 * d - 12) * d + 4) * d ELSE sqrt(d) END - d) END",
    "difference": "abs(s - d)", "exclusion": "s + d - 2 * s * d", "minus_dst": "s - d", "minus_src": "d - s",
    "divide_dst": "CASE WHEN d = 0 THEN CASE WHEN s = 0 THEN 0.0 ELSE 1.0 END ELSE s / d END", "divide_src": "CASE WHEN s = 0 THEN CASE WHEN d = 0 THEN 0.0 ELSE 1.0 END ELSE d / s END",
    "linear_dodge": "s + d", "linear_burn": "s + d - 1", "linear_light": "d + 2 * s - 1",
    "vivid_light": f"CASE WHEN s = 1 THEN 1.0 WHEN 2 * s <= 1 THEN 1 - (1 - d) * {_RCP.format(v='2 * s')} ELSE d * {_RCP.format(v='2 * (1 - s)')} END",
    "pin_light": "CASE WHEN d < 2 * s - 1 THEN 2 * s - 1 WHEN d > 2 * s THEN 2 * s ELSE d END", "pegtop_light": "d * d * (1 - 2 * s) + 2 * s * d",
}
#: Rule -> (kept outside, channel, alpha); s and d stand for the channel.
_PIXELS = {
    "src_in": (0, "s", "sa * da"), "src_out": (0, "s", "sa * (1 - da)"), "src_atop": (1, "s * sa + d * (1 - sa)", "da"),
    "dst_over": (1, f"(d * da + s * sa * (1 - da)) * {_RCP.format(v=_UNION)}", _UNION), "dst_out": (1, "d", "da * (1 - sa)"), "dst_atop": (0, "d * da + s * (1 - da)", "sa"),
    "xor": (1, f"(s * sa * (1 - da) + d * da * (1 - sa)) * {_RCP.format(v='(sa + da - 2 * sa * da)')}", "sa + da - 2 * sa * da"), "clear": (0, "0.0", "0.0"),
    "modulus_add": (1, "CASE WHEN s * sa + d * da <= 1 THEN s * sa + d * da ELSE s * sa + d * da - 1 END", _UNION),
    "modulus_subtract": (1, "CASE WHEN s * sa - d * da < 0 THEN s * sa - d * da + 1 ELSE s * sa - d * da END", _UNION),
    "hard_mix": (1, f"CASE WHEN s * sa + d * da < 1 THEN 0.0 ELSE {_RCP.format(v=_UNION)} END", _UNION),
    "src": (0, "s", "sa"), "dst": (1, "d", "da"), "copy": (1, "s", "sa"), "copy_black": (1, "d", "da"),
    "darken_intensity": (1, f"CASE WHEN sa * {_Y.format(p='s')} < da * {_Y.format(p='d')} THEN s ELSE d END", f"CASE WHEN sa * {_Y.format(p='s')} < da * {_Y.format(p='d')} THEN sa ELSE da END"),
    "lighten_intensity": (1, f"CASE WHEN sa * {_Y.format(p='s')} > da * {_Y.format(p='d')} THEN s ELSE d END", f"CASE WHEN sa * {_Y.format(p='s')} > da * {_Y.format(p='d')} THEN sa ELSE da END"),
    "copy_opacity": (0, "d", f"CASE WHEN mask THEN {_Y.format(p='s')} ELSE sa END"),
    "change_mask": (0, "d", "CASE WHEN da < 0.5 OR (sa = da AND (da = 0 OR (sr = dr AND sg = dg AND sb = db))) THEN 0.0 ELSE 1.0 END"),
    "bumpmap": (1, f"CASE WHEN sa = 0 THEN d ELSE {_Y.format(p='s')} * d END", f"CASE WHEN sa = 0 THEN da ELSE 1 - {_Y.format(p='s')} * (1 - sa) END"),
}
_ONE_CHANNEL = {"copy_red": "r", "copy_green": "g", "copy_blue": "b", "copy_cyan": "r", "copy_magenta": "g", "copy_yellow": "b"}
_LUMA = "(0.298839e0 * {p}r + 0.586811e0 * {p}g + 0.114350e0 * {p}b)"
_FROM = {"hue": "sdd", "saturate": "dsd", "luminize": "dds", "colorize": "ssd"}

_JOINED = (
    f"WITH {_PX}, ly AS (SELECT image_id - 1 AS image_id, x + 1 AS x, y - 1 AS y, r AS lr, g AS lg, b AS lb, CASE WHEN image_id % 5 = 0 THEN 0 WHEN image_id % 7 = 0 THEN 255 ELSE a END AS la FROM px), "
    "mk AS (SELECT image_id, min(la) = 255 AS mask FROM ly GROUP BY image_id), "
    "j AS (SELECT px.*, lr, lg, lb, la, mask, " + ", ".join(f"l{c} / 255.0e0 AS s{c}, px.{c} / 255.0e0 AS d{c}" for c in "rgba") + " FROM px LEFT JOIN ly USING (image_id, x, y) LEFT JOIN mk USING (image_id)) "
)


def _channel(rule: str, c: str) -> str:
    """The rule with the channel's columns in place of s and d."""
    import re

    return re.sub(r"\b([sd])\b", rf"\1{c}", rule)


def _composite(rule: str) -> str:
    if rule == "tint":
        times = lambda a, b: f"(({a} * {b} + 127) // 255)"
        level = "CAST(floor((0.212656e0 * r + 0.715158e0 * g + 0.072186e0 * b) + 0.5) AS INT)"
        a = times(times("coalesce(la, 255)", "a"), f"(255 - {level})")
        return _JOINED + "SELECT image_id, x, y, " + ", ".join(f"CAST(CASE WHEN {a} <> 0 THEN coalesce(l{c}, 0) ELSE 0 END AS INT) AS {c}" for c in "rgb") + f", CAST({a} AS INT) AS a FROM j"
    if rule == "dst_in":
        a = f"(CASE WHEN coalesce(la, 0) = 255 THEN a WHEN coalesce(la, 0) = 0 THEN 0 ELSE 255 - {_q('1 - da * sa')} END)"
        return _JOINED + "SELECT image_id, x, y, " + ", ".join(f"CAST(CASE WHEN la = 255 THEN {c} WHEN {a} = 0 THEN 0 ELSE {c} END AS INT) AS {c}" for c in "rgb") + f", CAST({a} AS INT) AS a FROM j"
    if rule in _SEPARABLE or rule in ("over", "plus"):
        if rule == "over":
            mixed, alpha = "CASE WHEN sa >= 1 THEN s ELSE s * sa + d * da * (1 - sa) END", _UNION
        elif rule == "plus":
            mixed, alpha = "s * sa + d * da", "sa + da"
        else:
            mixed, alpha = f"s * sa * (1 - da) + d * da * (1 - sa) + sa * da * ({_SEPARABLE[rule]})", _UNION
        ra = f"least(1.0, greatest(0.0, {alpha}))"
        return _JOINED + "SELECT image_id, x, y, " + ", ".join(f"CAST(CASE WHEN la > 0 THEN CASE WHEN {ra} > 0 THEN {_q(f'({_channel(mixed, c)}) / {ra}')} ELSE 0 END ELSE {c} END AS INT) AS {c}" for c in "rgb") + f", CAST(CASE WHEN la > 0 THEN 255 - {_q(f'1 - {ra}')} ELSE a END AS INT) AS a FROM j"
    head, source = _JOINED, "j"
    if rule in _FROM:
        head, source = _hcl(rule), "hcl"
        kept, alpha = 1, "CASE WHEN sa = 0 THEN da WHEN da = 0 THEN sa ELSE greatest(sa, da) END"
        channels = {c: f"CASE WHEN sa = 0 THEN d{c} WHEN da = 0 THEN s{c} ELSE m{c} + lift END" for c in "rgb"}
    elif rule in _ONE_CHANNEL or rule == "stereo":
        own = _ONE_CHANNEL.get(rule, "r")
        kept, alpha = 1, "greatest(0.0, 1 - 1.5e0 * (1 - da))" if rule == "stereo" else "da"
        channels = {c: f"s{c}" if c == own else f"d{c}" for c in "rgb"}
    else:
        kept, mixed, alpha = _PIXELS[rule]
        channels = {c: _channel(mixed, c) for c in "rgb"}
    a = f"(255 - {_q(f'1 - ({alpha})')})"
    outside = {c: c if kept else "0" for c in "rgba"}
    columns = [f"CAST(CASE WHEN la IS NULL THEN {outside[c]} WHEN {a} = 0 THEN 0 ELSE {_q(channels[c])} END AS INT) AS {c}" for c in "rgb"]
    return head + "SELECT image_id, x, y, " + ", ".join(columns) + f", CAST(CASE WHEN la IS NULL THEN {outside['a']} ELSE {a} END AS INT) AS a FROM {source}"


def _hcl(rule: str) -> str:
    hue, chroma, luma = _FROM[rule]
    top = lambda p: f"greatest({p}r, {p}g, {p}b)"
    wide = lambda p: f"({top(p)} - least({p}r, {p}g, {p}b))"
    mod = lambda v, n: f"({v} - {n} * floor(({v}) / {n}))"
    w = wide(hue)
    h = f"CASE WHEN {w} = 0 THEN 0.0 WHEN {hue}r = {top(hue)} THEN {mod(f'(({hue}g - {hue}b) / {w} + 6.0e0)', '6.0e0')} WHEN {hue}g = {top(hue)} THEN ({hue}b - {hue}r) / {w} + 2.0 ELSE ({hue}r - {hue}g) / {w} + 4.0 END"
    six = lambda *v: "CASE " + " ".join(f"WHEN h < {k + 1} THEN {x}" for k, x in enumerate(v)) + " ELSE 0.0 END"
    return (
        _JOINED.rstrip()
        + f", h1 AS (SELECT *, CAST({h} AS DOUBLE) AS h, {wide(chroma)} AS c, {_LUMA.format(p=luma)} AS luma FROM j)"
        + f", h2 AS (SELECT *, c * (1.0e0 - abs({mod('h', '2.0e0')} - 1.0e0)) AS q FROM h1)"
        + f", h3 AS (SELECT *, {six('c', 'q', '0.0', '0.0', 'q', 'c')} AS mr, {six('q', 'c', 'c', 'q', '0.0', '0.0')} AS mg, {six('0.0', '0.0', 'q', 'c', 'c', 'q')} AS mb FROM h2)"
        + f", hcl AS (SELECT *, luma - {_LUMA.format(p='m')} AS lift FROM h3) "
    )


_RULES = [*_SEPARABLE, *_PIXELS, *_ONE_CHANNEL, *_FROM, "stereo", "over", "plus", "tint", "dst_in"]

# The palette's colours in their order, 0xRRGGBB.
_CGA = [0x000000, 0x0000AA, 0x00AA00, 0x00AAAA, 0xAA0000, 0xAA00AA, 0xAA5500, 0xAAAAAA, 0x555555, 0x5555FF, 0x55FF55, 0x55FFFF, 0xFF5555, 0xFF55FF, 0xFFFF55, 0xFFFFFF]
_PALETTE = "pal(i, pr, pg, pb) AS (VALUES " + ", ".join(f"({k}, {c >> 16}, {c >> 8 & 255}, {c & 255})" for k, c in enumerate(_CGA)) + ")"
_DISTANCE = "2*({r}-pr)*({r}-pr) + 4*({g}-pg)*({g}-pg) + 3*({b}-pb)*({b}-pb)"


def _fit(source: str, r: str = "r", g: str = "g", b: str = "b") -> str:
    d = _DISTANCE.format(r=r, g=g, b=b)
    return f"SELECT image_id, x, y, arg_min(i, ({d}) * 16 + i) AS idx, min({d}) AS dist FROM {source}, pal GROUP BY image_id, x, y"


def _blur(size: int, passes: int) -> str:
    """Each pixel joined with the clamped places of its window."""
    ctes, now = [_GRAY], "gr"
    for k in range(passes):
        for along, across in (("x", "y"), ("y", "x")):
            new = f"b{k}{along}"
            ctes.append(
                f"{new} AS MATERIALIZED (SELECT a.image_id, a.x, a.y, CAST((sum(b.v) + {size}) // {2 * size + 1} AS INT) AS v FROM {now} a, (SELECT unnest(range(-{size}, {size + 1})) AS o) o, {now} b "
                f"WHERE a.image_id = b.image_id AND a.{across} = b.{across} AND b.{along} = least(7, greatest(0, a.{along} + o.o)) GROUP BY ALL)"
            )
            now = new
    return "WITH " + ", ".join(ctes) + f" SELECT image_id, x, y, v FROM {now}"


def _resize(width: str, height: str) -> str:
    return (
        f"WITH {_GRAY}, t AS (SELECT unnest(range({width})) AS tx), u AS (SELECT unnest(range({height})) AS ty) "
        f"SELECT image_id, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, v FROM t, u, gr WHERE gr.x = least(7, tx * 8 // ({width})) AND gr.y = least(7, ty * 8 // ({height}))"
    )


_BAYER = "CASE (y % 4) * 4 + x % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate((0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5))) + " END"
_EVEN = "ev AS (SELECT image_id, x, y, r // 100 * 7 AS r, g // 100 * 7 AS g, b // 100 * 7 AS b, a // 100 * 7 AS a FROM px)"
_SIDES = "x = 0 OR y = 0 OR x = 3 OR y = 3"
_CHANGES = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in "rgba")
_COMMON = "cc AS (SELECT image_id, r, g, b, a, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b, a) AS k FROM (SELECT image_id, r, g, b, a, count(*) AS n FROM few GROUP BY ALL)) WHERE k = 1)"

_ORDERED = "od AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, id) AS k FROM lg)"


def _in_turn(first: str, later: str, columns: str) -> str:
    """Requests of each client one after the other: ``first`` and ``later`` give the state after a request, s is the state before."""
    return f"WITH RECURSIVE {_LOG}, {_ORDERED}, st AS (SELECT id, client, k, t, {first} FROM od WHERE k = 1 UNION ALL SELECT o.id, o.client, o.k, o.t, {later} FROM st s JOIN od o ON o.client = s.client AND o.k = s.k + 1) SELECT id, {columns} FROM st"


_OPENS = "o.t >= s.resets"
_TOKENS = "least(1.0e0, s.tokens + (o.t / 10800.0e0 - s.t / 10800.0e0) * 1.0e0)"


def _apart(keep: int) -> str:
    """Colours chosen one by one, a table for each turn."""
    between = " + ".join(f"{n} * (a.p{c} - b.p{c}) * (a.p{c} - b.p{c})" for n, c in ((2, "r"), (4, "g"), (3, "b")))
    out = f"WITH {_PX}, {_PALETTE}, vo AS (SELECT image_id, idx, count(*) AS n FROM ({_fit('px')}) GROUP BY ALL), ds AS (SELECT a.i, b.i AS j, {between} AS d FROM pal a, pal b), "
    out += "c1 AS (SELECT image_id, idx, 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, idx) AS rn FROM vo) WHERE rn = 1)"
    for k in range(2, keep + 1):
        out += (
            f", s{k} AS (SELECT v.image_id, v.idx, v.n * min(d) AS score FROM vo v JOIN c{k - 1} c ON c.image_id = v.image_id JOIN ds ON ds.i = v.idx AND ds.j = c.idx GROUP BY v.image_id, v.idx, v.n HAVING min(d) > 0), "
            f"c{k} AS (SELECT * FROM c{k - 1} UNION ALL SELECT image_id, idx, {k} AS place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, idx) AS rn FROM s{k}) WHERE rn = 1)"
        )
    return f"{out} SELECT image_id, CAST(idx AS INT) AS idx, CAST(place AS INT) AS place FROM c{keep}"


def _diffused() -> str:
    """Pixel by pixel, with lists of what is owed (wr, wg, wb) to each place of a 4 by 4 picture."""
    lists = {c: "[" + ", ".join(str(v >> n & 255) for v in _CGA) + "]" for c, n in (("r", 16), ("g", 8), ("b", 0))}
    now = {c: f"least(255, greatest(0, v{c}[p + 1] + w{c}[p + 1]))" for c in "rgb"}
    distance = " + ".join(f"{n} * ({now[c]} - {lists[c]}[i]) * ({now[c]} - {lists[c]}[i])" for n, c in ((2, "r"), (4, "g"), (3, "b")))
    part = lambda c, n: f"CAST(trunc(({now[c]} - {lists[c]}[idx]) * {n} / 16.0e0) AS BIGINT)"
    owed = lambda c: (
        f"list_transform(range(16), lambda q: w{c}[q + 1] + CASE WHEN q = p + 1 AND p % 4 < 3 THEN {part(c, 7)} WHEN q = p + 3 AND p % 4 > 0 THEN {part(c, 3)} WHEN q = p + 4 THEN {part(c, 5)} WHEN q = p + 5 AND p % 4 < 3 THEN {part(c, 1)} ELSE 0 END)"
    )
    return (
        f"WITH RECURSIVE {_PX}, vs AS (SELECT image_id, " + ", ".join(f"list({c} ORDER BY y, x) AS v{c}" for c in "rgb") + " FROM px GROUP BY 1), "
        "st AS (SELECT image_id, vr, vg, vb, 0 AS p, CAST(NULL AS BIGINT) AS idx, " + ", ".join(f"list_transform(range(16), lambda q: CAST(0 AS BIGINT)) AS w{c}" for c in "rgb") + " FROM vs UNION ALL "
        "SELECT image_id, vr, vg, vb, p + 1, idx, " + ", ".join(owed(c) for c in "rgb") + " FROM (SELECT *, list_position(ds, list_min(ds)) AS idx FROM "
        f"(SELECT image_id, vr, vg, vb, p, wr, wg, wb, list_transform(range(1, 17), lambda i: {distance}) AS ds FROM st WHERE p < 16)))"
        " SELECT image_id, CAST((p - 1) % 4 AS INT) AS x, CAST((p - 1) // 4 AS INT) AS y, CAST(idx - 1 AS INT) AS idx FROM st WHERE p > 0"
    )


_SHELVES = (
    "WITH RECURSIVE sz AS (SELECT p_brand || '|' || p_type AS group_id, p_partkey AS seq, 1 + p_size % 16 AS w, 1 + p_partkey % 12 AS h FROM part), "
    "od AS (SELECT *, (w + 3) // 4 * 4 AS room, (h + 3) // 4 * 4 AS deep, row_number() OVER (PARTITION BY group_id ORDER BY h DESC, seq) AS k FROM sz), "
    "wi AS (SELECT group_id, k AS c, sum(room + 1) OVER (PARTITION BY group_id ORDER BY k) - 1 AS width FROM od), "
    "st AS (SELECT i.group_id, c, width, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS shelf, CAST(0 AS BIGINT) AS px, CAST(0 AS BIGINT) AS py, CAST(0 AS BIGINT) AS reach FROM wi i UNION ALL "
    "SELECT group_id, c, width, k, seq, nx + room + 1, ny, greatest(ns, deep), nx, ny, nx + room FROM (SELECT s.group_id, s.c, s.width, o.k, o.seq, o.room, o.deep, "
    "CASE WHEN s.x > 0 AND s.x + o.w > s.width THEN 0 ELSE s.x END AS nx, CASE WHEN s.x > 0 AND s.x + o.w > s.width THEN s.y + s.shelf + 1 ELSE s.y END AS ny, CASE WHEN s.x > 0 AND s.x + o.w > s.width THEN 0 ELSE s.shelf END AS ns "
    "FROM st s JOIN od o ON o.group_id = s.group_id AND o.k = s.k + 1)), "
    "cv AS (SELECT group_id, c, max(reach) AS cw, max(py + shelf) AS ch FROM st WHERE k > 0 GROUP BY 1, 2), "
    "be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY greatest(cw, ch), cw * ch, ch, c) AS rn FROM cv) WHERE rn = 1) "
    "SELECT st.group_id, seq, CAST(px AS INT) AS px, CAST(py AS INT) AS py, CAST(cw AS INT) AS canvas_w, CAST(ch AS INT) AS canvas_h FROM st JOIN be ON st.group_id = be.group_id AND st.c = be.c WHERE st.k > 0"
)

ORACLES: dict[str, str] = {
    "flagship": f"WITH {_GRAY} SELECT 255 - v AS v, count(*) AS n FROM gr WHERE x >= 2 AND x < 6 AND y >= 1 AND y < 7 GROUP BY 1",
    "convert_packed": f"WITH {_PX} SELECT image_id, x, y, CAST(floor(0.212656e0 * r + 0.715158e0 * g + 0.072186e0 * b + 0.5) AS INT) AS gray8, {_565} AS rgb565, {_N5.format(c='r')} * 1024 + {_N5.format(c='g')} * 32 + {_N5.format(c='b')} AS rgb555, {_5551} AS rgba5551, CAST(a AS BIGINT) * 16777216 + r * 65536 + g * 256 + b AS argb FROM px",
    "convert_unpacked": f"WITH {_PX}, k AS (SELECT image_id, x, y, {_565} AS p, {_5551} AS q FROM px), m AS (SELECT *, p >> 11 AS a5, (p >> 5) & 63 AS a6, p & 31 AS b5, (q >> 11) & 31 AS c5, (q >> 6) & 31 AS d5, (q >> 1) & 31 AS e5 FROM k) "
    "SELECT image_id, x, y, CAST(a5 * 8 + a5 // 4 AS INT) AS pr, CAST(a6 * 4 + a6 // 16 AS INT) AS pg, CAST(b5 * 8 + b5 // 4 AS INT) AS pb, CAST(c5 * 8 + c5 // 4 AS INT) AS qr, CAST(d5 * 8 + d5 // 4 AS INT) AS qg, CAST(e5 * 8 + e5 // 4 AS INT) AS qb, CASE WHEN q % 2 = 1 THEN 255 ELSE 0 END AS qa FROM m",
    "convert_yuv": f"WITH {_PX} SELECT image_id, x, y, CAST(least(255, greatest(0, r + floor(1436 * (b - 128) / 1024.0))) AS INT) AS r1, CAST(least(255, greatest(0, r - floor((352 * (g - 128) + 731 * (b - 128)) / 1024.0))) AS INT) AS g1, CAST(least(255, greatest(0, r + floor(1815 * (g - 128) / 1024.0))) AS INT) AS b1 FROM px",
    "crop": f"WITH {_PX} SELECT image_id, x - 1 AS x, y - 1 AS y, r, g, b, a FROM px WHERE x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 3",
    "negate": f"WITH {_PX} SELECT image_id, x, y, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM px",
    "radius": f"WITH {_PX} SELECT image_id, x, y, r, g, b, CASE WHEN (x IN (0, 3)) AND (y IN (0, 3)) AND 1 + 1 > 4 THEN 0 ELSE a END AS a FROM px",
    "blur": _blur(2, 3),
    "edge_colour": f"WITH {_PX}, {_EVEN}, rim AS (SELECT * FROM ev WHERE {_SIDES}), "
    + ", ".join(f"m{c} AS (SELECT image_id, {c} AS m{c} FROM (SELECT image_id, {c}, row_number() OVER (PARTITION BY image_id ORDER BY {c}) AS k FROM rim) WHERE k = 7)" for c in "rgba")
    + ", j AS (SELECT * FROM rim " + " ".join(f"JOIN m{c} USING (image_id)" for c in "rgba") + ") "
    + "SELECT image_id, mr AS r, mg AS g, mb AS b, ma AS a FROM j GROUP BY image_id, mr, mg, mb, ma HAVING sum(CASE WHEN " + " AND ".join(f"abs({c} - m{c}) <= 8" for c in "rgba") + " THEN 1 ELSE 0 END) * 10 >= count(*) * 9",
    "histogram": f"WITH {_PX} SELECT r // 64 AS r, g // 64 AS g, b // 64 AS b, a // 64 AS a, count(*) AS n FROM px GROUP BY 1, 2, 3, 4",
    "brush_solid": f"WITH {_CANVAS} SELECT image_id, x, y, 17 AS r, 130 AS g, 251 AS b, 200 AS a FROM cv",
    "brush_null": f"WITH {_CANVAS} SELECT image_id, x, y, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM cv",
    "brush_radial": f"WITH {_CANVAS}, z AS (SELECT *, greatest(w - 1, h - 1) / 2.0e0 AS half, x - (w - 1) / 2.0e0 AS ex, y - (h - 1) / 2.0e0 AS ey FROM cv) SELECT image_id, x, y, {_mix((255, 255, 255, 255), (0, 0, 0, 255))} FROM (SELECT *, CASE WHEN half > 0 THEN least(1.0, sqrt((ex / half) * (ex / half) + (ey / half) * (ey / half))) ELSE 0.0 END AS t FROM z)",
    "brush_hald": "SELECT CAST(0 AS BIGINT) AS image_id, CAST(i % 64 AS INT) AS x, CAST(i // 64 AS INT) AS y, CAST((i % 16) * 255 // 15 AS INT) AS r, CAST((i // 16 % 16) * 255 // 15 AS INT) AS g, CAST((i // 256 % 16) * 255 // 15 AS INT) AS b, 255 AS a FROM range(4096) t(i)",
    "quantise_nearest": f"WITH {_PX}, {_PALETTE} SELECT image_id, x, y, idx FROM ({_fit('px')})",
    "quantise_strict": f"WITH {_PX}, {_PALETTE}, st AS (SELECT image_id, x, y, r // 86 * 85 AS r, g // 86 * 85 AS g, b // 86 * 85 AS b FROM px) SELECT image_id, x, y, CASE WHEN dist = 0 THEN idx END AS idx FROM ({_fit('st')})",
    "quantise_bayer": f"WITH {_PX}, {_PALETTE}, th AS (SELECT *, ({_BAYER} - 8) * 2 AS o FROM px), moved AS (SELECT image_id, x, y, least(255, greatest(0, r + o)) AS r, least(255, greatest(0, g + o)) AS g, least(255, greatest(0, b + o)) AS b FROM th) SELECT image_id, x, y, idx FROM ({_fit("moved")})",
    "most_voted": f"WITH {_PX}, {_PALETTE}, f AS ({_fit('px')}), v AS (SELECT image_id, idx, count(*) AS votes FROM f GROUP BY ALL), e AS (SELECT im.image_id, CAST(pal.i AS INT) AS idx, coalesce(votes, 0) AS votes FROM (SELECT DISTINCT image_id FROM px) im CROSS JOIN pal LEFT JOIN v ON v.image_id = im.image_id AND v.idx = pal.i) "
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, idx) AS INT) AS place FROM e) WHERE place <= 3",
    "grid": "WITH s AS (SELECT p_brand AS group_id, p_partkey AS seq, CAST(1 + p_size % 16 AS INT) AS w, CAST(1 + p_partkey % 12 AS INT) AS h FROM part), k AS (SELECT *, (max(w) OVER (PARTITION BY group_id) + 3) // 4 * 4 AS cell_w, (max(h) OVER (PARTITION BY group_id) + 3) // 4 * 4 AS cell_h, row_number() OVER (PARTITION BY group_id ORDER BY seq) - 1 AS n FROM s) "
    "SELECT group_id, seq, w, h, cell_w, cell_h, CAST((n % 5) * (cell_w + 1) AS INT) AS px, CAST((n // 5) * (cell_h + 1) AS INT) AS py FROM k",
    "runs": f"WITH {_PX}, {_FEW}, k AS (SELECT *, CASE WHEN {_CHANGES} THEN 1 ELSE 0 END AS new FROM few WINDOW w AS (PARTITION BY image_id, y ORDER BY x)), n AS (SELECT *, sum(new) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM k) SELECT image_id, y, r, g, b, a, min(x) AS start, count(*) AS length FROM n GROUP BY image_id, y, run, r, g, b, a",
    "commonest_colour": f"WITH {_PX}, {_FEW}, {_COMMON} SELECT image_id, r, g, b, a, n FROM cc",
    "bounding_box": f"WITH {_PX}, {_FEW}, {_COMMON} SELECT few.image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM few JOIN cc ON few.image_id = cc.image_id WHERE (few.r, few.g, few.b, few.a) <> (cc.r, cc.g, cc.b, cc.a) GROUP BY 1",
    "pack": f"WITH {_PX} SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY y, x) AS data FROM px GROUP BY image_id",
    "encodings": "SELECT doc_id, md5(base64(encode(text))) AS base64_md5, md5(lower(hex(encode(text)))) AS hex_md5, md5(text) AS key FROM documents",
    "base62": "SELECT p_partkey, substr(d, CAST(n // 62 AS INT) + 1, 1) || substr(d, CAST(n % 62 AS INT) + 1, 1) AS pair FROM (SELECT p_partkey, p_partkey % 3844 AS n, '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ' AS d FROM part)",
    "request_lines": "WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages), s AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[^A-Za-z0-9._-]', '', 'g'), '\\.[^.]*$', '') AS stem FROM p) "
    "SELECT page_id, CASE WHEN path IN ('/cdn', '/cdn/') THEN 200 ELSE 404 END AS status, CASE WHEN replace(stem, '.', '') = '' THEN 'download' ELSE stem END || '.png' AS name, md5(query) AS key FROM s",
    "url_words": "WITH p AS (SELECT page_id, replace(regexp_extract(url, '\\?([^#]*)', 1), '+', ' ') AS query FROM pages), w AS (SELECT page_id, list_filter(string_split(query, '&'), lambda x: x <> '') AS ws FROM p), u AS (SELECT page_id, unnest(ws) AS w, unnest(range(len(ws))) AS seq FROM w) "
    "SELECT page_id, CAST(seq AS INT) AS seq, regexp_extract(w, '^([^:=]*)', 1) AS name, CASE WHEN contains(w, '=') THEN regexp_extract(w, '^[^:=]*=(.*)$', 1) ELSE '' END AS value, 'named' AS kind FROM u",
    "single_flight": f"WITH {_LOG} SELECT key, min(id) AS first_id, count(*) - 1 AS waiters FROM lg GROUP BY key",
    "cache_hits": f"WITH {_LOG}, g AS (SELECT key, t - lag(t) OVER (PARTITION BY key ORDER BY t, id) AS gap FROM lg) SELECT key, CAST(sum(CASE WHEN gap < 3600 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n FROM g GROUP BY key",
    "cache_sessions": f"WITH {_LOG}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, id) < 7200 THEN 0 ELSE 1 END AS new FROM lg), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t, id) AS session FROM g) SELECT key, CAST(session AS BIGINT) AS session, min(t) AS first, max(t) AS last, count(*) AS n FROM s GROUP BY key, session",
    "netpbm_round_trip": f"WITH {_PX} SELECT CAST(image_id AS VARCHAR) AS path, x, y, r, g, b, 255 AS a FROM px",
    "negotiated": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 11 >= 10 THEN 'gzip' ELSE 'deflate' END WHEN 1 THEN CASE WHEN event_id % 11 <= 5 THEN 'gzip' ELSE 'deflate' END WHEN 2 THEN 'identity' WHEN 3 THEN CASE WHEN event_id % 11 > 0 THEN 'gzip' ELSE 'identity' END ELSE 'identity' END AS encoding FROM events",
    "resize_exact": _resize("5", "11"),
    "resize_inside": _resize("3", "3"),
    "resize_cover": _resize("6", "6"),
    "resize_percent": _resize("12", "12"),
    "resize_width": _resize("3", "3"),
} | {f"composite_{rule}": _composite(rule) for rule in _RULES}
ORACLES |= {
    "cobs": f"WITH {_PX}, z AS (SELECT image_id, y * 4 + x AS p, " + ", ".join(f"CASE WHEN {c} < 110 THEN 0 ELSE {c} END AS {c}" for c in "rgba") + " FROM px), h AS (SELECT image_id, string_agg(printf('%02x %02x %02x %02x ', r, g, b, a), '' ORDER BY p) AS s FROM z GROUP BY 1) "
    "SELECT image_id, array_to_string(list_transform(string_split(s, '00 '), lambda p: printf('%02x', len(p) // 3 + 1) || replace(p, ' ', '')), '') AS cobs FROM h",
    "client_quota": _in_turn("CAST(1 AS BIGINT) AS created, t + 86400.0e0 AS resets, true AS stored", f"CASE WHEN {_OPENS} THEN 1 ELSE s.created + CASE WHEN s.created < 3 THEN 1 ELSE 0 END END, CASE WHEN {_OPENS} THEN o.t + 86400.0e0 ELSE s.resets END, {_OPENS} OR s.created < 3", "stored"),
    "rate_limit": _in_turn("0.0e0 AS tokens, true AS allowed", f"{_TOKENS} - CASE WHEN {_TOKENS} >= 1 THEN 1 ELSE 0 END, {_TOKENS} >= 1", "allowed"),
    "most_apart": _apart(4),
    "diffuse": _diffused(),
    "shelves": _SHELVES,
}
