"""Tiles, lens grids, demosaicing, the develop job, thumbnails and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import numeric
from rawlake.operators import develop, lens, preview, size, tiles
from rawlake.operators.tiles import RED_PARITY
from rawlake.queries.base import (
    GRIDS,
    MOSAIC_PIXELS,
    MOSAICS,
    PATTERNS,
    case_sql,
    grids,
    micro,
    micro_sql,
    mosaics,
    query,
)
from rawlake.queries.colour import ENCODE_SQL, SRGB_SQL, u16_sql
from rawlake.queries.params import site_sql

RGB = ("r", "g", "b")
RX = case_sql("pattern", {k: v[0] for k, v in RED_PARITY.items()}, "9")
RY = case_sql("pattern", {k: v[1] for k, v in RED_PARITY.items()}, "9")


def tiled(spark, sf, tile_h=4, tile_w=5, halo=3):
    """Small tiles, so that every frame has inner tile borders."""
    return tiles.cut_tiles(mosaics(spark, sf), tile_h, tile_w, halo)


def micros(df, *keys):
    return df.select(*keys, *[micro(F.col(c)).alias(c) for c in RGB])


# --- mosaic basics -----------------------------------------------------------


@query("d7_tile_pixels", f"SELECT frame_id, y::INTEGER AS y, x::INTEGER AS x, v::DOUBLE AS v FROM (SELECT frame_id, i // 8 AS y, i % 8 AS x, px[i + 1] AS v FROM {MOSAICS} m, range(64) t(i))")
def d7(spark, sf):
    return tiles.mosaic_pixels(tiled(spark, sf)).select("frame_id", "y", "x", "v")


@query("f11_crop", f"SELECT frame_id, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM {MOSAIC_PIXELS} WHERE y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 7 GROUP BY frame_id")
def f11_crop(spark, sf):
    m = mosaics(spark, sf).withColumns({"crop_x": F.lit(2), "crop_y": F.lit(1), "crop_w": F.lit(6), "crop_h": F.lit(5)})
    p = tiles.mosaic_pixels(tiles.cut_tiles(m, 3, 4, 2))
    return p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("w3_left_difference", f"SELECT frame_id, y::INTEGER AS y, x::INTEGER AS x, (v - coalesce(lag(v) OVER (PARTITION BY frame_id, y ORDER BY x), 0))::DOUBLE AS diff FROM {MOSAIC_PIXELS}")
def w3(spark, sf):
    return size.tile_differences(tiled(spark, sf)).select("frame_id", "y", "x", F.col("diff").cast("double").alias("diff"))


DIFFS = f"(SELECT frame_id, clip_id, v - coalesce(lag(v) OVER (PARTITION BY frame_id, y ORDER BY x), 0) AS d FROM {MOSAIC_PIXELS})"
CATEGORY = "CASE WHEN d = 0 THEN 0 ELSE length(ltrim(bin(abs(d)), '0')) END"
LENGTHS = "[" + ", ".join(map(str, vocab.CODE_LENGTH)) + "]"


@query(
    "a13_compressed_size",
    f"SELECT frame_id, count(*) AS pixels, CAST(sum({LENGTHS}[c + 1] + c) AS BIGINT) AS bits, CAST((sum({LENGTHS}[c + 1] + c) + 7) // 8 AS BIGINT) AS bytes "
    f"FROM (SELECT frame_id, {CATEGORY} AS c FROM {DIFFS}) GROUP BY frame_id",
)
def a13(spark, sf):
    return size.compressed_tiles(tiled(spark, sf))


@query(
    "a13_clip_archive_size",
    f"SELECT clip_id, count(*) AS pixels, CAST(sum({LENGTHS}[c + 1] + c) AS BIGINT) AS bits, CAST((sum({LENGTHS}[c + 1] + c) + 7) // 8 AS BIGINT) AS bytes "
    f"FROM (SELECT clip_id, {CATEGORY} AS c FROM {DIFFS}) GROUP BY clip_id",
)
def a13_clip(spark, sf):
    return size.compressed_tiles(tiled(spark, sf), ("clip_id",))


@query("a14_frame_bytes", f"SELECT clip_id, CAST(sum(len(px) * 2) AS BIGINT) AS raw_bytes FROM {MOSAICS} GROUP BY clip_id")
def a14(spark, sf):
    return size.frame_bytes(tiled(spark, sf), ("clip_id",))


# --- lens grids --------------------------------------------------------------

COLOUR_GRID = f"(SELECT clip_id, ch, gy, gx, CASE WHEN min(gain) OVER (PARTITION BY clip_id, gy, gx) > 0 THEN gain / min(gain) OVER (PARTITION BY clip_id, gy, gx) ELSE 1.0 END AS gain FROM {GRIDS})"


@query("a10_colour_grid", f"SELECT clip_id, ch::INTEGER AS ch, gy::INTEGER AS gy, gx::INTEGER AS gx, gain FROM {COLOUR_GRID}")
def a10(spark, sf):
    g = grids(spark, sf).withColumn("lens_grid", lens.colour_only(F.col("lens_grid")))
    return lens.grid_nodes(g)


SITE = f"(SELECT m.*, {site_sql('pattern', 'y', 'x')} AS color FROM {MOSAIC_PIXELS} m)"
CHANNEL = f"(SELECT *, CASE color WHEN 0 THEN 0 WHEN 2 THEN 3 ELSE CASE WHEN y % 2 = 0 THEN 1 ELSE 2 END END AS ch FROM {SITE})"


NODES = "list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)) + 1.0) AS nodes"
PLAIN_NODES = f"(SELECT vec_id AS frame_id, {NODES} FROM embeddings)"
COLOUR_NODES = (
    "(SELECT frame_id, list_transform(range(64), lambda i: CASE WHEN low[i % 16 + 1] > 0 THEN nodes[i + 1] / low[i % 16 + 1] ELSE 1.0 END) AS nodes FROM "
    f"(SELECT *, list_transform(range(16), lambda i: least(nodes[i + 1], nodes[i + 17], nodes[i + 33], nodes[i + 49])) AS low FROM {PLAIN_NODES}))"
)


def gain_sql(nodes: str) -> str:
    """Pixels with their interpolated gain; grid and frame share the same number."""
    node = "nodes[16 * ch + 4 * {y} + {x} + 1]"
    a, b, c, d = (node.format(y=y, x=x) for y in ("iy", "least(iy + 1, 3)") for x in ("ix", "least(ix + 1, 3)"))
    return f"""(WITH p AS (SELECT *, least(greatest(x / 8.0::DOUBLE * 3, 0), 3) AS fx, least(greatest(y / 8.0::DOUBLE * 3, 0), 3) AS fy FROM {CHANNEL}),
q AS (SELECT *, CAST(floor(fx) AS BIGINT) AS ix, CAST(floor(fy) AS BIGINT) AS iy FROM p)
SELECT q.*, ({a} + ({b} - {a}) * (fx - ix)) + (({c} + ({d} - {c}) * (fx - ix)) - ({a} + ({b} - {a}) * (fx - ix))) * (fy - iy) AS gain
FROM q JOIN {nodes} n USING (frame_id))"""


def gridded(spark, sf, halo=3):
    """Tiles with the grid of their frame's number."""
    g = grids(spark, sf).withColumnRenamed("clip_id", "frame_id")
    t = develop.attach(tiled(spark, sf, halo=halo), g, ["frame_id"], "inner", spread=["tile_y", "tile_x"])
    return t.withColumns({"sensor_w": F.lit(8), "sensor_h": F.lit(8), "crop_x": F.lit(0), "crop_y": F.lit(0)})


@query("j4_grid_gain", f"SELECT frame_id, y::INTEGER AS y, x::INTEGER AS x, {micro_sql('gain')} AS gain FROM {gain_sql(PLAIN_NODES)}")
def j4(spark, sf):
    rows = tiles.site_rows(gridded(spark, sf))
    y, x = F.col("y"), F.col("x")
    ch = numeric.lens_channel(F.col("pattern"), x, y)
    gain = lens.blend(F.get("lens_grid", ch), F.col("grid_w"), F.col("grid_h"), x / 8.0, y / 8.0)
    return rows.select("frame_id", "y", "x", micro(gain).alias("gain"))


P3_BLACK = "CASE color WHEN 0 THEN 64.0::DOUBLE WHEN 2 THEN 90.0::DOUBLE ELSE 70.0::DOUBLE END"
P3_VALUE = f"least(65535, floor(greatest(0, (v - {P3_BLACK}) / (16383.0::DOUBLE - {P3_BLACK}) * gain * 65535.0::DOUBLE) + 0.5))"


def p3_tiles(spark, sf, halo=3):
    t = gridded(spark, sf, halo).withColumns(
        {"src_black": F.array(F.lit(64.0), F.lit(70.0), F.lit(90.0)), "src_white": F.lit(16383.0), "out_white": F.lit(65535.0)}
    )
    return lens.correct_tiles(t)


@query("p3_lens_levels", f"SELECT frame_id, y::INTEGER AS y, x::INTEGER AS x, {P3_VALUE}::DOUBLE AS v FROM {gain_sql(PLAIN_NODES)}")
def p3(spark, sf):
    return tiles.mosaic_pixels(p3_tiles(spark, sf)).select("frame_id", "y", "x", "v")


@query("p4_lens_gain", f"SELECT frame_id, y::INTEGER AS y, x::INTEGER AS x, least(16383, floor(v * gain + 0.5))::DOUBLE AS v FROM {gain_sql(COLOUR_NODES)}")
def p4(spark, sf):
    t = gridded(spark, sf).withColumn("out_white", F.lit(16383.0))
    t = t.withColumn("lens_grid", lens.colour_only(F.col("lens_grid")))
    return tiles.mosaic_pixels(lens.correct_tiles(t, levels=False)).select("frame_id", "y", "x", "v")


# --- demosaic ----------------------------------------------------------------


def at0(y: str, x: str) -> str:
    return f"(CASE WHEN ({y}) < 0 OR ({x}) < 0 OR ({y}) > 7 OR ({x}) > 7 THEN 0 ELSE px[({y}) * 8 + ({x}) + 1] END)::DOUBLE"


def red(y: str, x: str) -> str:
    return f"(({x}) % 2 = rx AND ({y}) % 2 = ry)"


def blue(y: str, x: str) -> str:
    return f"(({x}) % 2 = 1 - rx AND ({y}) % 2 = 1 - ry)"


def green(y: str, x: str) -> str:
    return f"(NOT {red(y, x)} AND NOT {blue(y, x)})"


def mean_sql(y: str, x: str, steps, test) -> str:
    spots = [(f"{y} + ({dy})", f"{x} + ({dx})") for dx, dy in steps]
    total = " + ".join(f"CASE WHEN {test(*s)} THEN {at0(*s)} ELSE 0 END" for s in spots)
    count = " + ".join(f"CASE WHEN {test(*s)} THEN 1 ELSE 0 END" for s in spots)
    return f"CASE WHEN ({count}) > 0 THEN ({total}) / ({count}) ELSE {at0(y, x)} END"


CROSS, CORNERS = [(0, -1), (0, 1), (-1, 0), (1, 0)], [(-1, -1), (1, -1), (-1, 1), (1, 1)]


def p5_sql(source: str) -> str:
    """``source`` has frame_id, pattern, px, y, x."""
    return f"""(WITH s AS (SELECT *, {RX} AS rx, {RY} AS ry FROM {source}),
c AS (SELECT *, {red('y', 'x')} AS is_r, {blue('y', 'x')} AS is_b FROM s),
k AS (SELECT *, CASE WHEN is_r OR is_b THEN 0 WHEN y % 2 = 0 THEN 1 ELSE -1 END AS sh FROM c)
SELECT frame_id, pattern, y, x, CASE WHEN is_r THEN {at0('y', 'x')} ELSE {mean_sql('y', '(x + sh)', CORNERS, red)} END AS r,
CASE WHEN sh <> 0 THEN {at0('y', 'x')} ELSE {mean_sql('y', 'x', CROSS, green)} END AS g,
CASE WHEN is_b THEN {at0('y', 'x')} ELSE {mean_sql('y', '(x - sh)', CORNERS, blue)} END AS b FROM k)"""


@query("p5_demosaic_export", f"SELECT frame_id, y::INTEGER AS y, x::INTEGER AS x, {', '.join(f'{micro_sql(c)} AS {c}' for c in RGB)} FROM {p5_sql(MOSAIC_PIXELS)}")
def p5(spark, sf):
    return micros(tiles.demosaic_export(tiled(spark, sf)), "frame_id", "y", "x")


def atc(y: str, x: str) -> str:
    return f"px[greatest(0, least(7, {y})) * 8 + greatest(0, least(7, {x})) + 1]::DOUBLE"


PLAIN = "replace(pattern, 'QuadBayer', '')"


def p6_sql(source: str) -> str:
    side = f"({atc('y', 'x - 1')} + {atc('y', 'x + 1')})"
    ends = f"({atc('y - 1', 'x')} + {atc('y + 1', 'x')})"
    corner = f"({atc('y - 1', 'x - 1')} + {atc('y - 1', 'x + 1')} + {atc('y + 1', 'x - 1')} + {atc('y + 1', 'x + 1')}) * 0.25::DOUBLE"
    return f"""(WITH s AS (SELECT *, {site_sql(PLAIN, 'y', 'x')} AS c, {site_sql(PLAIN, 'y', 'x + 1')} AS n, {atc('y', 'x')} AS v, {side} AS sd, {ends} AS en, {corner} AS co FROM {source})
SELECT * EXCLUDE (c, n, v, sd, en, co), CASE WHEN c = 0 THEN v WHEN c = 2 THEN co WHEN n = 0 THEN sd * 0.5::DOUBLE ELSE en * 0.5::DOUBLE END AS r,
CASE WHEN c = 1 THEN v ELSE (sd + en) * 0.25::DOUBLE END AS g, CASE WHEN c = 2 THEN v WHEN c = 0 THEN co WHEN n = 0 THEN en * 0.5::DOUBLE ELSE sd * 0.5::DOUBLE END AS b FROM s)"""


@query("p6_demosaic_preview", f"SELECT frame_id, y::INTEGER AS y, x::INTEGER AS x, {', '.join(f'{micro_sql(c)} AS {c}' for c in RGB)} FROM {p6_sql(MOSAIC_PIXELS)}")
def p6(spark, sf):
    return micros(tiles.demosaic_preview(tiled(spark, sf)), "frame_id", "y", "x")


@query("j5_stencil", f"SELECT frame_id, CAST(sum({at0('y - 1', 'x')} + {at0('y + 1', 'x')} + {at0('y', 'x - 1')} + {at0('y', 'x + 1')}) AS DOUBLE) AS cross_sum, "
       f"CAST(sum({at0('y - 1', 'x - 1')} + {at0('y - 1', 'x + 1')} + {at0('y + 1', 'x - 1')} + {at0('y + 1', 'x + 1')}) AS DOUBLE) AS corner_sum FROM {MOSAIC_PIXELS} GROUP BY frame_id")  # fmt: skip
def j5(spark, sf):
    rows = tiles.site_rows(tiled(spark, sf))

    def total(steps) -> str:
        return " + ".join(tiles.pixel_or_zero(f"(y + {dy})", f"(x + {dx})") for dx, dy in steps)

    sums = {"cross_sum": total(tiles.CROSS), "corner_sum": total(tiles.CORNERS)}
    return rows.groupBy("frame_id").agg(*[F.expr(f"sum({e})").alias(n) for n, e in sums.items()])


def p7_sql() -> str:
    """Lists per frame: values around it, the low-pass at half size, both ratios, greens; then a row per pixel."""
    wide = lambda y, x: f"e[({y} + 4) * 15 + ({x}) + 5]"
    raw = lambda y, x: f"(CASE WHEN ({x}) BETWEEN 0 AND 7 AND ({y}) BETWEEN 0 AND 7 THEN {wide(y, x)} ELSE 0 END)"
    half = lambda y, x: f"low[({y} + 1) * 6 + ({x}) + 2]"
    green = lambda y, x: f"gr[({y} + 1) * 10 + ({x}) + 2]"
    spot = lambda y, x: f"greatest(0, least(7, {y})) // 2 * 4 + greatest(0, least(7, {x})) // 2 + 1"
    gap = lambda y, x: f"({raw(y, x)} - {green(y, x)})"

    def steps(pairs) -> str:
        return " + ".join(f"abs({half('k // 4', 'k % 4')} - {half(f'k // 4 + ({dy})', f'k % 4 + ({dx})')})" for dx, dy in pairs)

    def ratio(first, second) -> str:
        return f"list_transform(range(16), lambda k: ({steps(first)}) / (0.00001::DOUBLE + ({steps(first)}) + ({steps(second)})))"

    def chosen(name: str) -> str:
        y, x = "(k // 10 - 1)", "(k % 10 - 1)"
        near = " + ".join(f"{name}[{spot(f'{y} + ({dy})', f'{x} + ({dx})')}]" for dy in (-1, 1) for dx in (-1, 1))
        here = f"{name}[{spot(y, x)}]"
        return f"list_transform(range(100), lambda k: CASE WHEN abs(0.5 - {here}) < abs(0.5 - 0.25 * ({near})) THEN 0.25 * ({near}) ELSE {here} END)"

    y, x = "(k // 10 - 1)", "(k % 10 - 1)"
    black = f"(CASE {site_sql('pattern', '(k // 15 + 4)', '(k % 15 + 4)')} WHEN 0 THEN 64.0::DOUBLE WHEN 1 THEN 70.0::DOUBLE ELSE 90.0::DOUBLE END)"
    taps = "[1.0::DOUBLE, 4.0::DOUBLE, 6.0::DOUBLE, 4.0::DOUBLE, 1.0::DOUBLE]"
    value = "e[(2 * (k // 6 - 1) + t // 5 + 2) * 15 + 2 * (k % 6 - 1) + t % 5 + 3]"
    across = f"0.5 * ({raw(y, f'{x} - 1')} + {raw(y, f'{x} + 1')}) + 0.25 * (2 * {raw(y, x)} - {raw(y, f'{x} - 2')} - {raw(y, f'{x} + 2')})"
    along = f"0.5 * ({raw(f'{y} - 1', x)} + {raw(f'{y} + 1', x)}) + 0.25 * (2 * {raw(y, x)} - {raw(f'{y} - 2', x)} - {raw(f'{y} + 2', x)})"
    lists = f"""WITH m AS (SELECT frame_id, pattern, px FROM {MOSAICS}),
a AS (SELECT *, list_transform(range(225), lambda k: greatest(0, px[greatest(0, least(7, k // 15 - 4)) * 8 + greatest(0, least(7, k % 15 - 4)) + 1] - {black})) AS e FROM m),
b AS (SELECT *, list_transform(range(36), lambda k: list_sum(list_transform(range(25), lambda t: {taps}[t // 5 + 1] * {taps}[t % 5 + 1] * {value})) / 256) AS low FROM a),
c AS (SELECT *, {ratio([(0, -1), (0, 1)], [(-1, 0), (1, 0)])} AS vh, {ratio([(-1, -1), (1, 1)], [(1, -1), (-1, 1)])} AS pq FROM b),
d AS (SELECT *, {chosen('vh')} AS vt, {chosen('pq')} AS pt FROM c),
g AS (SELECT *, list_transform(range(100), lambda k: CASE WHEN {site_sql('pattern', '(k // 10 + 1)', '(k % 10 + 1)')} = 1 THEN {raw(y, x)}
  ELSE ({along}) * (1 - vt[k + 1]) + ({across}) * vt[k + 1] END) AS gr FROM d),
r AS (SELECT *, i // 8 AS y, i % 8 AS x, {site_sql('pattern', 'i // 8', 'i % 8')} AS site, {site_sql('pattern', 'i // 8', 'i % 8 + 1')} AS beside FROM g, range(64) t(i)),
s AS (SELECT *, {green('y', 'x')} AS g, {green('y', 'x')} + 0.5 * ({gap('y', 'x - 1')} + {gap('y', 'x + 1')}) AS ac, {green('y', 'x')} + 0.5 * ({gap('y - 1', 'x')} + {gap('y + 1', 'x')}) AS al,
  {green('y', 'x')} + 0.5 * ({gap('y - 1', 'x - 1')} + {gap('y + 1', 'x + 1')}) * (1 - pt[(y + 1) * 10 + x + 2]) + 0.5 * ({gap('y - 1', 'x + 1')} + {gap('y + 1', 'x - 1')}) * pt[(y + 1) * 10 + x + 2] AS ot FROM r)"""
    red = f"CASE site WHEN 0 THEN {raw('y', 'x')} WHEN 2 THEN ot ELSE CASE WHEN beside = 0 THEN ac ELSE al END END"
    blue = f"CASE site WHEN 2 THEN {raw('y', 'x')} WHEN 0 THEN ot ELSE CASE WHEN beside = 0 THEN al ELSE ac END END"
    cells = ", ".join(f"{micro_sql(v)} AS {c}" for c, v in zip(RGB, (red, "g", blue)))
    return f"{lists} SELECT frame_id, y::INTEGER AS y, x::INTEGER AS x, {cells} FROM s"


@query("p7_demosaic_edges", p7_sql())
def p7(spark, sf):
    t = tiles.cut_tiles(mosaics(spark, sf), 8, 8, tiles.EDGE_HALO)
    t = t.withColumn("black_rgb", F.array(F.lit(64.0), F.lit(70.0), F.lit(90.0)))
    return micros(tiles.plane_pixels(tiles.demosaic_edges(t)), "frame_id", "y", "x")


# --- develop -----------------------------------------------------------------

# parameters of a frame, from its number
FRAME_PARAMS = (
    "(SELECT vec_id AS frame_id, 1.0::DOUBLE + (vec_id % 7) * 0.1::DOUBLE AS gr, 1.0::DOUBLE + (vec_id % 5) * 0.2::DOUBLE AS gb, "
    "[1.1::DOUBLE, 0.05::DOUBLE, -0.05::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.1::DOUBLE, -0.1::DOUBLE, 0.0::DOUBLE, 1.2::DOUBLE] AS m FROM embeddings)"
)


def frame_params(spark, sf):
    k = F.col("frame_id")
    return mosaics(spark, sf).select(
        "frame_id",
        ((k % 7).cast("double") * 0.1 + 1.0).alias("gain_r"),
        ((k % 5).cast("double") * 0.2 + 1.0).alias("gain_b"),
        F.array(*[F.lit(v) for v in (1.1, 0.05, -0.05, 0.0, 1.0, 0.1, -0.1, 0.0, 1.2)]).alias("fused"),
        F.array(F.lit(64.0), F.lit(70.0), F.lit(90.0)).alias("src_black"),
        F.lit(16383.0).alias("src_white"),
        F.lit(8).alias("sensor_w"),
        F.lit(8).alias("sensor_h"),
    )


def develop_sql(source: str, curve: str, display: bool, black, white: str) -> str:
    norm = ", ".join(f"greatest(0, least(1, (d.{c} - {b}) * (1.0::DOUBLE / ({white} - {b})))) AS {c}0" for c, b in zip(RGB, black))
    o = ", ".join(f"greatest(0, m[{3 * i + 1}] * r2 + m[{3 * i + 2}] * g2 + m[{3 * i + 3}] * b2) AS o{i}" for i in range(3))
    if display:
        tail = ", o AS (SELECT *, greatest(rw, g0, bw) AS mx FROM w), h AS (SELECT *, CASE WHEN mx > 0.95::DOUBLE THEN least((mx - 0.95::DOUBLE) / 0.05::DOUBLE, 1) ELSE 0 END AS k, least(mx, 1) AS n FROM o), "
        tail += f"i AS (SELECT *, rw + (n - rw) * k AS r2, g0 + (n - g0) * k AS g2, bw + (n - bw) * k AS b2 FROM h), z AS (SELECT *, {o} FROM i), f AS (SELECT frame_id, y, x, o0 AS e0, o1 AS e1, o2 AS e2 FROM z)"
    else:
        tail = f", i AS (SELECT *, rw AS r2, g0 AS g2, bw AS b2 FROM w), z AS (SELECT *, {o} FROM i), l AS (SELECT *, greatest(o0, o1, o2) AS mx, 0.2126::DOUBLE * o0 + 0.7152::DOUBLE * o1 + 0.0722::DOUBLE * o2 AS ly FROM z), "
        tail += "q AS (SELECT *, greatest(0, least(ly, mx)) AS lu, CASE WHEN mx > 1 THEN least(mx - 1, 1) ELSE 0 END AS k FROM l), f AS (SELECT frame_id, y, x, o0 + (lu - o0) * k AS e0, o1 + (lu - o1) * k AS e1, o2 + (lu - o2) * k AS e2 FROM q)"
    codes = ", ".join(f"{u16_sql(curve.replace('{x}', f'e{i}'))} AS {c}" for i, c in enumerate(RGB))
    return (
        f"WITH n AS (SELECT d.frame_id, d.y, d.x, {norm}, p.gr, p.gb, p.m FROM {p5_sql(source)} d JOIN {FRAME_PARAMS} p USING (frame_id)), "
        f"w AS (SELECT *, r0 * gr AS rw, b0 * gb AS bw FROM n){tail} SELECT frame_id, y::INTEGER AS y, x::INTEGER AS x, {codes} FROM f"
    )


SRC_BLACK = ("64.0::DOUBLE", "70.0::DOUBLE", "90.0::DOUBLE")


@query("p11_develop", develop_sql(MOSAIC_PIXELS, ENCODE_SQL["t3_slog3"][1], False, SRC_BLACK, "16383.0::DOUBLE"))
def p11(spark, sf):
    out = develop.develop(tiled(spark, sf), frame_params(spark, sf), "S-Log3")
    return out.select("frame_id", "y", "x", *RGB)


LENS_PX = (
    f"(SELECT g.frame_id, g.pattern, g.y, g.x, l.px FROM {MOSAIC_PIXELS} g JOIN (SELECT frame_id, list(CAST({P3_VALUE} AS BIGINT) ORDER BY y, x) AS px FROM {gain_sql(PLAIN_NODES)} GROUP BY frame_id) l USING (frame_id))"
)


@query("p11_develop_lens", develop_sql(LENS_PX, ENCODE_SQL["t2_rec709"][1], True, ("0.0::DOUBLE",) * 3, "65535.0::DOUBLE"))
def p11_lens(spark, sf):
    g = grids(spark, sf).withColumnRenamed("clip_id", "frame_id")
    out = develop.develop(tiled(spark, sf), frame_params(spark, sf), "Rec.709", lens_mode="Full", grids=g, grid_key="frame_id")
    return out.select("frame_id", "y", "x", *RGB)


@query("k4_rgb16_frames", "SELECT frame_id, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM (" + develop_sql(MOSAIC_PIXELS, ENCODE_SQL["t2_rec709"][1], True, SRC_BLACK, "16383.0::DOUBLE") + ") GROUP BY frame_id")
def k4(spark, sf):
    """Written as packed tiles, six bytes per pixel, then read back."""
    from rawlake.session import work_folder

    out = develop.develop_tiles(tiled(spark, sf), frame_params(spark, sf), "Rec.709")
    target = f"{work_folder(spark)}/rgb16"
    out.write.parquet(target)
    back = develop.rgb16_pixels(spark.read.parquet(target))
    return back.groupBy("frame_id").agg(F.count(F.lit(1)).alias("pixels"), *[F.sum(c).alias(c) for c in RGB])


# --- thumbnails --------------------------------------------------------------

BOX_W, BOX_H = 6, 4
FIT = "(SELECT 4 AS out_w, 4 AS out_h)"  # 8x8 in a 6x4 box
CCM = [0.9, 0.05, 0.0, 0.1, 0.85, 0.1, 0.0, 0.1, 0.9]
SAMPLED = (
    f"(SELECT m.frame_id, m.pattern, m.px, ty.i AS ty, tx.i AS tx, (ty.i * 8) // 4 AS y, (tx.i * 8) // 4 AS x FROM {MOSAICS} m, range(4) ty(i), range(4) tx(i))"
)


def _display_sql(e: str) -> str:
    shown = SRGB_SQL.replace("{x}", f"greatest(0, least(1, {e}))")
    return f"CAST(floor(greatest(0, least(1, {shown})) * 255.0::DOUBLE + 0.5) AS INTEGER)"


def _thumb_sql(graded: bool) -> str:
    n = ", ".join(f"(d.{c} - 64.0::DOUBLE) / 16319.0::DOUBLE * pow(2.0::DOUBLE, 0.3::DOUBLE) * {g}::DOUBLE AS {c}1" for c, g in zip(RGB, ("1.08", "1.0", "0.97")))
    m = ", ".join(f"{CCM[i]!r}::DOUBLE * r1 + {CCM[3 + i]!r}::DOUBLE * g1 + {CCM[6 + i]!r}::DOUBLE * b1 AS {c}2" for i, c in enumerate(RGB))
    sm = "(greatest(0, least(1, ({v} - {a}) / ({b} - {a}))) ** 2 * (3 - 2 * greatest(0, least(1, ({v} - {a}) / ({b} - {a})))))"
    sw = "(1 - " + sm.format(v="ly", a="0.0::DOUBLE", b="0.35::DOUBLE") + ")"
    hw = sm.format(v="ly", a="0.5::DOUBLE", b="1.0::DOUBLE")
    t = ", ".join(f"greatest(0, (greatest(0, ({c}2 + 0.1::DOUBLE * {sw}) + -0.2::DOUBLE * {hw} * ({c}2 + 0.1::DOUBLE * {sw})) - 0.18::DOUBLE) * 1.2::DOUBLE + 0.18::DOUBLE) AS {c}3" for c in RGB)
    base = (
        f"WITH d AS (SELECT * FROM {p6_sql(SAMPLED)}), n AS (SELECT frame_id, ty, tx, {n} FROM d), m AS (SELECT *, {m} FROM n), "
        f"l AS (SELECT *, 0.2126::DOUBLE * r2 + 0.7152::DOUBLE * g2 + 0.0722::DOUBLE * b2 AS ly FROM m), t AS (SELECT *, {t} FROM l), "
        "s AS (SELECT *, 0.2126::DOUBLE * r3 + 0.7152::DOUBLE * g3 + 0.0722::DOUBLE * b3 AS l3 FROM t), "
        f"o AS (SELECT frame_id, ty, tx, {', '.join(f'l3 + ({c}3 - l3) * 1.1::DOUBLE AS {c}' for c in RGB)} FROM s) "
    )
    if graded:
        bins = " UNION ALL ".join(
            f"SELECT frame_id, '{k}' AS channel, CAST(floor(greatest(0, least(1, {e})) * 63.0::DOUBLE) AS INTEGER) AS bin FROM o"
            for k, e in [("luma", "0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b"), *[(c, c) for c in RGB]]
        )
        return base + f"SELECT channel, bin, count(*) AS n FROM ({bins}) GROUP BY channel, bin"
    # the curve and its inverse cancel for Gamma 2.4 on what is not negative
    return base + f"SELECT frame_id, ty::INTEGER AS ty, tx::INTEGER AS tx, {', '.join(f'{_display_sql(c)} AS {c}' for c in RGB)} FROM o"


def thumb_input(spark, sf):
    t = tiled(spark, sf)
    return t.withColumns({"black": F.lit(64.0), "white": F.lit(16383.0), "ccm": F.array(*[F.lit(v) for v in CCM])})




def thumb_grade():
    values = {"exposure": 0.3, "shadows": 0.1, "highlights": -0.2, "contrast": 1.2, "saturation": 1.1, "wb_r": 1.08, "wb_g": 1.0, "wb_b": 0.97}
    return {**{k: F.lit(v) for k, v in values.items()}, "adjust": F.lit(True)}


@query("p15_thumbnail", _thumb_sql(False))
def p15(spark, sf):
    t = preview.thumbnails(thumb_input(spark, sf), thumb_grade(), box_w=BOX_W, box_h=BOX_H)
    return t.select("frame_id", "ty", "tx", *RGB)


@query("a6_preview_histogram", _thumb_sql(True))
def a6_preview(spark, sf):
    t = preview.thumbnails(thumb_input(spark, sf), thumb_grade(), box_w=BOX_W, box_h=BOX_H, graded=True)
    return preview.histogram(t.withColumn("all", F.lit(1)), ("all",)).drop("all")


@query("k6_thumbnail_bytes", f"SELECT frame_id, 4 AS w, 4 AS h, string_agg(upper(lpad(format('{{:x}}', r), 2, '0') || lpad(format('{{:x}}', g), 2, '0') || lpad(format('{{:x}}', b), 2, '0')) || 'FF', '' ORDER BY ty, tx) AS rgba FROM ({_thumb_sql(False)}) GROUP BY frame_id")
def k6(spark, sf):
    t = preview.thumbnails(thumb_input(spark, sf), thumb_grade(), box_w=BOX_W, box_h=BOX_H)
    return preview.rgba_frames(t).withColumn("rgba", F.hex("rgba"))


IMG = f"(SELECT frame_id, list_transform(px[1:64], lambda v: v % 256) AS rgba FROM {MOSAICS})"


def _at4(y: str, x: str) -> str:
    return f"rgba[({y} * 4 + {x}) * 4 + ch + 1]::DOUBLE"


@query(
    "p16_resize",
    f"""WITH g AS (SELECT frame_id, rgba, ty.i AS ty, tx.i AS tx, c.i AS ch, ty.i * 4.0::DOUBLE / 7 AS sy, tx.i * 4.0::DOUBLE / 6 AS sx FROM {IMG}, range(7) ty(i), range(6) tx(i), range(4) c(i)),
h AS (SELECT *, least(CAST(floor(sy) AS BIGINT), 3) AS y0, least(CAST(floor(sx) AS BIGINT), 3) AS x0 FROM g),
k AS (SELECT *, least(y0 + 1, 3) AS y1, least(x0 + 1, 3) AS x1, sy - y0 AS fy, sx - x0 AS fx FROM h),
v AS (SELECT *, {_at4('y0', 'x0')} + ({_at4('y0', 'x1')} - {_at4('y0', 'x0')}) * fx AS t, {_at4('y1', 'x0')} + ({_at4('y1', 'x1')} - {_at4('y1', 'x0')}) * fx AS b FROM k)
SELECT frame_id, ty::INTEGER AS ty, tx::INTEGER AS tx, ch::INTEGER AS ch, CAST(greatest(0, least(255, floor(t + (b - t) * fy + 0.5))) AS INTEGER) AS v FROM v""",
)
def p16(spark, sf):
    m = mosaics(spark, sf)
    img = m.select("frame_id", F.lit(4).alias("w"), F.lit(4).alias("h"), F.transform("px", lambda v: v % 256).alias("rgba"))
    return preview.resized(img, F.lit(6), F.lit(7))
