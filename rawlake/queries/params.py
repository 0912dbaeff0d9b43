"""Matrices, white balance, levels and other per-clip parameters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import matrix as mx
from rawlake.functions import numeric
from rawlake.operators import params, tonemap
from rawlake.queries.base import CLIPS, PATTERNS, case_sql, clip_matrices, micro, micro_sql, pick, pick_sql, query, table

# --- SQL matrix maths on lists of nine --------------------------------------


def sql_list(cells) -> str:
    return "[" + ", ".join(cells) + "]"


def sql_const(values) -> str:
    return sql_list(f"{float(v)!r}::DOUBLE" for v in values)


def sql_mul(a: str, b: str) -> str:
    return sql_list(
        f"{a}[{3 * r + 1}] * {b}[{c + 1}] + {a}[{3 * r + 2}] * {b}[{c + 4}] + {a}[{3 * r + 3}] * {b}[{c + 7}]"
        for r in range(3)
        for c in range(3)
    )


def sql_vec(m: str, v: str) -> str:
    return sql_list(f"{m}[{3 * r + 1}] * {v}[1] + {m}[{3 * r + 2}] * {v}[2] + {m}[{3 * r + 3}] * {v}[3]" for r in range(3))


def sql_t(m: str) -> str:
    return sql_list(f"{m}[{3 * c + r + 1}]" for r in range(3) for c in range(3))


def sql_det(m: str) -> str:
    return (
        f"({m}[1] * ({m}[5] * {m}[9] - {m}[6] * {m}[8]) - {m}[2] * ({m}[4] * {m}[9] - {m}[6] * {m}[7]) "
        f"+ {m}[3] * ({m}[4] * {m}[8] - {m}[5] * {m}[7]))"
    )


def sql_inv(m: str) -> str:
    idx = [
        (5, 9, 6, 8), (3, 8, 2, 9), (2, 6, 3, 5),
        (6, 7, 4, 9), (1, 9, 3, 7), (3, 4, 1, 6),
        (4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4),
    ]
    return sql_list(f"({m}[{a}] * {m}[{b}] - {m}[{c}] * {m}[{d}]) / {sql_det(m)}" for a, b, c, d in idx)


def sql_sums(m: str) -> str:
    return sql_list(f"{m}[{3 * r + 1}] + {m}[{3 * r + 2}] + {m}[{3 * r + 3}]" for r in range(3))


def sql_dist(m: str) -> str:
    return " + ".join(
        f"pow({m}[{3 * r + 1}] + {m}[{3 * r + 2}] + {m}[{3 * r + 3}] - {w!r}::DOUBLE, 2)" for r, w in enumerate(vocab.D50)
    )


def sql_scaled_rows(m: str, f: str) -> str:
    return sql_list(f"{m}[{i + 1}] * {f}[{i // 3 + 1}]" for i in range(9))


def nine_out(col: str) -> str:
    return ", ".join(f"{micro_sql(f'{col}[{i + 1}]')} AS m{i}" for i in range(9))


def nine(col) -> list:
    return [F.expr(f"bigint(floor({col}[{i}] * 1e6D + 0.5D)) AS m{i}") for i in range(9)]


BRAD, BRAD_INV = sql_const(mx.BRADFORD), sql_const(mx.BRADFORD_INV)


def bradford_steps(src: str, white: str, prev: str) -> str:
    """CTEs that add ``brad``: adaptation from column ``white`` to D65."""
    return (
        f"{src}_c AS (SELECT *, {sql_vec(BRAD, white)} AS _cs, {sql_vec(BRAD, sql_const(vocab.D65))} AS _cd FROM {prev}), "
        f"{src}_f AS (SELECT *, [_cd[1] / _cs[1], _cd[2] / _cs[2], _cd[3] / _cs[3]] AS _cf FROM {src}_c), "
        f"{src}_s AS (SELECT *, {sql_scaled_rows(BRAD, '_cf')} AS _sm FROM {src}_f), "
        f"{src} AS (SELECT * EXCLUDE (_cs, _cd, _cf, _sm), {sql_mul(BRAD_INV, '_sm')} AS brad FROM {src}_s)"
    )


# --- M1 .. M4 ----------------------------------------------------------------

M1 = f"""
WITH c AS (SELECT clip_id, coalesce(color_matrix, {sql_const(mx.IDENTITY)}) AS a, coalesce(forward_matrix1, {sql_const(mx.IDENTITY)}) AS b, neutral FROM {CLIPS}),
i AS (SELECT *, {sql_inv('a')} AS ia, {sql_mul('a', 'b')} AS ab, {sql_vec('a', 'neutral')} AS v FROM c)
SELECT clip_id, {', '.join(f"{micro_sql(f'ia[{k + 1}]')} AS i{k}, {micro_sql(f'ab[{k + 1}]')} AS p{k}, {micro_sql(f'(a[{k + 1}] * 0.5 + b[{k + 1}] * 0.5)')} AS l{k}" for k in range(9))},
{', '.join(f"{micro_sql(f'v[{k + 1}]')} AS v{k}" for k in range(3))} FROM i
"""


@query("m1_matrix_algebra", M1)
def m1(spark, sf):
    c = clip_matrices(spark, sf)
    one = F.expr(mx.constant(mx.IDENTITY))
    c = c.withColumns({"a": F.coalesce("color_matrix", one), "b": F.coalesce("forward_matrix1", one)})
    steps = {"ia": mx.inverse("a"), "ab": mx.product("a", "b"), "l": mx.mean_of("a", "b"), "v": mx.apply("a", "neutral")}
    c = c.withColumns({n: F.expr(text) for n, text in steps.items()})
    cells = [micro(F.get(col, k)).alias(f"{n}{k}") for n, col in (("i", "ia"), ("p", "ab"), ("l", "l")) for k in range(9)]
    return c.select("clip_id", *cells, *[micro(F.get("v", k)).alias(f"v{k}") for k in range(3)])


GAMUT_ROWS = ", ".join("('" + g[0] + "', " + ", ".join(f"{v!r}::DOUBLE" for v in g[1:]) + ")" for g in vocab.GAMUT)
DIM_GAMUT = f"""(
WITH g(name, xr, yr, xg, yg, xb, yb, xw, yw) AS (VALUES {GAMUT_ROWS}),
b AS (SELECT *, [xr / yr, xg / yg, xb / yb, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, (1 - xr - yr) / yr, (1 - xg - yg) / yg, (1 - xb - yb) / yb] AS m,
  [xw / yw, 1.0::DOUBLE, (1 - xw - yw) / yw] AS w FROM g),
i AS (SELECT *, {sql_inv('m')} AS im FROM b), s AS (SELECT *, {sql_vec('im', 'w')} AS s FROM i),
r AS (SELECT *, {sql_list(f'm[{k + 1}] * s[{k % 3 + 1}]' for k in range(9))} AS rgb FROM s)
SELECT name, CASE WHEN name IN ('Rec.709', 'sRGB') THEN {sql_const(vocab.XYZ_TO_REC709)} ELSE {sql_inv('rgb')} END AS xyz_to_rgb FROM r)"""


@query(
    "m2_gamut_matrix",
    f"SELECT p.p_partkey, d.name, {nine_out('d.xyz_to_rgb')} FROM part p JOIN {DIM_GAMUT} d ON d.name = {pick_sql('p.p_partkey % 16', [g[0] for g in vocab.GAMUT])}",
)
def m2(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", pick(F.col("p_partkey") % 16, [g[0] for g in vocab.GAMUT]).alias("name"))
    dim = F.broadcast(params.dim_gamut(spark).select("name", "xyz_to_rgb"))
    return parts.join(dim, "name").select("p_partkey", "name", *nine("xyz_to_rgb"))


@query(
    "m3_bradford",
    f"WITH c AS (SELECT clip_id, neutral AS white FROM {CLIPS}), {bradford_steps('d', 'white', 'c')} SELECT clip_id, {nine_out('brad')} FROM d",
)
def m3(spark, sf):
    c = clip_matrices(spark, sf)
    return c.select("clip_id", F.expr(mx.bradford("neutral")).alias("brad")).select("clip_id", *nine("brad"))


CAT, CAT_INV, D65 = sql_const(mx.CAT16), sql_const(mx.CAT16_INV), sql_const(vocab.D65)


@query(
    "m4_cat16",
    f"""
WITH c AS (SELECT clip_id, neutral AS white, coalesce(color_matrix, {sql_const(mx.IDENTITY)}) AS cam FROM {CLIPS}),
f AS (SELECT *, {sql_vec(CAT, 'white')} AS s, {sql_vec(CAT, D65)} AS d FROM c),
g AS (SELECT *, [d[1] / s[1], d[2] / s[2], d[3] / s[3]] AS f, {sql_mul(CAT, 'cam')} AS lm, {sql_vec(CAT, sql_const(vocab.D50))} AS lv FROM f),
h AS (SELECT *, {sql_scaled_rows('lm', 'f')} AS am, [lv[1] * f[1], lv[2] * f[2], lv[3] * f[3]] AS av FROM g),
i AS (SELECT *, {sql_mul(CAT_INV, 'am')} AS xm, {sql_vec(CAT_INV, 'av')} AS xv FROM h),
j AS (SELECT *, {sql_mul(sql_const(vocab.XYZ_TO_REC709), 'xm')} AS o FROM i)
SELECT clip_id, {nine_out('o')}, {', '.join(f"{micro_sql(f'xv[{k + 1}]')} AS v{k}" for k in range(3))} FROM j
""",
)
def m4(spark, sf):
    c = clip_matrices(spark, sf).withColumn("cam", F.coalesce("color_matrix", F.expr(mx.constant(mx.IDENTITY))))
    d65, d50 = mx.constant(vocab.D65), mx.constant(vocab.D50)
    c = c.withColumns(
        {
            "o": F.expr(mx.cat16_output("cam", "neutral", d65, mx.constant(vocab.XYZ_TO_REC709))),
            "v": F.expr(mx.cat16_adapt(d50, "neutral", d65)),
        }
    )
    return c.select("clip_id", *nine("o"), *[micro(F.get("v", k)).alias(f"v{k}") for k in range(3)])


# --- A11, M5 .. M8 -----------------------------------------------------------


def oriented_steps(src: str, col: str, prev: str) -> str:
    """CTEs that add ``turned`` and ``pick`` for a matrix column."""
    return (
        f"{src}_t AS (SELECT *, {sql_t(col)} AS _t FROM {prev}), "
        f"{src}_i AS (SELECT *, {sql_inv(col)} AS _i, {sql_inv('_t')} AS _j FROM {src}_t), "
        f"{src}_d AS (SELECT *, {sql_dist(col)} AS d0, {sql_dist('_t')} AS d1, {sql_dist('_i')} AS d2, {sql_dist('_j')} AS d3 FROM {src}_i), "
        f"{src} AS (SELECT * EXCLUDE (_t, _i, _j, d0, d1, d2, d3), "
        "CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS pick, "
        f"CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN {col} WHEN d1 <= d2 AND d1 <= d3 THEN _t WHEN d2 <= d3 THEN _i ELSE _j END AS turned FROM {src}_d)"
    )


@query(
    "a11_orientation",
    f"WITH c AS (SELECT clip_id, coalesce(color_matrix2, {sql_const(mx.IDENTITY)}) AS m FROM {CLIPS}), {oriented_steps('o', 'm', 'c')} "
    f"SELECT clip_id, pick, {nine_out('turned')} FROM o",
)
def a11(spark, sf):
    c = clip_matrices(spark, sf).withColumn("m", F.coalesce("color_matrix2", F.expr(mx.constant(mx.IDENTITY))))
    c = c.withColumns({"pick": F.expr(mx.orientation_pick("m")), "turned": F.expr(mx.oriented("m"))})
    return c.select("clip_id", "pick", *nine("turned"))


def mean9(a: str, b: str) -> str:
    return sql_list(f"{a}[{i + 1}] * 0.5::DOUBLE + {b}[{i + 1}] * 0.5::DOUBLE" for i in range(9))


def camera_steps(cal: str = "coalesce(calibration_matrix1, calibration_matrix2)") -> str:
    eye = sql_const(mx.IDENTITY)
    return f"""
c0 AS (SELECT *, coalesce(color_matrix, {eye}) AS cm1, {cal} AS cal FROM {CLIPS}),
c1 AS (SELECT *, CASE WHEN forward_matrix1 IS NOT NULL AND forward_matrix2 IS NOT NULL THEN 'forward_mean' WHEN forward_matrix1 IS NOT NULL THEN 'forward'
  WHEN len(list_filter(cm1, lambda v: abs(v) > 0.01 AND abs(v) < 10)) > 0 THEN 'color' ELSE 'identity' END AS p FROM c0),
c2 AS (SELECT *, CASE p WHEN 'forward_mean' THEN {mean9('forward_matrix1', 'forward_matrix2')} WHEN 'forward' THEN forward_matrix1
  WHEN 'color' THEN CASE WHEN color_matrix2 IS NOT NULL THEN {mean9('cm1', 'color_matrix2')} ELSE cm1 END ELSE {eye} END AS base FROM c1),
c3 AS (SELECT *, {sql_dist('base')} < 0.05 AS near FROM c2), {oriented_steps('c4', 'base', 'c3')},
c5 AS (SELECT *, CASE WHEN p LIKE 'forward%' AND NOT near THEN p || '_oriented' ELSE p END AS matrix_path,
  CASE WHEN p = 'color' OR (p LIKE 'forward%' AND NOT near) THEN turned ELSE base END AS cam FROM c4),
c6 AS (SELECT * EXCLUDE (turned, pick), CASE WHEN p = 'color' AND cal IS NOT NULL THEN {sql_mul('cam', 'cal')} ELSE cam END AS cam_to_xyz FROM c5),
c7 AS (SELECT *, {sql_sums('cam_to_xyz')} AS rs FROM c6),
c8 AS (SELECT *, CASE WHEN p LIKE 'forward%' OR greatest(rs[1], rs[2], rs[3]) < 0.1 OR greatest(rs[1], rs[2], rs[3]) > 5 THEN {sql_const(vocab.D50)} ELSE rs END AS white FROM c7)"""


@query("m5_camera_matrix", f"WITH {camera_steps()} SELECT clip_id, matrix_path, {nine_out('cam_to_xyz')} FROM c8")
def m5(spark, sf):
    c = params.camera_matrix(clip_matrices(spark, sf))
    return c.select("clip_id", "matrix_path", *nine("cam_to_xyz"))


@query(
    "m6_reference_white",
    f"WITH {camera_steps()} SELECT clip_id, {', '.join(f'{micro_sql(f"white[{k + 1}]")} AS w{k}' for k in range(3))} FROM c8",
)
def m6(spark, sf):
    c = params.camera_matrix(clip_matrices(spark, sf))
    c = c.withColumn("white", F.expr(params.reference_white()))
    return c.select("clip_id", *[micro(F.get("white", k)).alias(f"w{k}") for k in range(3)])


FUSED = (
    f"{camera_steps()}, {bradford_steps('f1', 'white', 'c8')}, f2 AS (SELECT *, {sql_mul('brad', 'cam_to_xyz')} AS xyz65 FROM f1), "
    f"f3 AS (SELECT f2.*, d.xyz_to_rgb FROM f2 JOIN {DIM_GAMUT} d ON d.name = f2.gamut), "
    f"f4 AS (SELECT *, {sql_mul('xyz_to_rgb', 'xyz65')} AS fused FROM f3)"
)
STATIC_LEVELS = (
    "[black_levels[1], CASE WHEN black_level_count >= 4 THEN (black_levels[2] + black_levels[3]) / 2 ELSE black_levels[1] END, "
    "CASE WHEN black_level_count >= 4 THEN black_levels[4] ELSE black_levels[1] END]"
)


@query("m7_fused_matrix", f"WITH {FUSED} SELECT clip_id, gamut, {nine_out('fused')} FROM f4")
def m7(spark, sf):
    return params.clip_params(clip_matrices(spark, sf)).select("clip_id", "gamut", *nine("fused"))


# frames of a clip: every event whose user is the clip; its neutral comes from the properties
FRAMES = (
    "(SELECT event_id AS frame_id, user_id AS clip_id, CASE WHEN event_id % 4 = 0 THEN [1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE] "
    "ELSE [CAST(props->>'k' AS DOUBLE) / 100.0, 1.0::DOUBLE, value / 500.0] END AS neutral, "
    "CASE WHEN event_id % 3 = 0 THEN [CAST(props->>'k' AS DOUBLE), 0.0::DOUBLE + event_id % 2, 60.0::DOUBLE, 70.0::DOUBLE] END AS dynamic_black, "
    "CASE WHEN event_id % 6 = 0 THEN 4000.0::DOUBLE + event_id % 50 END AS dynamic_white FROM events)"
)


def frames(spark, sf):
    e = table(spark, sf, "events")
    k = F.from_json("props", "k double")["k"]
    event = F.col("event_id")
    own = F.array(k / 100.0, F.lit(1.0), F.col("value") / 500.0)
    return e.select(
        event.alias("frame_id"),
        F.col("user_id").alias("clip_id"),
        F.when(event % 4 == 0, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))).otherwise(own).alias("neutral"),
        F.when(event % 3 == 0, F.array(k, (event % 2).cast("double"), F.lit(60.0), F.lit(70.0))).alias("dynamic_black"),
        F.when(event % 6 == 0, (event % 50).cast("double") + 4000.0).alias("dynamic_white"),
    )


OWN_WHITE = sql_vec("cam_to_xyz", "neutral")
M8 = f"""
WITH {FUSED}, g0 AS (SELECT fr.frame_id, fr.neutral AS n2, fr.dynamic_black, fr.dynamic_white, f4.* FROM {FRAMES} fr JOIN f4 USING (clip_id)),
g1 AS (SELECT * REPLACE (n2 AS neutral) FROM g0),
g2 AS (SELECT *, {OWN_WHITE} AS sw0 FROM g1),
g3 AS (SELECT * EXCLUDE (brad), CASE WHEN neutral[1] > 1e-6 AND neutral[2] > 1e-6 AND neutral[3] > 1e-6 THEN
  [greatest(0.3, least(3.0, sw0[1])), greatest(0.3, least(3.0, sw0[2])), greatest(0.3, least(3.0, sw0[3]))] ELSE {D65} END AS sw FROM g2),
{bradford_steps('g4', 'sw', 'g3')}, g5 AS (SELECT *, {sql_mul('brad', 'cam_to_xyz')} AS x2 FROM g4), g6 AS (SELECT *, {sql_mul('xyz_to_rgb', 'x2')} AS own FROM g5),
g7 AS (SELECT *, CASE WHEN matrix_path LIKE 'color%' AND NOT (abs(neutral[1] - 1) < 1e-3 AND abs(neutral[2] - 1) < 1e-3 AND abs(neutral[3] - 1) < 1e-3) THEN own ELSE fused END AS ff FROM g6)
"""


@query("m8_frame_matrix", f"{M8} SELECT frame_id, {nine_out('ff')} FROM g7")
def m8(spark, sf):
    clips = params.clip_params(clip_matrices(spark, sf).drop("neutral"))
    return params.frame_params(clips, frames(spark, sf)).select("frame_id", *nine("fused"))


PREVIEW = (
    f"{camera_steps('calibration_matrix1')}, {bradford_steps('v1', 'white', 'c8')}, v2 AS (SELECT *, {sql_mul('brad', 'cam_to_xyz')} AS x65 FROM v1), "
    f"v3 AS (SELECT *, {sql_mul(sql_const(vocab.XYZ_TO_REC709), 'x65')} AS ccm FROM v2)"
)


@query("m5_preview_matrix", f"WITH {PREVIEW} SELECT clip_id, {nine_out('ccm')} FROM v3")
def m5_preview(spark, sf):
    return params.preview_matrix(clip_matrices(spark, sf)).select("clip_id", *nine("ccm"))


# --- levels, gains, codes ----------------------------------------------------

LEVEL_MODES = ["Dynamic", "Static", "4095/256"]
DYN_GREEN = "CASE WHEN dynamic_black[2] > 0 AND dynamic_black[3] > 0 THEN (dynamic_black[2] + dynamic_black[3]) / 2 ELSE greatest(dynamic_black[2], dynamic_black[3]) END"
LEVELS = f"(SELECT fr.frame_id, fr.dynamic_black, fr.dynamic_white, {STATIC_LEVELS} AS st, c.white_level FROM {FRAMES} fr JOIN {CLIPS} c USING (clip_id))"


@query(
    "c31_levels",
    f"SELECT frame_id, 'Dynamic' AS mode, CASE WHEN dynamic_black IS NULL THEN st[1] ELSE dynamic_black[1] END AS r, CASE WHEN dynamic_black IS NULL THEN st[2] ELSE {DYN_GREEN} END AS g, "
    f"CASE WHEN dynamic_black IS NULL THEN st[3] ELSE dynamic_black[4] END AS b, CASE WHEN dynamic_black IS NULL THEN white_level ELSE coalesce(dynamic_white, white_level) END AS w FROM {LEVELS} "
    f"UNION ALL SELECT frame_id, 'Static', st[1], st[2], st[3], white_level FROM {LEVELS}"
    + "".join(f" UNION ALL SELECT frame_id, '{n}', {b}::DOUBLE, {b}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE FROM {LEVELS}" for n, b, w in vocab.LEVEL_PRESET if b is not None),
)
def c31(spark, sf):
    clips = clip_matrices(spark, sf).select(
        "clip_id", params.static_levels(F.col("black_levels"), F.col("black_level_count")).alias("st"), "white_level"
    )
    f = params.attach(frames(spark, sf), clips, ["clip_id"], "inner", spread=["frame_id"])
    modes = []
    for mode, _, _ in vocab.LEVEL_PRESET:
        black, white = params.source_levels(
            mode, F.col("st"), F.col("white_level"), F.col("dynamic_black"), F.col("dynamic_white")
        )
        cells = [F.get(black, i).cast("double").alias(c) for i, c in enumerate("rgb")]
        modes.append(F.struct(F.lit(mode).alias("mode"), *cells, white.cast("double").alias("w")))
    return f.select("frame_id", F.inline(F.array(*modes)))


GAINS_OK = "neutral[1] > 1e-6 AND neutral[2] > 1e-6 AND neutral[3] > 1e-6"


@query(
    "c24_wb_gains",
    f"SELECT frame_id, CASE WHEN {GAINS_OK} THEN {micro_sql('neutral[2] / neutral[1]')} ELSE -1 END AS r, CASE WHEN {GAINS_OK} THEN {micro_sql('neutral[2] / neutral[3]')} ELSE -1 END AS b FROM {FRAMES}",
)
def c24(spark, sf):
    f = frames(spark, sf).withColumn("g", numeric.wb_gains(F.col("neutral")))
    return f.select(
        "frame_id",
        F.coalesce(micro(F.get("g", 0)), F.lit(-1)).alias("r"),
        F.coalesce(micro(F.get("g", 2)), F.lit(-1)).alias("b"),
    )


@query("f16_neutral_guard", f"SELECT frame_id, {GAINS_OK} AS usable FROM {FRAMES}")
def f16(spark, sf):
    return frames(spark, sf).select("frame_id", numeric.neutral_ok(F.col("neutral")).alias("usable"))


@query(
    "c25_gain_clamp",
    f"SELECT frame_id, {micro_sql('greatest(0.1::DOUBLE, least(10.0::DOUBLE, CASE WHEN neutral[1] > 1e-6 AND neutral[2] > 1e-6 THEN neutral[2] / neutral[1] ELSE 1 END))')} AS r, "
    f"{micro_sql('greatest(0.1::DOUBLE, least(10.0::DOUBLE, CASE WHEN neutral[3] > 1e-6 AND neutral[2] > 1e-6 THEN neutral[2] / neutral[3] ELSE 1 END))')} AS b FROM {FRAMES}",
)
def c25(spark, sf):
    n = [F.get("neutral", i) for i in range(3)]
    return frames(spark, sf).select(
        "frame_id", micro(numeric.wb_gain_clamped(n[1], n[0])).alias("r"), micro(numeric.wb_gain_clamped(n[1], n[2])).alias("b")
    )


RATIO = "greatest(0.1::DOUBLE, least(10.0::DOUBLE, (neutral[2] / neutral[1]) / greatest(neutral[2] / neutral[3], 1e-6::DOUBLE)))"


@query(
    "c26_temperature",
    f"SELECT frame_id, CASE WHEN NOT ({GAINS_OK}) THEN 5200000000 ELSE {micro_sql(f'greatest(2000.0::DOUBLE, least(10000.0::DOUBLE, CASE WHEN {RATIO} >= 1 THEN 5200 + ({RATIO} - 1) * 3000 ELSE 5200 - (1 - {RATIO}) * 3000 END))')} END AS temp FROM {FRAMES}",
)
def c26(spark, sf):
    f = frames(spark, sf).withColumn("g", numeric.wb_gains(F.col("neutral")))
    return f.select("frame_id", micro(numeric.temperature_from_gains(F.get("g", 0), F.get("g", 2))).alias("temp"))


@query(
    "c27_slider_gains",
    f"SELECT event_id AS frame_id, {micro_sql('1 + (value * 20.0::DOUBLE - 5200.0::DOUBLE) / 10000.0::DOUBLE')} AS r, {micro_sql('1.0::DOUBLE')} AS g, "
    f"{micro_sql('1 - (value * 20.0::DOUBLE - 5200.0::DOUBLE) / 10000.0::DOUBLE + (event_id % 200 - 100)::DOUBLE / 100.0::DOUBLE')} AS b FROM events",
)
def c27(spark, sf):
    e = table(spark, sf, "events")
    gains = numeric.gains_from_temperature(F.col("value") * 20.0, (F.col("event_id") % 200 - 100).cast("double"))
    return e.select(F.col("event_id").alias("frame_id"), *[micro(g).alias(c) for c, g in zip("rgb", gains)])


WHITE = "(p_retailprice * (p_size % 50) * 2)"


@query(
    "c20_bit_depth",
    f"SELECT p_partkey, CASE WHEN {WHITE} <= 1024 THEN 10 WHEN {WHITE} <= 4096 THEN 12 WHEN {WHITE} <= 16384 THEN 14 WHEN {WHITE} <= 65536 THEN 16 ELSE 12 END AS bits FROM part",
)
def c20(spark, sf):
    white = F.col("p_retailprice") * (F.col("p_size") % 50) * 2
    return table(spark, sf, "part").select("p_partkey", numeric.bit_depth(white).alias("bits"))


BAYER_ROWS = ", ".join(f"({c}, '{n}', '{label}', {w}::BIGINT)" for c, n, label, w in vocab.BAYER)


@query(
    "c21_bayer_codes",
    f"SELECT p.p_partkey, coalesce(b.name, 'RGGB') AS pattern, coalesce(b.label, 'RGGB') AS label, coalesce(b.code, 0)::INTEGER AS code, coalesce(b.filters, {vocab.BAYER[0][3]}) AS filters "
    f"FROM part p LEFT JOIN (VALUES {BAYER_ROWS}) b(code, name, label, filters) ON b.code = p.p_partkey % 11",
)
def c21(spark, sf):
    p = table(spark, sf, "part").withColumn("pattern", numeric.bayer_name(F.col("p_partkey") % 11))
    n = F.col("pattern")
    return p.select(
        "p_partkey", "pattern", numeric.bayer_label(n).alias("label"), numeric.bayer_code(n).alias("code"), numeric.bayer_filters(n).alias("filters")
    )


CFA_TEXT = {n: "".join(map(str, vocab.CFA.get(n, vocab.CFA["RGGB"]))) for n in PATTERNS}


def site_sql(pattern: str, y: str, x: str) -> str:
    return f"CAST(substr({case_sql(pattern, CFA_TEXT, None)}, CAST((({y}) % 2) * 2 + ({x}) % 2 + 1 AS INTEGER), 1) AS INTEGER)"


PART_SITES = f"(SELECT p_partkey, {pick_sql('p_partkey % 8', PATTERNS)} AS pattern, p_size AS ox, p_partkey // 7 AS oy FROM part)"


@query(
    "c22_cfa_shift",
    "SELECT p_partkey, pattern, " + " || ".join(f"CAST({site_sql('pattern', f'oy + {r}', f'ox + {c}')} AS VARCHAR)" for r in (0, 1) for c in (0, 1)) + f" AS cfa FROM {PART_SITES}",
)
def c22(spark, sf):
    p = table(spark, sf, "part").withColumn("pattern", numeric.bayer_name(F.col("p_partkey") % 8))
    oy = F.floor(F.col("p_partkey") / 7)
    cfa = numeric.cfa_shifted(F.col("pattern"), F.col("p_size"), oy)
    return p.select("p_partkey", "pattern", F.array_join(cfa.cast("array<string>"), "").alias("cfa"))


@query(
    "c23_sites",
    f"SELECT p_partkey, {site_sql('pattern', 'oy', 'ox')} AS color, CASE {site_sql('pattern', 'oy', 'ox')} WHEN 0 THEN 0 WHEN 2 THEN 3 ELSE CASE WHEN oy % 2 = 0 THEN 1 ELSE 2 END END AS channel FROM {PART_SITES}",
)
def c23(spark, sf):
    p = table(spark, sf, "part").withColumn("pattern", numeric.bayer_name(F.col("p_partkey") % 8))
    x, y = F.col("p_size"), F.floor(F.col("p_partkey") / 7)
    return p.select(
        "p_partkey",
        numeric.site_color(F.col("pattern"), x, y).alias("color"),
        numeric.lens_channel(F.col("pattern"), x, y).alias("channel"),
    )


@query(
    "c29_aspect_fit",
    "SELECT p_partkey, CASE WHEN w::DOUBLE / h::DOUBLE > 320.0::DOUBLE / 180.0::DOUBLE THEN 320 ELSE greatest(CAST(floor(180.0::DOUBLE * (w::DOUBLE / h::DOUBLE)) AS INTEGER), 1) END AS out_w, "
    "CASE WHEN w::DOUBLE / h::DOUBLE > 320.0::DOUBLE / 180.0::DOUBLE THEN greatest(CAST(floor(320.0::DOUBLE / (w::DOUBLE / h::DOUBLE)) AS INTEGER), 1) ELSE 180 END AS out_h "
    "FROM (SELECT p_partkey, p_size * 100 + 1 AS w, p_partkey % 3000 + 1 AS h FROM part)",
)
def c29(spark, sf):
    p = table(spark, sf, "part")
    w, h = numeric.aspect_fit(F.col("p_size") * 100 + 1, F.col("p_partkey") % 3000 + 1)
    return p.select("p_partkey", w.alias("out_w"), h.alias("out_h"))


@query(
    "c30_rational",
    "SELECT vec_id, i::INTEGER AS i, CAST(sign(v * 10000) * floor(abs(v * 10000) + 0.5) AS INTEGER) AS n, 10000 AS d FROM (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i))",
)
def c30(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "i", numeric.signed_rational(F.col("v").cast("double")).alias("q")).select("vec_id", "i", "q.n", "q.d")


@query(
    "c32_extended_white",
    "SELECT p_partkey, (1 << least(greatest(length(ltrim(bin(w), '0')), 1) + 2, 16)) - 1 AS ext FROM (SELECT p_partkey, CAST(least(65535, floor(p_retailprice * p_size)) AS BIGINT) AS w FROM part)",
)
def c32(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", numeric.extended_white(F.col("p_retailprice") * F.col("p_size")).alias("ext"))


@query(
    "a9_black_stats",
    f"SELECT clip_id, {micro_sql('list_sum(black_levels) / len(black_levels)')} AS mean, len(black_levels)::INTEGER AS n, black_levels[1] AS b0, "
    f"{micro_sql('coalesce(black_levels[4], list_sum(black_levels) / len(black_levels))')} AS b3 FROM (SELECT clip_id, CASE WHEN black_level_count = 4 THEN black_levels ELSE black_levels[1:2] END AS black_levels FROM {CLIPS})",
)
def a9(spark, sf):
    c = clip_matrices(spark, sf)
    levels = F.when(F.col("black_level_count") == 4, F.col("black_levels")).otherwise(F.slice("black_levels", 1, 2))
    c = c.withColumn("lv", levels)
    mean, count, padded = numeric.level_stats(F.col("lv"))
    return c.select("clip_id", micro(mean).alias("mean"), count.alias("n"), F.get(padded, 0).alias("b0"), micro(F.get(padded, 3)).alias("b3"))


@query(
    "f9_has_matrix",
    f"SELECT clip_id, coalesce(len(list_filter(color_matrix, lambda v: abs(v) > 0.01 AND abs(v) < 10)) > 0, false) AS has FROM {CLIPS}",
)
def f9(spark, sf):
    return clip_matrices(spark, sf).select("clip_id", numeric.has_colour_matrix(F.col("color_matrix")).alias("has"))


@query(
    "f10_non_zero",
    "SELECT vec_id, len(list_filter(list_transform(embedding[1:9], lambda e: floor(abs(e) * 12)), lambda v: v <> 0)) > 0 AS has FROM embeddings",
)
def f10(spark, sf):
    e = table(spark, sf, "embeddings")
    m = F.transform(F.slice("embedding", 1, 9), lambda v: F.floor(F.abs(v) * 12).cast("double"))
    return e.select("vec_id", numeric.non_zero_matrix(m).isNotNull().alias("has"))


@query(
    "f11_active_area",
    f"SELECT clip_id, CASE WHEN active_width > 0 THEN active_width ELSE width END AS w, CASE WHEN active_height > 0 THEN active_height ELSE height END AS h FROM {CLIPS}",
)
def f11(spark, sf):
    c = clip_matrices(spark, sf)
    return c.select(
        "clip_id",
        numeric.active_size(F.col("active_width"), F.col("width")).alias("w"),
        numeric.active_size(F.col("active_height"), F.col("height")).alias("h"),
    )


SLIDERS_SQL = {
    "exposure": "(event_id % 3)::DOUBLE * 0.008::DOUBLE",
    "contrast": "1.0::DOUBLE + (event_id % 5)::DOUBLE * 0.004::DOUBLE",
    "saturation": "1.0::DOUBLE",
    "shadows": "(event_id % 7)::DOUBLE * 0.0015::DOUBLE",
    "highlights": "0.0::DOUBLE",
    "temperature": "5200.0::DOUBLE + value - 250.0::DOUBLE",
    "tint": "(event_id % 2)::DOUBLE * 0.4::DOUBLE",
}
ACTIVE_SQL = " OR ".join(f"abs({SLIDERS_SQL[f]} - {d!r}::DOUBLE) > {t!r}::DOUBLE" for _, f, d, *_, t in vocab.SLIDER if t is not None)


@query("f12_grade_active", f"SELECT event_id, ({ACTIVE_SQL}) AS active FROM events")
def f12(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    sliders = {
        "exposure": (k % 3).cast("double") * 0.008,
        "contrast": (k % 5).cast("double") * 0.004 + 1.0,
        "saturation": F.lit(1.0),
        "shadows": (k % 7).cast("double") * 0.0015,
        "highlights": F.lit(0.0),
        "temperature": F.col("value") + 5200.0 - 250.0,
        "tint": (k % 2).cast("double") * 0.4,
    }
    return e.select("event_id", numeric.grade_active(sliders).alias("active"))


LIGHTS = [*vocab.ILLUMINANT, "candle", "D65 ", " Shade", "TUNGSTEN"]


@query(
    "m9_illuminant",
    f"SELECT p_partkey, coalesce({case_sql('lower(trim(n))', vocab.ILLUMINANT, None)}, -1)::INTEGER AS code FROM (SELECT p_partkey, {pick_sql(f'p_partkey % {len(LIGHTS)}', LIGHTS)} AS n FROM part)",
)
def m9(spark, sf):
    p = table(spark, sf, "part")
    name = pick(F.col("p_partkey") % len(LIGHTS), LIGHTS)
    return p.select("p_partkey", F.coalesce(params.illuminant_code(name), F.lit(-1)).alias("code"))


VUI = (
    f"SELECT s_suppkey, {case_sql('g', {k: v[0] for k, v in vocab.VUI_GAMUT.items()}, repr('bt2020'))} AS primaries, "
    f"{case_sql('g', {k: v[1] for k, v in vocab.VUI_GAMUT.items()}, repr('bt2020nc'))} AS matrix, {case_sql('t', vocab.VUI_TRANSFER, repr('unknown'))} AS trc "
    f"FROM (SELECT s_suppkey, {pick_sql('s_suppkey % 16', [g[0] for g in vocab.GAMUT])} AS g, {pick_sql('s_suppkey % 15', [t for t, _ in vocab.TRANSFER])} AS t FROM supplier)"
)


@query("j12_vui_lookup", VUI)
def j12(spark, sf):
    s = table(spark, sf, "supplier").select(
        "s_suppkey",
        pick(F.col("s_suppkey") % 16, [g[0] for g in vocab.GAMUT]).alias("gamut"),
        pick(F.col("s_suppkey") % 15, [t for t, _ in vocab.TRANSFER]).alias("transfer"),
    )
    return s.join(F.broadcast(vocab.dim_vui(spark)), ["gamut", "transfer"]).select("s_suppkey", "primaries", "matrix", "trc")


# --- M10 ---------------------------------------------------------------------


def tone_points(name: str) -> list[float]:
    return [*next(g for g in vocab.TONEMAP_GAMUT if g[0] == name)[1:], 0.3127, 0.3290]


def pulled_sql(p: list[str], pull, turn) -> list[str]:
    out = []
    for i in range(3):
        dx, dy = f"({p[2 * i]} - {p[6]})", f"({p[2 * i + 1]} - {p[7]})"
        a, k = f"{math.radians(1.0)!r}::DOUBLE", f"(1 - {pull[i]!r}::DOUBLE)"
        a = f"({turn[i]!r}::DOUBLE * pi() / 180)"
        out += [f"({p[6]} + ({dx} * cos({a}) - {dy} * sin({a})) * {k})", f"({p[7]} + ({dx} * sin({a}) + {dy} * cos({a})) * {k})"]
    return [*out, p[6], p[7]]


def base_sql(p: list[str]) -> str:
    xs, ys = p[0:6:2], p[1:6:2]
    return sql_list([*xs, *ys, *[f"1 - {x} - {y}" for x, y in zip(xs, ys)]])


def tone_matrices_sql(c: tonemap.ToneConfig) -> str:
    src = [f"{v!r}::DOUBLE" for v in tone_points(c.in_gamut)]
    dst = [f"{v!r}::DOUBLE" for v in tone_points(c.out_gamut)]
    inset, outset = pulled_sql(src, c.inset, c.rotate), pulled_sql(src, c.outset, c.rotate)
    sets = {"s": src, "d": dst, "i": inset, "o": outset}
    white = sql_list([f"{src[6]} / {src[7]}", "1.0::DOUBLE", f"(1 - {src[6]} - {src[7]}) / {src[7]}"])
    return f"""
WITH b AS (SELECT {', '.join(f'{base_sql(p)} AS b{k}' for k, p in sets.items())}, {white} AS w),
v AS (SELECT *, {', '.join(f'{sql_inv(f"b{k}")} AS v{k}' for k in sets)} FROM b),
g AS (SELECT *, {', '.join(f'{sql_vec(f"({sql_t(f"v{k}")})", "w")} AS g{k}' for k in sets)} FROM v),
x AS (SELECT *, {', '.join(f'{sql_list(f"v{k}[{n + 1}] * g{k}[{n % 3 + 1}]" for n in range(9))} AS x{k}' for k in sets)} FROM g),
y AS (SELECT *, {', '.join(f'{sql_inv(f"x{k}")} AS y{k}' for k in sets)} FROM x)
SELECT {sql_mul('ys', 'xi')} AS inset_mat, {sql_mul('yo', 'xs')} AS outset_mat, {sql_mul('yd', 'xs')} AS gamut_mat FROM y"""


M10_CONFIGS = {
    "display": tonemap.ToneConfig(),
    "cinema": tonemap.ToneConfig(in_gamut="Rec2020", out_gamut="P3D65", rotate=(2.0, -1.0, 3.0), outset=(0.1, 0.05, 0.1)),
    "camera": tonemap.ToneConfig(in_gamut="SGamut3", inset=(0.3, 0.2, 0.1)),
}
M10_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS config, * FROM ({tone_matrices_sql(c)})" for n, c in M10_CONFIGS.items()
)


@query(
    "m10_tone_params",
    "SELECT n.n_nationkey, q.config, "
    + ", ".join(f"{micro_sql(f'q.{m}_mat[{i + 1}]')} AS {m}{i}" for m in ("inset", "outset", "gamut") for i in range(9))
    + f" FROM nation n JOIN ({M10_SQL}) q ON q.config = {pick_sql('n.n_nationkey % 3', list(M10_CONFIGS))}",
)
def m10(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", pick(F.col("n_nationkey") % 3, list(M10_CONFIGS)).alias("config"))
    p = F.broadcast(tonemap.tone_params(spark, M10_CONFIGS))
    cells = [micro(F.get(f"{m}_mat", i)).alias(f"{m}{i}") for m in ("inset", "outset", "gamut") for i in range(9)]
    return n.join(p, "config").select("n_nationkey", "config", *cells)
