"""Curves, pixel jobs, grading and histograms over the pixel binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import curves, numeric
from rawlake.operators import develop, preview, tonemap
from rawlake.queries.base import PIXELS, micro, micro_sql, pixels, query, table
from rawlake.session import spread

RGB = ("r", "g", "b")
# every channel value of every pixel as a row
VALUES = f"(SELECT frame_id, x, unnest(['r', 'g', 'b']) AS channel, unnest([r, g, b]) AS v FROM {PIXELS})"


def values(spark, sf):
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in RGB])
    return pixels(spark, sf).select("frame_id", "x", F.inline(cells))


def _d(number: float) -> str:
    return f"{number!r}::DOUBLE"


def channels(expr: str, source: str = PIXELS, keys: str = "frame_id, x", quant=micro_sql) -> str:
    """SQL that maps each channel through an expression in ``{x}``."""
    cols = ", ".join(f"{quant(expr.replace('{x}', c))} AS {c}" for c in RGB)
    return f"SELECT {keys}, {cols} FROM {source}"


def out(df, keys=("frame_id", "x"), quant=micro):
    return df.select(*keys, *[quant(F.col(c)).alias(c) for c in RGB])


# SQL text of the curves, written from the published definitions
LOGC4 = dict(
    a="((262144.0::DOUBLE - 16) / 117.45::DOUBLE)", b="(928.0::DOUBLE / 1023)", c="(95.0::DOUBLE / 1023)"
)
LOGC4["s"] = "(7 * ln(2.0::DOUBLE) * pow(2.0::DOUBLE, 7 - 14 * {c} / {b}) / ({a} * {b}))".format(**LOGC4)
LOGC4["t"] = "((pow(2.0::DOUBLE, 14 * (-{c} / {b}) + 6) - 64) / {a})".format(**LOGC4)
NEG = "((0.097465473::DOUBLE - 0.12512219::DOUBLE) / 1.9754798::DOUBLE)"
POS = "((0.15277891::DOUBLE - 0.12512219::DOUBLE) / 1.9754798::DOUBLE)"
APPLE = (
    "CASE WHEN {x} < -0.05641088::DOUBLE THEN 0 WHEN {x} < 0.01::DOUBLE THEN 47.28711236::DOUBLE * ({x} + 0.05641088::DOUBLE) * ({x} + 0.05641088::DOUBLE) "
    "ELSE 0.08550479::DOUBLE * log2({x} + 0.00964052::DOUBLE) + 0.69336945::DOUBLE END"
)
ENCODE_SQL = {
    "t1_linear": ("Linear", "{x}"),
    "t2_rec709": (
        "Rec.709",
        "greatest(0, least(1, CASE WHEN {x} < 0.018::DOUBLE THEN 4.5::DOUBLE * {x} ELSE 1.099::DOUBLE * pow(greatest({x}, 0), 0.45::DOUBLE) - 0.099::DOUBLE END))",
    ),
    "t3_slog3": (
        "S-Log3",
        "CASE WHEN {x} >= 0.01125::DOUBLE THEN (420 + 261.5::DOUBLE * log10(({x} + 0.01::DOUBLE) / 0.19::DOUBLE)) / 1023 "
        "ELSE ({x} * (171.2102946929::DOUBLE - 95) / 0.01125::DOUBLE + 95) / 1023 END",
    ),
    "t4_vlog": (
        "V-Log",
        "CASE WHEN {x} < 0.01::DOUBLE THEN 5.6::DOUBLE * {x} + 0.125::DOUBLE ELSE 0.241514::DOUBLE * log10({x} + 0.00873::DOUBLE) + 0.598206::DOUBLE END",
    ),
    "t5_logc3": (
        "ARRI LogC3",
        "CASE WHEN {x} > 0.010591::DOUBLE THEN 0.247190::DOUBLE * log10(5.555556::DOUBLE * {x} + 0.052272::DOUBLE) + 0.385537::DOUBLE "
        "ELSE 5.367655::DOUBLE * {x} + 0.092809::DOUBLE END",
    ),
    "t6_logc4": (
        "ARRI LogC4",
        "CASE WHEN {x} >= %(t)s THEN (log2(%(a)s * {x} + 64) - 6) / 14 * %(b)s + %(c)s ELSE ({x} - %(t)s) / %(s)s END"
        % {k: v.format(**LOGC4) for k, v in LOGC4.items()},
    ),
    "t7_clog3": (
        "C-Log3",
        f"CASE WHEN {{x}} < {NEG} THEN -0.36726845::DOUBLE * log10(greatest(1 - 14.98325::DOUBLE * {{x}}, 1e-10::DOUBLE)) + 0.12783901::DOUBLE "
        f"WHEN {{x}} <= {POS} THEN 1.9754798::DOUBLE * {{x}} + 0.12512219::DOUBLE "
        "ELSE 0.36726845::DOUBLE * log10(14.98325::DOUBLE * {x} + 1) + 0.12240537::DOUBLE END",
    ),
    "t8_flog2": (
        "F-Log2",
        "CASE WHEN {x} >= 0.000889::DOUBLE THEN 0.245281::DOUBLE * log10(5.555556::DOUBLE * {x} + 0.064829::DOUBLE) + 0.384316::DOUBLE "
        "ELSE 8.799461::DOUBLE * {x} + 0.092864::DOUBLE END",
    ),
    "t9_apple_log": ("Apple Log", APPLE),
    "t10_apple_log2": ("Apple Log 2", APPLE),
    "t11_acescct": (
        "ACES CCT",
        "CASE WHEN {x} > 0.0078125::DOUBLE THEN (log2({x}) + 9.72::DOUBLE) / 17.52::DOUBLE ELSE 10.5402377416545::DOUBLE * {x} + 0.0729055341958355::DOUBLE END",
    ),
    "t12_pq": (
        "PQ (ST.2084)",
        "pow((0.8359375::DOUBLE + 18.8515625::DOUBLE * pow(greatest({x}, 0), 0.1593017578125::DOUBLE)) / (1 + 18.6875::DOUBLE * pow(greatest({x}, 0), 0.1593017578125::DOUBLE)), 78.84375::DOUBLE)",
    ),
    "t13_hlg": (
        "HLG (BT.2100)",
        "CASE WHEN greatest({x}, 0) < 1.0::DOUBLE / 12 THEN sqrt(3 * greatest({x}, 0)) ELSE 0.17883277::DOUBLE * ln(12 * {x} - 0.28466892::DOUBLE) + 0.55991073::DOUBLE END",
    ),
    "t14_davinci": (
        "DaVinci Intermediate",
        "CASE WHEN {x} <= 0.00262409::DOUBLE THEN 10.44426855::DOUBLE * {x} ELSE 0.07329248::DOUBLE * (log2({x} + 0.0075::DOUBLE) + 7) END",
    ),
    "t15_gamma24": ("Gamma 2.4", "pow(greatest({x}, 0), 1.0::DOUBLE / 2.4::DOUBLE)"),
}
SRGB_SQL = "CASE WHEN {x} <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * {x} ELSE 1.055::DOUBLE * pow(greatest({x}, 0), 1.0::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE END"
# pixels shifted so that negative and above-one values occur too
WIDE = f"(SELECT clip_id, frame_id, x, r * 1.5::DOUBLE - 0.25::DOUBLE AS r, g * 1.5::DOUBLE - 0.25::DOUBLE AS g, b * 1.5::DOUBLE - 0.25::DOUBLE AS b FROM {PIXELS})"


def wide_pixels(spark, sf):
    return pixels(spark, sf).withColumns({c: F.col(c) * 1.5 - 0.25 for c in RGB})


for _key, (_name, _sql) in ENCODE_SQL.items():
    # ACES, log and power curves are defined above their own lower bound only
    _src, _bind = (PIXELS, pixels) if _name in ("ACES CCT",) else (WIDE, wide_pixels)

    @query(_key, channels(_sql, _src))
    def _encode(spark, sf, name=_name, bind=_bind):
        return out(curves.encode_table(bind(spark, sf), name))


@query("t16_srgb", channels(SRGB_SQL, WIDE))
def t16(spark, sf):
    p = wide_pixels(spark, sf)
    return out(p.withColumns({c: curves.srgb_display(F.col(c)) for c in RGB}))


# decode curves, on values 0..1 as codes
DECODE_SQL = {
    "Linear": "{x}",
    "Rec.709": "CASE WHEN {x} < 0.0812429::DOUBLE THEN {x} / 4.5::DOUBLE ELSE pow(({x} + 0.099::DOUBLE) / 1.099::DOUBLE, 1.0::DOUBLE / 0.45::DOUBLE) END",
    "S-Log3": "CASE WHEN {x} >= 171.2102946929::DOUBLE / 1023 THEN pow(10.0::DOUBLE, ({x} * 1023 - 420) / 261.5::DOUBLE) * 0.19::DOUBLE - 0.01::DOUBLE ELSE ({x} * 1023 - 95) * 0.01125::DOUBLE / (171.2102946929::DOUBLE - 95) END",
    "V-Log": "CASE WHEN {x} < 0.181::DOUBLE THEN ({x} - 0.125::DOUBLE) / 5.6::DOUBLE ELSE pow(10.0::DOUBLE, ({x} - 0.598206::DOUBLE) / 0.241514::DOUBLE) - 0.00873::DOUBLE END",
    "ARRI LogC3": "CASE WHEN {x} >= 5.367655::DOUBLE * 0.010591::DOUBLE + 0.092809::DOUBLE THEN (pow(10.0::DOUBLE, ({x} - 0.385537::DOUBLE) / 0.247190::DOUBLE) - 0.052272::DOUBLE) / 5.555556::DOUBLE ELSE ({x} - 0.092809::DOUBLE) / 5.367655::DOUBLE END",
    "ARRI LogC4": "CASE WHEN {x} >= 0 THEN (pow(2.0::DOUBLE, 14 * (({x} - %(c)s) / %(b)s) + 6) - 64) / %(a)s ELSE {x} * %(s)s + %(t)s END" % {k: v.format(**LOGC4) for k, v in LOGC4.items()},
    "C-Log3": "CASE WHEN {x} < 0.097465473::DOUBLE THEN (pow(10.0::DOUBLE, -({x} - 0.12783901::DOUBLE) / 0.36726845::DOUBLE) - 1) / -14.98325::DOUBLE WHEN {x} <= 0.15277891::DOUBLE THEN ({x} - 0.12512219::DOUBLE) / 1.9754798::DOUBLE ELSE (pow(10.0::DOUBLE, ({x} - 0.12240537::DOUBLE) / 0.36726845::DOUBLE) - 1) / 14.98325::DOUBLE END",
    "F-Log2": "CASE WHEN {x} >= 8.799461::DOUBLE * 0.000889::DOUBLE + 0.092864::DOUBLE THEN (pow(10.0::DOUBLE, ({x} - 0.384316::DOUBLE) / 0.245281::DOUBLE) - 0.064829::DOUBLE) / 5.555556::DOUBLE ELSE ({x} - 0.092864::DOUBLE) / 8.799461::DOUBLE END",
    "Apple Log": "CASE WHEN {x} <= 0 THEN -0.05641088::DOUBLE WHEN {x} < 47.28711236::DOUBLE * pow(0.01::DOUBLE + 0.05641088::DOUBLE, 2) THEN sqrt({x} / 47.28711236::DOUBLE) - 0.05641088::DOUBLE ELSE pow(2.0::DOUBLE, ({x} - 0.69336945::DOUBLE) / 0.08550479::DOUBLE) - 0.00964052::DOUBLE END",
    "ACES CCT": "CASE WHEN {x} > 10.5402377416545::DOUBLE * 0.0078125::DOUBLE + 0.0729055341958355::DOUBLE THEN pow(2.0::DOUBLE, {x} * 17.52::DOUBLE - 9.72::DOUBLE) ELSE ({x} - 0.0729055341958355::DOUBLE) / 10.5402377416545::DOUBLE END",
    "PQ (ST.2084)": "pow(greatest(pow(greatest({x}, 0), 1 / 78.84375::DOUBLE) - 0.8359375::DOUBLE, 0) / (18.8515625::DOUBLE - 18.6875::DOUBLE * pow(greatest({x}, 0), 1 / 78.84375::DOUBLE)), 1 / 0.1593017578125::DOUBLE)",
    "HLG (BT.2100)": "CASE WHEN {x} <= 0.5::DOUBLE THEN {x} * {x} / 3 ELSE (exp(({x} - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END",
    "DaVinci Intermediate": "CASE WHEN {x} <= 0.00262409::DOUBLE * 10.44426855::DOUBLE THEN {x} / 10.44426855::DOUBLE ELSE pow(2.0::DOUBLE, {x} / 0.07329248::DOUBLE - 7) - 0.0075::DOUBLE END",
    "Gamma 2.4": "pow(greatest({x}, 0), 2.4::DOUBLE)",
}
# the red channel through every decode curve, capped so that large values keep six digits
DECODE_KEYS = {name: f"d{i}" for i, name in enumerate(DECODE_SQL)}


@query(
    "t_decode_all",
    "SELECT frame_id, x, channel, "
    + ", ".join(f"{micro_sql('least(100.0, ' + sql.replace('{x}', 'v') + ')')} AS {DECODE_KEYS[n]}" for n, sql in DECODE_SQL.items())
    + f" FROM {VALUES}",
)
def t_decode_all(spark, sf):
    cols = [micro(F.least(F.lit(100.0), curves.DECODE[n](F.col("v")))).alias(k) for n, k in DECODE_KEYS.items()]
    return values(spark, sf).select("frame_id", "x", "channel", *cols)


CLIP_CURVE = [n for n, _ in vocab.TRANSFER]
BY_PARAMS = "CASE s.s_suppkey % 15 " + " ".join(
    f"WHEN {CLIP_CURVE.index(name)} THEN {sql}" for name, sql in ENCODE_SQL.values() if name != "Linear"
) + " ELSE {x} END"


@query(
    "t_encode_by_clip",
    channels(BY_PARAMS, f"{PIXELS} p JOIN supplier s ON s.s_suppkey = p.clip_id", "frame_id, x"),
)
def t_encode_by_clip(spark, sf):
    params = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("clip_id"),
        F.get(F.array(*[F.lit(n) for n in CLIP_CURVE]), (F.col("s_suppkey") % 15).cast("int")).alias("transfer"),
    )
    return out(curves.encode_by_params(pixels(spark, sf), params, spread=["frame_id", "x"]))


PREVIEW_SQL = {
    "s": ("S-Log3", "CASE WHEN {x} >= 0.01::DOUBLE THEN 0.432699::DOUBLE * log10(10 * {x} + 1) + 0.037584::DOUBLE ELSE ({x} * 261.5::DOUBLE + 10.23::DOUBLE) / 1023 END"),
    "p": ("PQ (ST.2084)", "greatest(0, 0.8359375::DOUBLE + 18.8515625::DOUBLE * pow(greatest({x}, 0), 0.1593017578125::DOUBLE)) / pow(greatest(1 + 18.6875::DOUBLE * pow(greatest({x}, 0), 0.1593017578125::DOUBLE), 1e-10::DOUBLE), 78.84375::DOUBLE)"),
    "h": ("HLG (BT.2100)", "CASE WHEN {x} < 1.0::DOUBLE / 12 THEN sqrt(3 * greatest({x}, 0)) ELSE 0.17883277::DOUBLE * ln(greatest(12 * {x} - 0.28466892::DOUBLE, 1e-10::DOUBLE)) + 0.55991073::DOUBLE END"),
}
PREVIEW_BACK = {
    "sd": ("S-Log3", "CASE WHEN {x} >= (0.01::DOUBLE * 261.5::DOUBLE + 10.23::DOUBLE) / 1023 THEN (pow(10.0::DOUBLE, ({x} - 0.037584::DOUBLE) / 0.432699::DOUBLE) - 1) / 10 ELSE ({x} * 1023 - 10.23::DOUBLE) / 261.5::DOUBLE END"),
    "hd": ("HLG (BT.2100)", "CASE WHEN {x} <= sqrt(0.25::DOUBLE) THEN {x} * {x} / 3 ELSE exp(({x} - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE / 12 END"),
}


@query(
    "t_preview_curves",
    "SELECT frame_id, x, channel, "
    + ", ".join(f"{micro_sql(sql.replace('{x}', 'v'))} AS {k}" for k, (_, sql) in {**PREVIEW_SQL, **PREVIEW_BACK}.items())
    + f" FROM {VALUES}",
)
def t_preview_curves(spark, sf):
    enc = [micro(curves.PREVIEW_ENCODE[n](F.col("v"))).alias(k) for k, (n, _) in PREVIEW_SQL.items()]
    dec = [micro(curves.PREVIEW_DECODE[n](F.col("v"))).alias(k) for k, (n, _) in PREVIEW_BACK.items()]
    return values(spark, sf).select("frame_id", "x", "channel", *enc, *dec)


# tone-map curve set (values in 0..1); NaN or null gives -1
TONE_SQL = {
    "Linear": ("{x}", "{x}"),
    "AcesCct": (
        "CASE WHEN {x} <= 0.0078125::DOUBLE THEN {x} * 10.5402377416545::DOUBLE + 0.077415122655251::DOUBLE ELSE log2({x} / 2) / 17.52::DOUBLE + 0.413588402493492::DOUBLE END",
        "CASE WHEN {x} <= 0.155251141552511::DOUBLE THEN ({x} - 0.077415122655251::DOUBLE) / 10.5402377416545::DOUBLE ELSE pow(2.0::DOUBLE, ({x} - 0.413588402493492::DOUBLE) * 17.52::DOUBLE) END",
    ),
    "ArriLogC3": (
        "CASE WHEN {x} <= 0.005228::DOUBLE THEN {x} * 0.047491::DOUBLE + 0.005228::DOUBLE ELSE 0.247190::DOUBLE * log2({x} / 0.18::DOUBLE) + 0.385537::DOUBLE END",
        "CASE WHEN {x} <= 0.010591::DOUBLE THEN ({x} - 0.005228::DOUBLE) / 0.047491::DOUBLE ELSE 0.18::DOUBLE * pow(2.0::DOUBLE, ({x} - 0.385537::DOUBLE) / 0.247190::DOUBLE) END",
    ),
    "RedLog3G10": (
        "log10({x} * 9.999::DOUBLE + 0.001::DOUBLE) / 17.52::DOUBLE + 14",
        "(pow(10.0::DOUBLE, {x} * 17.52::DOUBLE - 14) - 0.001::DOUBLE) / 9.999::DOUBLE",
    ),
    "SonySLog3": (
        "0.24::DOUBLE * CASE WHEN {x} = 0 THEN -1e300::DOUBLE ELSE log10({x} / 0.18::DOUBLE) END + 0.42::DOUBLE",
        "CASE WHEN {x} < 0.01125::DOUBLE THEN ({x} - 0.030001222851889::DOUBLE) / 0.01125::DOUBLE ELSE pow(10.0::DOUBLE, ({x} - 0.42::DOUBLE) / 0.24::DOUBLE) * 0.18::DOUBLE END",
    ),
    "SonySLog2": (
        "0.235443::DOUBLE * CASE WHEN {x} = 0 THEN -1e300::DOUBLE ELSE log10({x} / 0.18::DOUBLE) END + 0.384410::DOUBLE",
        "CASE WHEN {x} < 0.01018::DOUBLE THEN ({x} - 0.0245786::DOUBLE) / 0.0183089::DOUBLE ELSE pow(10.0::DOUBLE, ({x} - 0.384410::DOUBLE) / 0.235443::DOUBLE) * 0.18::DOUBLE END",
    ),
    "CanonLog3": (
        "CASE WHEN {x} < 0.00390625::DOUBLE THEN {x} * 3.5766::DOUBLE + 0.0721::DOUBLE ELSE 0.301940::DOUBLE * log10({x} / 0.18::DOUBLE) + 0.406539::DOUBLE END",
        "CASE WHEN {x} < 0.0149::DOUBLE THEN ({x} - 0.0721::DOUBLE) / 3.5766::DOUBLE ELSE 0.18::DOUBLE * pow(10.0::DOUBLE, ({x} - 0.406539::DOUBLE) / 0.301940::DOUBLE) END",
    ),
    "CanonLog2": (
        "CASE WHEN {x} < 0.00390625::DOUBLE THEN {x} * 2.4397::DOUBLE + 0.078516::DOUBLE ELSE 0.283691::DOUBLE * log10({x} / 0.18::DOUBLE) + 0.419398::DOUBLE END",
        "CASE WHEN {x} < 0.0205::DOUBLE THEN ({x} - 0.078516::DOUBLE) / 2.4397::DOUBLE ELSE 0.18::DOUBLE * pow(10.0::DOUBLE, ({x} - 0.419398::DOUBLE) / 0.283691::DOUBLE) END",
    ),
    "FilmlightTLog": (
        "CASE WHEN {x} <= 0 THEN 0 ELSE 1 + ln({x} * (pow(10.0::DOUBLE, 0.002::DOUBLE) - 1) + 1) / ln(1 / (pow(10.0::DOUBLE, 0.002::DOUBLE) - 1) + 1) END",
        "CASE WHEN {x} <= 0 THEN 0 ELSE pow(1 / (pow(10.0::DOUBLE, 0.002::DOUBLE) - 1) + 1, {x} - 1) - 1 / (pow(10.0::DOUBLE, 0.002::DOUBLE) - 1) END",
    ),
    "AgxLogKraken": (
        "CASE WHEN {x} <= 0 THEN 0 ELSE (least(6.5::DOUBLE, greatest(-10, log2(greatest({x}, 1e-300::DOUBLE) / 0.18::DOUBLE))) + 10) / 16.5::DOUBLE END",
        "0.18::DOUBLE * pow(2.0::DOUBLE, {x} * 16.5::DOUBLE - 10)",
    ),
    "VLog": (
        "CASE WHEN {x} <= 0.005255::DOUBLE THEN {x} * 0.047120::DOUBLE + 0.005255::DOUBLE ELSE 0.244949::DOUBLE * log2({x} / 0.18::DOUBLE) + 0.389583::DOUBLE END",
        "CASE WHEN {x} <= 0.010592::DOUBLE THEN ({x} - 0.005255::DOUBLE) / 0.047120::DOUBLE ELSE 0.18::DOUBLE * pow(2.0::DOUBLE, ({x} - 0.389583::DOUBLE) / 0.244949::DOUBLE) END",
    ),
    "FLog2": ("0.86445045::DOUBLE * pow({x} + 0.4174028::DOUBLE, 0.13967949::DOUBLE) + 0.5779536::DOUBLE", None),
    "AppleLog2": (None, "1 / (1 + exp(-4 * {x}))"),
    "DaVinciIntermediate": (
        "CASE WHEN {x} < 0.25::DOUBLE THEN sqrt({x}) / 2 ELSE 0.5::DOUBLE + 0.693147::DOUBLE * exp({x} - 1) END", None,
    ),
    "BmFilmGen5": ("CASE WHEN {x} < 0.5::DOUBLE THEN {x} / 4 ELSE 0.5::DOUBLE + 0.693147::DOUBLE * exp({x} - 1) END", None),
    "HLG": (
        "CASE WHEN {x} <= 0.5::DOUBLE THEN sqrt({x}) / 2 ELSE (1.09929682680944::DOUBLE - 1) * pow({x}, 0.5::DOUBLE) + 1 - (1.09929682680944::DOUBLE - 1) END",
        "CASE WHEN {x} <= 0.5::DOUBLE THEN {x} * {x} * 4 ELSE pow(({x} + (1.09929682680944::DOUBLE - 1) - 1) / (1.09929682680944::DOUBLE - 1), 2.0::DOUBLE) END",
    ),
}
TONE_COLS = [
    (f"{d}{i}", n, d, sql)
    for i, (n, pair) in enumerate(TONE_SQL.items())
    for d, sql in zip("ed", pair)
    if sql is not None
]


def _guard_sql(e: str) -> str:
    return micro_sql(f"least(1000.0, greatest(-1000.0, {e}))")


@query(
    "t17_tonemap_curves",
    "SELECT frame_id, x, channel, " + ", ".join(f"{_guard_sql(sql.replace('{x}', 'v'))} AS {k}" for k, _, _, sql in TONE_COLS) + f" FROM {VALUES}",
)
def t17(spark, sf):
    tables = {"e": tonemap.TONE_ENCODE, "d": tonemap.TONE_DECODE}
    cols = [micro(numeric.clamp(tables[d][n](F.col("v")), -1000.0, 1000.0)).alias(k) for k, n, d, _ in TONE_COLS]
    return values(spark, sf).select("frame_id", "x", "channel", *cols)


def u16_sql(e: str) -> str:
    return f"CAST(floor(greatest(0, least(1, {e})) * 65535.0::DOUBLE) AS INTEGER)"


@query("c33_u16", channels("{x}", WIDE, quant=u16_sql))
def c33(spark, sf):
    return develop.quantised(wide_pixels(spark, sf)).select("frame_id", "x", *RGB)


@query("p10_pack", channels(ENCODE_SQL["t3_slog3"][1], WIDE, quant=u16_sql))
def p10(spark, sf):
    return develop.packed(wide_pixels(spark, sf), "S-Log3").select("frame_id", "x", *RGB)


LEVEL = "greatest(0, least(1, ({x} * 16383.0::DOUBLE - {bl}) * (1.0::DOUBLE / ({wl} - {bl}))))"


@query("p1_normalise", channels(LEVEL.replace("{bl}", "1024.0::DOUBLE").replace("{wl}", "16383.0::DOUBLE")))
def p1(spark, sf):
    p = pixels(spark, sf).withColumns({c: F.col(c) * 16383.0 for c in RGB})
    return out(develop.normalise(p, F.lit(1024.0), F.lit(16383.0)))


P2_SQL = "SELECT frame_id, x, " + ", ".join(
    f"{micro_sql(LEVEL.replace('{x}', c).replace('{bl}', f'(p.{k})').replace('{wl}', 'p.wl'))} AS {c}"
    for c, k in zip(RGB, ("br", "bg", "bb"))
) + f" FROM (SELECT *, 64.0::DOUBLE + clip_id AS br, 100.0::DOUBLE + clip_id AS bg, 80.0::DOUBLE AS bb, 4095.0::DOUBLE + clip_id * 10 AS wl FROM {PIXELS}) p"


@query("p2_normalise_channels", P2_SQL)
def p2(spark, sf):
    p = pixels(spark, sf).withColumns({c: F.col(c) * 16383.0 for c in RGB})
    k = F.col("clip_id").cast("double")
    return out(develop.normalise_channels(p, [k + 64.0, k + 100.0, F.lit(80.0)], k * 10.0 + 4095.0))


# a matrix and gains per clip, from the supplier table
PARAMS = (
    "(SELECT s_suppkey AS clip_id, 1.0::DOUBLE + (s_suppkey % 7) * 0.2::DOUBLE AS gr, 1.0::DOUBLE + (s_suppkey % 5) * 0.3::DOUBLE AS gb, "
    "[1.2::DOUBLE, -0.1::DOUBLE, -0.1::DOUBLE, 0.05::DOUBLE * (s_suppkey % 3), 0.9::DOUBLE, 0.05::DOUBLE, -0.02::DOUBLE, -0.2::DOUBLE, 1.3::DOUBLE] AS m FROM supplier)"
)


def colour_params(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    cells = [1.2, -0.1, -0.1, None, 0.9, 0.05, -0.02, -0.2, 1.3]
    matrix = F.array(*[F.lit(v) if v is not None else (k % 3).cast("double") * 0.05 for v in cells])
    return s.select(
        k.alias("clip_id"),
        ((k % 7).cast("double") * 0.2 + 1.0).alias("gain_r"),
        ((k % 5).cast("double") * 0.3 + 1.0).alias("gain_b"),
        matrix.alias("fused"),
    )


def with_colour_params(spark, sf, bind=pixels):
    return develop.with_params(bind(spark, sf), colour_params(spark, sf), spread=("frame_id", "x"))


JOINED = f"(SELECT p.*, q.gr, q.gb, q.m FROM {WIDE} p JOIN {PARAMS} q USING (clip_id))"


@query(
    "j3_pixel_params",
    "SELECT frame_id, x, " + ", ".join(f"{micro_sql(f'r * m[{3 * i + 1}] + g * m[{3 * i + 2}] + b * m[{3 * i + 3}]')} AS {c}" for i, c in enumerate(RGB)) + f" FROM {JOINED}",
)
def j3(spark, sf):
    p = with_colour_params(spark, sf, wide_pixels)
    rgb = develop.dot_rows("fused", list(RGB))
    return out(p.withColumns(dict(zip(RGB, rgb))))


def _matrix_step(src: str, a="r1", b="g1", c="b1") -> str:
    return ", ".join(f"greatest(0, m[{3 * i + 1}] * {a} + m[{3 * i + 2}] * {b} + m[{3 * i + 3}] * {c}) AS o{i}" for i in range(3))


P8_SQL = f"""
WITH w AS (SELECT *, r * gr AS rw, b * gb AS bw FROM {JOINED}),
t AS (SELECT *, greatest(rw, g, bw) AS mx FROM w),
h AS (SELECT *, CASE WHEN mx > 0.95::DOUBLE THEN least((mx - 0.95::DOUBLE) / 0.05::DOUBLE, 1) ELSE 0 END AS k, least(mx, 1) AS n FROM t),
d AS (SELECT *, rw + (n - rw) * k AS r1, g + (n - g) * k AS g1, bw + (n - bw) * k AS b1 FROM h),
o AS (SELECT frame_id, x, {_matrix_step('d')} FROM d)
SELECT frame_id, x, {', '.join(f"{micro_sql(f'o{i}')} AS {c}" for i, c in enumerate(RGB))} FROM o
"""


@query("p8_display_colour", P8_SQL)
def p8(spark, sf):
    p = with_colour_params(spark, sf, wide_pixels)
    return out(develop.display_colour(p, F.col("gain_r"), F.col("gain_b"), "fused"))


P9_SQL = f"""
WITH w AS (SELECT *, r * gr AS r1, g AS g1, b * gb AS b1 FROM {JOINED}),
o AS (SELECT frame_id, x, {_matrix_step('w')} FROM w),
l AS (SELECT *, greatest(o0, o1, o2) AS mx, 0.2126::DOUBLE * o0 + 0.7152::DOUBLE * o1 + 0.0722::DOUBLE * o2 AS y FROM o),
s AS (SELECT *, greatest(0, least(y, mx)) AS ly, CASE WHEN mx > 1 THEN least(mx - 1, 1) ELSE 0 END AS k FROM l)
SELECT frame_id, x, {', '.join(f"{micro_sql(f'o{i} + (ly - o{i}) * k')} AS {c}" for i, c in enumerate(RGB))} FROM s
"""


@query("p9_log_colour", P9_SQL)
def p9(spark, sf):
    p = with_colour_params(spark, sf, wide_pixels)
    return out(develop.log_colour(p, F.col("gain_r"), F.col("gain_b"), "fused"))


@query(
    "p12_highlight_clip",
    f"WITH m AS (SELECT *, greatest(r, g, b) AS mx FROM {WIDE}), t AS (SELECT *, CASE WHEN mx > 0.8::DOUBLE THEN least((mx - 0.8::DOUBLE) / (1.0::DOUBLE - 0.8::DOUBLE), 1) ELSE 0 END AS k FROM m) "
    "SELECT frame_id, x, " + ", ".join(f"{micro_sql(f'{c} + (mx - {c}) * k')} AS {c}" for c in RGB) + " FROM t",
)
def p12(spark, sf):
    return out(develop.highlight_clip(wide_pixels(spark, sf), 0.8))


@query("c35_smoothstep", channels("greatest(0, least(1, ({x} - 0.1::DOUBLE) / (0.7::DOUBLE - 0.1::DOUBLE))) * greatest(0, least(1, ({x} - 0.1::DOUBLE) / (0.7::DOUBLE - 0.1::DOUBLE))) * (3 - 2 * greatest(0, least(1, ({x} - 0.1::DOUBLE) / (0.7::DOUBLE - 0.1::DOUBLE))))"))
def c35(spark, sf):
    p = pixels(spark, sf)
    return out(p.withColumns({c: numeric.smoothstep(0.1, 0.7, F.col(c)) for c in RGB}))


SMOOTH = "(greatest(0, least(1, ({v} - {a}) / ({b} - {a}))) ** 2 * (3 - 2 * greatest(0, least(1, ({v} - {a}) / ({b} - {a})))))"
SHADOW_W = "(1 - " + SMOOTH.format(v="y", a="0.0::DOUBLE", b="0.35::DOUBLE") + ")"
HIGH_W = SMOOTH.format(v="y", a="0.5::DOUBLE", b="1.0::DOUBLE")
P13_SQL = f"""
WITH s AS (SELECT *, (clip_id % 5 - 2)::DOUBLE * 0.4::DOUBLE AS ex, 1.0::DOUBLE + (clip_id % 3) * 0.1::DOUBLE AS ct, 1.0::DOUBLE + (clip_id % 4) * 0.2::DOUBLE AS sat,
  (clip_id % 6)::DOUBLE * 0.05::DOUBLE AS sh, (clip_id % 7)::DOUBLE * -0.1::DOUBLE AS hi, clip_id % 2 = 0 AS adj FROM {JOINED}),
e AS (SELECT *, r * pow(2.0::DOUBLE, ex) * gr AS r1, g * pow(2.0::DOUBLE, ex) AS g1, b * pow(2.0::DOUBLE, ex) * gb AS b1 FROM s),
c AS (SELECT *, m[1] * r1 + m[4] * g1 + m[7] * b1 AS r2, m[2] * r1 + m[5] * g1 + m[8] * b1 AS g2, m[3] * r1 + m[6] * g1 + m[9] * b1 AS b2 FROM e),
y AS (SELECT *, 0.2126::DOUBLE * r2 + 0.7152::DOUBLE * g2 + 0.0722::DOUBLE * b2 AS y FROM c),
t AS (SELECT *, {', '.join(f'greatest(0, ({v}2 + sh * {SHADOW_W}) + hi * {HIGH_W} * ({v}2 + sh * {SHADOW_W})) AS {v}3' for v in RGB)} FROM y),
k AS (SELECT *, {', '.join(f'greatest(0, ({v}3 - 0.18::DOUBLE) * ct + 0.18::DOUBLE) AS {v}4' for v in RGB)} FROM t),
l AS (SELECT *, 0.2126::DOUBLE * r4 + 0.7152::DOUBLE * g4 + 0.0722::DOUBLE * b4 AS y4 FROM k)
SELECT frame_id, x, {', '.join(f"{micro_sql(f'CASE WHEN adj THEN y4 + ({v}4 - y4) * sat ELSE {v}2 END')} AS {v}" for v in RGB)} FROM l
"""


@query("p13_grade", P13_SQL)
def p13(spark, sf):
    p = with_colour_params(spark, sf, wide_pixels)
    k = F.col("clip_id")
    graded = preview.grade(
        p,
        {
            "exposure": (k % 5 - 2).cast("double") * 0.4,
            "wb_r": F.col("gain_r"),
            "wb_g": F.lit(1.0),
            "wb_b": F.col("gain_b"),
            "ccm": F.col("fused"),
            "adjust": k % 2 == 0,
            "shadows": (k % 6).cast("double") * 0.05,
            "highlights": (k % 7).cast("double") * -0.1,
            "contrast": (k % 3).cast("double") * 0.1 + 1.0,
            "saturation": (k % 4).cast("double") * 0.2 + 1.0,
        },
    )
    return out(graded)


def _gamut_sql(gamut: str, source: str = WIDE) -> str:
    rows = preview.WORKING_TO_XYZ.get(gamut)
    back = preview.PREVIEW_XYZ_TO_RGB

    def line(m, i, names):
        return " + ".join(f"{_d(m[3 * i + j])} * {n}" for j, n in enumerate(names))

    if rows:
        first = ", ".join(f"{line(rows, i, RGB)} AS {n}" for i, n in enumerate("uvw"))
    else:
        first = ", ".join(f"greatest(0, least(1, {c})) AS {n}" for c, n in zip(RGB, "uvw"))
    last = ", ".join(f"{micro_sql(f'greatest(0, least(1, {line(back, i, chr(117) + chr(118) + chr(119))}))')} AS {c}" for i, c in enumerate(RGB))
    return f"SELECT '{gamut}' AS gamut, frame_id, x, {last} FROM (SELECT frame_id, x, {first} FROM {source})"


P14_GAMUTS = ["ACES AP1", "Apple Wide Gamut", "ARRI Wide Gamut 3", "ARRI Wide Gamut 4", "DaVinci Wide Gamut", "DCI-P3", "Rec.2020", "S-Gamut3"]


@query(
    "p14_gamut_clip",
    " UNION ALL ".join(_gamut_sql(g) for g in P14_GAMUTS)
    + f" UNION ALL SELECT 'Rec.709' AS gamut, frame_id, x, {', '.join(f'{micro_sql(f"greatest(0, least(1, {c}))")} AS {c}' for c in RGB)} FROM {WIDE}",
)
def p14(spark, sf):
    p = wide_pixels(spark, sf)
    parts = [preview.to_srgb(p, g).withColumn("gamut", F.lit(g)) for g in [*P14_GAMUTS, "Rec.709"]]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return out(merged, ("gamut", "frame_id", "x"))


LUMA_SQL = "0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b"
HIST_SQL = " UNION ALL ".join(
    f"SELECT clip_id, '{n}' AS channel, CAST(floor(greatest(0, least(1, {e})) * 63.0::DOUBLE) AS INTEGER) AS bin FROM {WIDE}"
    for n, e in [("luma", LUMA_SQL), *[(c, c) for c in RGB]]
)


@query("a6_histogram", f"SELECT clip_id, channel, bin, count(*) AS n FROM ({HIST_SQL}) GROUP BY ALL")
def a6(spark, sf):
    return preview.histogram(wide_pixels(spark, sf), ("clip_id",))


@query(
    "a6_dense_histogram",
    f"WITH h AS (SELECT clip_id, channel, bin, count(*) AS n FROM ({HIST_SQL}) GROUP BY ALL), k AS (SELECT DISTINCT clip_id FROM h) "
    "SELECT k.clip_id, c.channel, b.bin::INTEGER AS bin, coalesce(h.n, 0) AS n FROM k, (SELECT unnest(['luma', 'r', 'g', 'b']) AS channel) c, "
    "(SELECT range AS bin FROM range(64)) b LEFT JOIN h ON h.clip_id = k.clip_id AND h.channel = c.channel AND h.bin = b.bin",
)
def a6_dense(spark, sf):
    return preview.dense_histogram(preview.histogram(wide_pixels(spark, sf), ("clip_id",)), ("clip_id",))


# The three matrices come out of M10; SQL takes them as values computed by hand-written formulas
def tone_sql(config: tonemap.ToneConfig) -> str:
    """SQL of a display run; its matrices are worked out in the same statement."""
    from rawlake.queries.params import tone_matrices_sql

    c = config
    mid, k = _d(c.working_mid_grey), _d(c.slope)

    def spow(a: str, p: str) -> str:
        return f"(sign({a}) * pow(abs({a}), {p}))"

    up = f"pow((pow({k} * (1 - {mid}) / 0.5::DOUBLE, {_d(c.shoulder_power)}) - 1) * pow({k} * (1 - {mid}), {_d(-c.shoulder_power)}), {_d(-1 / c.shoulder_power)})"
    down = f"pow((pow({k} * {mid} / 0.5::DOUBLE, {_d(c.toe_power)}) - 1) * pow({k} * {mid}, {_d(-c.toe_power)}), {_d(-1 / c.toe_power)})"
    high, low = f"({k} * (v - {mid}) / {up})", f"({k} * (v - {mid}) / -{down})"
    fs = f"({high} / {spow(f'(1 + {spow(high, _d(c.shoulder_power))})', _d(1 / c.shoulder_power))})"
    ft = f"({low} / {spow(f'(1 + {spow(low, _d(c.toe_power))})', _d(1 / c.toe_power))})"
    curve = f"CASE WHEN v >= {mid} THEN {up} * {fs} + 0.5::DOUBLE ELSE -{down} * {ft} + 0.5::DOUBLE END"
    encode = TONE_SQL["AgxLogKraken"][0]

    def rows(m: str, src: str, dst: str) -> str:
        return ", ".join(f"{m}[{j + 1}] * {src}0 + {m}[{j + 4}] * {src}1 + {m}[{j + 7}] * {src}2 AS {dst}{j}" for j in range(3))

    return f"""
WITH mats AS ({tone_matrices_sql(c)}),
s0 AS (SELECT frame_id, x, greatest(r, 0) AS a0, greatest(g, 0) AS a1, greatest(b, 0) AS a2, mats.* FROM {WIDE}, mats),
s1 AS (SELECT *, {rows('inset_mat', 'a', 'b')} FROM s0),
s2 AS (SELECT *, {', '.join(f"{encode.replace('{x}', f'b{j}')} AS c{j}" for j in range(3))} FROM s1),
s3 AS (SELECT *, {', '.join(f"pow({curve.replace('(v -', f'(c{j} -').replace('WHEN v', f'WHEN c{j}')}, 2.2::DOUBLE) AS d{j}" for j in range(3))} FROM s2),
s4 AS (SELECT *, (d0 + d1 + d2) * (1.0::DOUBLE / 3) AS lum, greatest(d0, d1, d2) AS mx FROM s3),
s5 AS (SELECT *, {', '.join(f"CASE WHEN mx > 0.85::DOUBLE THEN d{j} + (lum - d{j}) * least((mx - 0.85::DOUBLE) / 0.15::DOUBLE, 1) ELSE d{j} END AS e{j}" for j in range(3))} FROM s4),
s6 AS (SELECT *, {rows('outset_mat', 'e', 'f')} FROM s5),
s7 AS (SELECT *, {rows('gamut_mat', 'f', 'g')} FROM s6)
SELECT frame_id, x, {', '.join(f"{micro_sql(f'CASE WHEN isnan(g{j}) OR g{j} <= 0 THEN 0 ELSE pow(g{j}, {_d(1 / c.out_gamma)}) END')} AS {n}" for j, n in enumerate(RGB))} FROM s7
"""


P17_CONFIG = tonemap.ToneConfig(in_gamut="Rec2020", out_gamut="Rec709", out_gamma=2.4, rotate=(2.0, -1.0, 3.0), outset=(0.1, 0.05, 0.1))


@query("p17_tonemap", tone_sql(P17_CONFIG))
def p17(spark, sf):
    p = spread(wide_pixels(spark, sf), "frame_id", "x")
    return out(tonemap.tonemap(p, P17_CONFIG))
