"""Optional tone mapping.

Its curves share names with the export curves but have other constants, so they
are kept apart. Undefined values (a power or logarithm of a negative number)
come out as NaN or null, as they do in plain floating point.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import matrix as mx
from rawlake.functions.curves import DECODE, ENCODE
from rawlake.functions.numeric import clamp
from rawlake.session import small_table

RGB = ("r", "g", "b")


def _pow(a: Column | float, b: Column | float) -> Column:
    return F.pow(F.lit(a), F.lit(b))


def _log(x: Column, base: float | None = None) -> Column:
    """Logarithm that gives NaN instead of null below zero and -inf at zero."""
    bad = F.when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    value = F.log(x) if base is None else F.log(x) / F.lit(math.log(base))
    return F.when(x > 0, value).otherwise(bad)


def _floored(value: Column, x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(value)


# ---------------------------------------------------------------------------
# Constants of the tone-map curve set.
# ---------------------------------------------------------------------------
FLOG2_A, FLOG2_B, FLOG2_C, FLOG2_D = 0.86445045, 0.5779536, 0.13967949, 0.4174028
HLG_BETA = 1.09929682680944 - 1.0
TLOG_A = 1.0 / (10.0**0.002 - 1.0)
PQ_ROOT = 10000.0 ** (1.0 / 2.4)
PQ_M = (PQ_ROOT - 1.0) / PQ_ROOT
KRAKEN_LOW, KRAKEN_HIGH, KRAKEN_RANGE = -10.0, 6.5, 16.5
LN2 = 0.693147


def _cbrt(x: Column) -> Column:
    return F.cbrt(x)


def _late_log(x: Column) -> Column:
    return _log(x - 0.5) / LN2 + 1.0


def _late_exp(x: Column) -> Column:
    return F.exp(x - 1.0) * LN2 + 0.5


def _same(x: Column) -> Column:
    return x


TONE_DECODE = {
    "Linear": _same,
    "AcesCct": lambda x: F.when(x <= 0.155251141552511, (x - 0.077415122655251) / 10.5402377416545).otherwise(
        _pow(2.0, (x - 0.413588402493492) * 17.52)
    ),
    "ArriLogC3": lambda x: F.when(x <= 0.010591, (x - 0.005228) / 0.047491).otherwise(
        _pow(2.0, (x - 0.385537) / 0.247190) * 0.18
    ),
    "ArriLogC4": DECODE["ARRI LogC4"],
    "RedLog3G10": lambda x: _floored((_pow(10.0, x * 17.52 - 14.0) - 0.001) / 9.999, x),
    "SonySLog3": lambda x: F.when(x < 0.01125, (x - 0.030001222851889) / 0.01125).otherwise(
        _pow(10.0, (x - 0.42) / 0.24) * 0.18
    ),
    "SonySLog2": lambda x: F.when(x < 0.01018, (x - 0.0245786) / 0.0183089).otherwise(
        _pow(10.0, (x - 0.384410) / 0.235443) * 0.18
    ),
    "BmFilmGen5": lambda x: F.when(x < 0.125, x * 4.0).otherwise(_late_log(x)),
    "CanonLog3": lambda x: F.when(x < 0.0149, (x - 0.0721) / 3.5766).otherwise(
        _pow(10.0, (x - 0.406539) / 0.301940) * 0.18
    ),
    "CanonLog2": lambda x: F.when(x < 0.0205, (x - 0.078516) / 2.4397).otherwise(
        _pow(10.0, (x - 0.419398) / 0.283691) * 0.18
    ),
    "DaVinciIntermediate": lambda x: _floored(F.when(x < 0.5, x * x * 4.0).otherwise(_late_log(x)), x),
    "FilmlightTLog": lambda x: F.when(x <= 0, F.lit(0.0)).otherwise(_pow(TLOG_A + 1.0, x - 1.0) - TLOG_A),
    "AgxLogKraken": lambda x: _pow(2.0, x * KRAKEN_RANGE + KRAKEN_LOW) * 0.18,
    "VLog": lambda x: F.when(x <= 0.010592, (x - 0.005255) / 0.047120).otherwise(
        _pow(2.0, (x - 0.389583) / 0.244949) * 0.18
    ),
    "FLog2": lambda x: _floored(_pow((x - FLOG2_B) / FLOG2_A, 1.0 / FLOG2_C) - FLOG2_D, x),
    "FLog2C": lambda x: _floored(_pow((x - FLOG2_B) / FLOG2_A, 1.0 / FLOG2_C) - FLOG2_D, x),
    "AppleLog2": lambda x: _floored(F.lit(1.0) / (F.exp(x * -4.0) + 1.0), x),
    "HLG": lambda x: F.when(x <= 0.5, x * x * 4.0).otherwise(_pow((x + HLG_BETA - 1.0) / HLG_BETA, 2.0)),
    "PQ": lambda x: _floored(_pow((_cbrt(x) - PQ_M) / (1.0 - PQ_M), 2.4), x),
    "DNG": _same,
    "DI": _same,
}

TONE_ENCODE = {
    "Linear": _same,
    "AcesCct": lambda x: F.when(x <= 0.0078125, x * 10.5402377416545 + 0.077415122655251).otherwise(
        _log(x / 2.0, 2.0) / 17.52 + 0.413588402493492
    ),
    "ArriLogC3": lambda x: F.when(x <= 0.005228, x * 0.047491 + 0.005228).otherwise(
        _log(x / 0.18, 2.0) * 0.247190 + 0.385537
    ),
    "ArriLogC4": ENCODE["ARRI LogC4"],
    "RedLog3G10": lambda x: _floored(_log(x * 9.999 + 0.001, 10.0) / 17.52 + 14.0, x),
    "SonySLog3": lambda x: F.when(x < 0, F.lit(0.030001222851889)).otherwise(_log(x / 0.18, 10.0) * 0.24 + 0.42),
    "SonySLog2": lambda x: F.when(x < 0, F.lit(0.0245786)).otherwise(_log(x / 0.18, 10.0) * 0.235443 + 0.384410),
    "BmFilmGen5": lambda x: F.when(x < 0.5, x / 4.0).otherwise(_late_exp(x)),
    "CanonLog3": lambda x: F.when(x < 0.00390625, x * 3.5766 + 0.0721).otherwise(
        _log(x / 0.18, 10.0) * 0.301940 + 0.406539
    ),
    "CanonLog2": lambda x: F.when(x < 0.00390625, x * 2.4397 + 0.078516).otherwise(
        _log(x / 0.18, 10.0) * 0.283691 + 0.419398
    ),
    "DaVinciIntermediate": lambda x: _floored(F.when(x < 0.25, F.sqrt(x) / 2.0).otherwise(_late_exp(x)), x),
    "FilmlightTLog": lambda x: F.when(x <= 0, F.lit(0.0)).otherwise(
        _log(x / TLOG_A + 1.0) / math.log(TLOG_A + 1.0) + 1.0
    ),
    "AgxLogKraken": lambda x: F.when(x <= 0, F.lit(0.0)).otherwise(
        (clamp(_log(x / 0.18, 2.0), KRAKEN_LOW, KRAKEN_HIGH) - KRAKEN_LOW) / KRAKEN_RANGE
    ),
    "VLog": lambda x: F.when(x <= 0.005255, x * 0.047120 + 0.005255).otherwise(
        _log(x / 0.18, 2.0) * 0.244949 + 0.389583
    ),
    "FLog2": lambda x: _floored(_pow(x + FLOG2_D, FLOG2_C) * FLOG2_A + FLOG2_B, x),
    "FLog2C": lambda x: _floored(_pow(x + FLOG2_D, FLOG2_C) * FLOG2_A + FLOG2_B, x),
    "AppleLog2": lambda x: _log(F.when(x == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), x) - 1.0)) / -4.0,
    "HLG": lambda x: _floored(
        F.when(x <= 0.5, F.sqrt(x) / 2.0).otherwise(_pow(x, 0.5) * HLG_BETA + 1.0 - HLG_BETA), x
    ),
    "PQ": lambda x: _floored(F.lit(1.0) - F.abs(_cbrt(F.greatest(x, F.lit(0.0))) * (1.0 - PQ_M) - PQ_M), x),
    "DNG": _same,
    "DI": _same,
}


@dataclass(frozen=True)
class ToneConfig:
    """Settings of one tone-map run; the defaults give display sRGB."""

    inset: tuple[float, float, float] = (0.2, 0.2, 0.2)
    rotate: tuple[float, float, float] = (0.0, 0.0, 0.0)
    outset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    toe_power: float = 3.0
    shoulder_power: float = 3.25
    slope: float = 2.0
    in_gamut: str = "Rec709"
    in_transfer: str = "Linear"
    working_curve: str = "AgxLogKraken"
    working_mid_grey: float = 0.606060
    out_gamut: str = "Rec709"
    out_gamma: float = 2.2
    log_output: bool = False


def _tone_rgb_to_xyz(points: str) -> str:
    """The tone-map path's own matrix: columns of the *inverse* primaries matrix
    are scaled, and vectors are applied as rows. ``points`` holds x, y of the
    three primaries and of the white."""
    p = points
    xs, ys = [f"{p}[{i}]" for i in (0, 2, 4)], [f"{p}[{i}]" for i in (1, 3, 5)]
    zs = [f"1D - {x} - {y}" for x, y in zip(xs, ys)]
    white = mx.white_xyz(f"{p}[6]", f"{p}[7]")
    return mx.let(
        mx.inverse(mx.array([*xs, *ys, *zs])),
        lambda inv: mx.scale_cols(inv, mx.apply(mx.transpose(inv), white)),
    )


def _pulled(p: str, pull: str, turn: str) -> str:
    """Primaries moved toward the white by a share and rotated around it."""
    moved = []
    for i in range(3):
        x, y = f"{p}[{2 * i}]", f"{p}[{2 * i + 1}]"
        dx, dy = f"({x} - {p}[6])", f"({y} - {p}[7])"
        angle, keep = f"({turn}[{i}] * pi() / 180D)", f"(1D - {pull}[{i}])"
        still = f"sqrt({dx} * {dx} + {dy} * {dy}) < 1e-6D"
        moved += [
            f"CASE WHEN {still} THEN {x} ELSE {p}[6] + ({dx} * cos({angle}) - {dy} * sin({angle})) * {keep} END",
            f"CASE WHEN {still} THEN {y} ELSE {p}[7] + ({dx} * sin({angle}) + {dy} * cos({angle})) * {keep} END",
        ]
    return mx.array([*moved, f"{p}[6]", f"{p}[7]"])


def _between(source: str, target: str) -> str:
    to_xyz = mx.let(source, _tone_rgb_to_xyz)
    return mx.product(mx.inverse(mx.let(target, _tone_rgb_to_xyz)), to_xyz)


def tone_params(spark: SparkSession, configs: dict[str, ToneConfig]) -> DataFrame:
    """One row per named config with its three matrices and settings."""
    rows = [
        (n, list(c.inset), list(c.rotate), list(c.outset), c.in_gamut, c.out_gamut) for n, c in configs.items()
    ]
    base = small_table(
        spark, rows, "config string, inset array<double>, rotate array<double>, outset array<double>, "
        "in_gamut string, out_gamut string",
    )
    dim = vocab.dim_tonemap_gamut(spark)
    points = F.array("xr", "yr", "xg", "yg", "xb", "yb", "xw", "yw")
    # 15 rows, fixed
    src = F.broadcast(dim.select(F.col("name").alias("in_gamut"), points.alias("_in")))
    dst = F.broadcast(dim.select(F.col("name").alias("out_gamut"), points.alias("_out")))
    j = base.join(src, "in_gamut").join(dst, "out_gamut")
    return j.select(
        "config",
        F.expr(_between(_pulled("_in", "inset", "rotate"), "_in")).alias("inset_mat"),
        F.expr(_between("_in", _pulled("_in", "outset", "rotate"))).alias("outset_mat"),
        F.expr(_between("_in", "_out")).alias("gamut_mat"),
    )


def _row_times(m: list[float]) -> dict[str, Column]:
    """Row vector of the channels times a matrix."""
    n = [mx.number(v) for v in m]
    return {c: F.expr(f"r * {n[i]} + g * {n[3 + i]} + b * {n[6 + i]}") for i, c in enumerate(RGB)}


def _spow(a: float, b: float) -> float:
    sign = (a > 0) - (a < 0)
    return sign * abs(a) ** b if a else 0.0


def tone_curve(x: str, c: ToneConfig) -> Column:
    """S-curve through the working mid grey with its own toe and shoulder."""
    mid, target, k = c.working_mid_grey, 0.5, c.slope

    def reach(span: float, power: float) -> float:
        return _spow((_spow(k * span / target, power) - 1.0) * _spow(k * span, -power), -1.0 / power)

    def bent(size: float, power: float) -> str:
        v = f"(({x} - {mid}D) * {k}D / {size!r}D)"
        one = f"(signum({v}) * power(abs({v}), {power}D) + 1D)"
        return f"{v} / (signum({one}) * power(abs({one}), {1.0 / power!r}D)) * {size!r}D + {target}D"

    up, down = reach(1.0 - mid, c.shoulder_power), reach(mid, c.toe_power)
    return F.expr(f"CASE WHEN {x} >= {mid}D THEN {bent(up, c.shoulder_power)} ELSE {bent(-down, c.toe_power)} END")


def _nan_max(value: Column, floor: Column) -> Column:
    """Larger of two values; an undefined one loses."""
    return F.greatest(F.nanvl(value, floor), floor)


def tonemap(pixels: DataFrame, config: ToneConfig) -> DataFrame:
    """Tone-mapped display colour (or the working log values)."""
    # one row of 27 numbers, put into the pixel stage as constants
    params = tone_params(pixels.sparkSession, {"run": config}).first()
    decode, encode = TONE_DECODE[config.in_transfer], TONE_ENCODE[config.working_curve]
    p = pixels
    low = decode(F.lit(0.0))
    p = p.withColumns({c: _nan_max(decode(F.col(c)), low) for c in RGB})
    p = p.withColumns(_row_times(params.inset_mat))
    p = p.withColumns({c: encode(F.col(c)) for c in RGB})
    if config.log_output:
        return p
    p = p.withColumns({c: F.pow(tone_curve(c, config), F.lit(2.2)) for c in RGB})
    top = F.greatest(*[F.nanvl(F.col(c), F.lit(float("-inf"))) for c in RGB])
    p = p.withColumns(
        {
            "_m": (F.col("r") + F.col("g") + F.col("b")) * (1.0 / 3.0),
            "_t": F.when(top > 0.85, F.least((top - 0.85) / 0.15, F.lit(1.0))).otherwise(F.lit(0.0)),
        }
    )
    p = p.withColumns({c: F.when(F.col("_t") > 0, F.col(c) + (F.col("_m") - F.col(c)) * F.col("_t")).otherwise(F.col(c)) for c in RGB})
    p = p.withColumns(_row_times(params.outset_mat))
    p = p.withColumns(_row_times(params.gamut_mat))
    if config.out_gamma != 1.0:
        p = p.withColumns({c: F.pow(F.col(c), F.lit(1.0 / config.out_gamma)) for c in RGB})
    p = p.withColumns({c: _nan_max(F.col(c), F.lit(0.0)) for c in RGB})
    return p.drop("_m", "_t")
