"""Transfer curves as whole-column maths (T1-T16) and the curve jobs.

All constants are Python floats turned into double literals, so no decimal
arithmetic can creep in.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake.session import attach

Curve = Callable[[Column], Column]


def _pow(base: Column | float, exponent: Column | float) -> Column:
    return F.pow(F.lit(base), F.lit(exponent))


def _floor0(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def _log10(x: Column) -> Column:
    return F.log10(x)


def _split(cond: Column, yes: Column, no: Column) -> Column:
    return F.when(cond, yes).otherwise(no)


# ---------------------------------------------------------------------------
# Constants of the published curve definitions.
# ---------------------------------------------------------------------------
LOGC4_A = (2.0**18 - 16.0) / 117.45
LOGC4_B = (1023.0 - 95.0) / 1023.0
LOGC4_C = 95.0 / 1023.0
LOGC4_S = 7.0 * math.log(2.0) * 2.0 ** (7.0 - 14.0 * LOGC4_C / LOGC4_B) / (LOGC4_A * LOGC4_B)
LOGC4_T = (2.0 ** (14.0 * (-LOGC4_C / LOGC4_B) + 6.0) - 64.0) / LOGC4_A
CLOG3_SLOPE, CLOG3_MID = 1.9754798, 0.12512219
CLOG3_LOW_CODE, CLOG3_HIGH_CODE = 0.097465473, 0.15277891
CLOG3_LOW = (CLOG3_LOW_CODE - CLOG3_MID) / CLOG3_SLOPE
CLOG3_HIGH = (CLOG3_HIGH_CODE - CLOG3_MID) / CLOG3_SLOPE
APPLE_R0, APPLE_RT, APPLE_C = -0.05641088, 0.01, 47.28711236
APPLE_BETA, APPLE_GAMMA, APPLE_DELTA = 0.00964052, 0.08550479, 0.69336945
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
ACES_SLOPE, ACES_OFFSET, ACES_CUT = 10.5402377416545, 0.0729055341958355, 0.0078125


VLOG_CODE = 0.181
VLOG = {"cut": 0.01, "slope": 5.6, "offset": 0.125, "shift": 0.00873, "scale": 0.241514, "lift": 0.598206}
LOGC3 = {"cut": 0.010591, "a": 5.555556, "b": 0.052272, "scale": 0.247190, "lift": 0.385537, "slope": 5.367655, "offset": 0.092809}
FLOG2 = {"cut": 0.000889, "a": 5.555556, "b": 0.064829, "scale": 0.245281, "lift": 0.384316, "slope": 8.799461, "offset": 0.092864}
DAVINCI = {"cut": 0.00262409, "slope": 10.44426855, "shift": 0.0075, "add": 7.0, "scale": 0.07329248}


class ColumnMath:
    """The functions that curves need, on columns."""

    log, log2, log10, exp, sqrt, pow = F.log, F.log2, F.log10, F.exp, F.sqrt, staticmethod(_pow)
    floor0 = staticmethod(_floor0)

    @staticmethod
    def least(x: Column, top: float) -> Column:
        return F.least(x, F.lit(top))

    @staticmethod
    def most(x: Column, low: float) -> Column:
        return F.greatest(x, F.lit(low))

    @staticmethod
    def pick(x: Column, *cases) -> Column:
        """The value of the first condition that holds; the last case is what is left."""
        out = F.when(F.lit(False), x)
        for cond, value in cases[:-1]:
            out = out.when(cond, F.lit(value))
        return out.otherwise(F.lit(cases[-1]))


class ArrayMath:
    """The same on arrays of one tile; branches that are not picked may be undefined."""

    log, log2, log10, exp, sqrt, pow = np.log, np.log2, np.log10, np.exp, np.sqrt, np.power
    least, most = np.minimum, np.maximum

    @staticmethod
    def floor0(x: np.ndarray) -> np.ndarray:
        return np.maximum(x, 0.0)

    @staticmethod
    def pick(x: np.ndarray, *cases) -> np.ndarray:
        return np.select([c for c, _ in cases[:-1]], [v for _, v in cases[:-1]], cases[-1])


def _rec709(x, m):
    y = m.pick(x, (x < 0.018, x * 4.5), m.pow(m.floor0(x), 0.45) * 1.099 - 0.099)
    return m.floor0(m.least(y, 1.0))


def _slog3(x, m):
    log = (m.log10((x + 0.01) / 0.19) * 261.5 + 420.0) / 1023.0
    return m.pick(x, (x >= 0.01125, log), (x * (171.2102946929 - 95.0) / 0.01125 + 95.0) / 1023.0)


def _vlog(x, m):
    log = m.log10(x + VLOG["shift"]) * VLOG["scale"] + VLOG["lift"]
    return m.pick(x, (x < VLOG["cut"], x * VLOG["slope"] + VLOG["offset"]), log)


def _camera_log(k: dict, closed: bool):
    """A log above a cut, a line below it; ``closed`` if the cut belongs to the log."""

    def curve(x, m):
        log = m.log10(x * k["a"] + k["b"]) * k["scale"] + k["lift"]
        return m.pick(x, (x >= k["cut"] if closed else x > k["cut"], log), x * k["slope"] + k["offset"])

    return curve


def _logc4(x, m):
    log = (m.log2(x * LOGC4_A + 64.0) - 6.0) / 14.0 * LOGC4_B + LOGC4_C
    return m.pick(x, (x >= LOGC4_T, log), (x - LOGC4_T) / LOGC4_S)


def _clog3(x, m):
    low = m.log10(m.most(1.0 - x * 14.98325, 1e-10)) * -0.36726845 + 0.12783901
    high = m.log10(x * 14.98325 + 1.0) * 0.36726845 + 0.12240537
    return m.pick(x, (x < CLOG3_LOW, low), (x <= CLOG3_HIGH, x * CLOG3_SLOPE + CLOG3_MID), high)


def _apple(x, m):
    toe = (x - APPLE_R0) * (x - APPLE_R0) * APPLE_C
    return m.pick(x, (x < APPLE_R0, 0.0), (x < APPLE_RT, toe), m.log2(x + APPLE_BETA) * APPLE_GAMMA + APPLE_DELTA)


def _acescct(x, m):
    return m.pick(x, (x > ACES_CUT, (m.log2(x) + 9.72) / 17.52), x * ACES_SLOPE + ACES_OFFSET)


def _pq(x, m):
    k = m.pow(m.floor0(x), PQ_M1)
    return m.pow((k * PQ_C2 + PQ_C1) / (k * PQ_C3 + 1.0), PQ_M2)


def _hlg(x, m):
    v = m.floor0(x)
    return m.pick(x, (v < 1.0 / 12.0, m.sqrt(v * 3.0)), m.log(v * 12.0 - HLG_B) * HLG_A + HLG_C)


def _davinci(x, m):
    k = DAVINCI
    return m.pick(x, (x <= k["cut"], x * k["slope"]), (m.log2(x + k["shift"]) + k["add"]) * k["scale"])


_CURVES = {
    "Linear": lambda x, m: x,
    "Rec.709": _rec709,
    "S-Log3": _slog3,
    "V-Log": _vlog,
    "ARRI LogC3": _camera_log(LOGC3, False),
    "ARRI LogC4": _logc4,
    "C-Log3": _clog3,
    "F-Log2": _camera_log(FLOG2, True),
    "Apple Log": _apple,
    "Apple Log 2": _apple,
    "ACES CCT": _acescct,
    "PQ (ST.2084)": _pq,
    "HLG (BT.2100)": _hlg,
    "DaVinci Intermediate": _davinci,
    "Gamma 2.4": lambda x, m: m.pow(m.floor0(x), 1.0 / 2.4),
}
ENCODE: dict[str, Curve] = {name: (lambda x, fn=fn: fn(x, ColumnMath)) for name, fn in _CURVES.items()}


def encode_array(name: str, x: np.ndarray) -> np.ndarray:
    """The same curve on an array."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return _CURVES[name](x, ArrayMath)


def srgb_display(x: Column) -> Column:
    """sRGB display encoding."""
    return _split(x <= 0.0031308, x * 12.92, _pow(_floor0(x), 1.0 / 2.4) * 1.055 - 0.055)


def _d_clog3(y: Column) -> Column:
    low = (_pow(10.0, (F.lit(0.12783901) - y) / 0.36726845) - 1.0) / -14.98325
    high = (_pow(10.0, (y - 0.12240537) / 0.36726845) - 1.0) / 14.98325
    return (
        F.when(y < CLOG3_MID + CLOG3_LOW * CLOG3_SLOPE, low)
        .when(y <= CLOG3_MID + CLOG3_HIGH * CLOG3_SLOPE, (y - CLOG3_MID) / CLOG3_SLOPE)
        .otherwise(high)
    )


def _d_apple(y: Column) -> Column:
    knee = APPLE_C * (APPLE_RT - APPLE_R0) * (APPLE_RT - APPLE_R0)
    return (
        F.when(y <= 0.0, F.lit(APPLE_R0))
        .when(y < knee, F.sqrt(_floor0(y) / APPLE_C) + APPLE_R0)
        .otherwise(_pow(2.0, (y - APPLE_DELTA) / APPLE_GAMMA) - APPLE_BETA)
    )


def _d_pq(y: Column) -> Column:
    v = _pow(_floor0(y), 1.0 / PQ_M2)
    den = F.lit(PQ_C2) - v * PQ_C3
    ratio = F.try_divide(_floor0(v - PQ_C1), den)
    return F.when(den > 0.0, _pow(ratio, 1.0 / PQ_M1)).otherwise(F.lit(0.0))


def _d_logc4(y: Column) -> Column:
    log = (_pow(2.0, (y - LOGC4_C) / LOGC4_B * 14.0 + 6.0) - 64.0) / LOGC4_A
    return _split(y >= 0.0, log, y * LOGC4_S + LOGC4_T)


def _d_rec709(cut: float) -> Curve:
    return lambda y: _split(y < cut, y / 4.5, _pow((y + 0.099) / 1.099, 1.0 / 0.45))


def _d_slog3(y: Column) -> Column:
    log = _pow(10.0, (y * 1023.0 - 420.0) / 261.5) * 0.19 - 0.01
    return _split(y >= 171.2102946929 / 1023.0, log, (y * 1023.0 - 95.0) * 0.01125 / (171.2102946929 - 95.0))


def _d_camera_log(k: dict) -> Curve:
    return lambda y: _split(
        y >= k["slope"] * k["cut"] + k["offset"],
        (_pow(10.0, (y - k["lift"]) / k["scale"]) - k["b"]) / k["a"],
        (y - k["offset"]) / k["slope"],
    )


DECODE: dict[str, Curve] = {
    "Linear": lambda y: y,
    "Rec.709": _d_rec709(0.0812429),
    "S-Log3": _d_slog3,
    "V-Log": lambda y: _split(
        y < VLOG_CODE, (y - VLOG["offset"]) / VLOG["slope"], _pow(10.0, (y - VLOG["lift"]) / VLOG["scale"]) - VLOG["shift"]
    ),
    "ARRI LogC3": _d_camera_log(LOGC3),
    "ARRI LogC4": _d_logc4,
    "C-Log3": _d_clog3,
    "F-Log2": _d_camera_log(FLOG2),
    "Apple Log": _d_apple,
    "Apple Log 2": _d_apple,
    "ACES CCT": lambda y: _split(
        y > ACES_SLOPE * ACES_CUT + ACES_OFFSET, _pow(2.0, y * 17.52 - 9.72), (y - ACES_OFFSET) / ACES_SLOPE
    ),
    "PQ (ST.2084)": _d_pq,
    "HLG (BT.2100)": lambda y: _split(y <= 0.5, y * y / 3.0, (F.exp((y - HLG_C) / HLG_A) + HLG_B) / 12.0),
    "DaVinci Intermediate": lambda y: _split(
        y <= DAVINCI["cut"] * DAVINCI["slope"],
        y / DAVINCI["slope"],
        _pow(2.0, y / DAVINCI["scale"] - DAVINCI["add"]) - DAVINCI["shift"],
    ),
    "Gamma 2.4": lambda y: _pow(_floor0(y), 2.4),
}


# The preview path keeps older forms of some curves under the same names.
def _preview_slog3(x: Column) -> Column:
    return _split(x >= 0.01, _log10(x * 10.0 + 1.0) * 0.432699 + 0.037584, (x * 261.5 + 10.23) / 1023.0)


def _preview_pq(x: Column) -> Column:
    k = _pow(_floor0(x), PQ_M1)
    return _floor0(k * PQ_C2 + PQ_C1) / _pow(F.greatest(k * PQ_C3 + 1.0, F.lit(1e-10)), PQ_M2)


def _preview_hlg(x: Column) -> Column:
    log = F.log(F.greatest(x * 12.0 - HLG_B, F.lit(1e-10))) * HLG_A + HLG_C
    return _split(x < 1.0 / 12.0, F.sqrt(_floor0(x) * 3.0), log)


def _preview_d_slog3(y: Column) -> Column:
    knee = (0.01 * 261.5 + 10.23) / 1023.0
    return _split(y >= knee, (_pow(10.0, (y - 0.037584) / 0.432699) - 1.0) / 10.0, (y * 1023.0 - 10.23) / 261.5)


PREVIEW_ENCODE: dict[str, Curve] = {
    **ENCODE,
    "Rec.709": lambda x: _split(x < 0.018, x * 4.5, _pow(_floor0(x), 0.45) * 1.099 - 0.099),
    "S-Log3": _preview_slog3,
    "PQ (ST.2084)": _preview_pq,
    "HLG (BT.2100)": _preview_hlg,
}
PREVIEW_DECODE: dict[str, Curve] = {
    **DECODE,
    "Rec.709": _d_rec709(0.081),
    "S-Log3": _preview_d_slog3,
    "HLG (BT.2100)": lambda y: _split(y <= math.sqrt(3.0 / 12.0), y * y / 3.0, F.exp((y - HLG_C) / HLG_A) + HLG_B / 12.0),
}


def encode_table(pixels: DataFrame, curve: str, channels=("r", "g", "b"), curves=None) -> DataFrame:
    """Encode the channel columns of a pixel table with one curve."""
    fn = (curves or ENCODE)[curve]
    return pixels.withColumns({c: fn(F.col(c)) for c in channels})


def decode_table(pixels: DataFrame, curve: str, channels=("r", "g", "b"), curves=None) -> DataFrame:
    """Decode the channel columns of a pixel table with one curve."""
    fn = (curves or DECODE)[curve]
    return pixels.withColumns({c: fn(F.col(c)) for c in channels})


def encode_by_params(
    pixels: DataFrame, params: DataFrame, key: str = "clip_id", channels=("r", "g", "b"), spread=None
) -> DataFrame:
    """Encode a pixel table whose clips use different curves, in one pass.

    ``params`` has one row per clip with its ``transfer``. Pixels of clips without a known
    curve stay, with null channels.
    """
    joined = attach(pixels, params.select(key, "transfer"), [key], "left", spread=spread)

    def branch(x: Column) -> Column:
        chosen = F.when(F.lit(False), x)
        for name, curve in ENCODE.items():
            chosen = chosen.when(F.col("transfer") == name, curve(x))
        return chosen

    return joined.withColumns({c: branch(F.col(c)) for c in channels})
