"""Fixed vocabularies, as plain values and as small tables.

Every table here has a fixed, tiny number of rows, so it may be broadcast.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake.session import small_table

# ---------------------------------------------------------------------------
# Fixed values. They must equal the container format, the published colour
# standards and the encoder program's argument names.
# ---------------------------------------------------------------------------

CLIP_SUFFIX = ".mcraw"
HEADED_MAGIC = b"MOTION "
LEGACY_MAGIC = b"MCRAW"
INDEX_MAGIC = 0x8A905612

# code, name, display name, packed filter word
BAYER = [
    (0, "RGGB", "RGGB", 0x94949494),
    (1, "GRBG", "GRBG", 0x61616161),
    (2, "GBRG", "GBRG", 0x49494949),
    (3, "BGGR", "BGGR", 0x16161616),
    (4, "QuadBayerRGGB", "QuadBayer RGGB", 0x94949494),
    (5, "QuadBayerGRBG", "QuadBayer GRBG", 0x94949494),
    (6, "QuadBayerGBRG", "QuadBayer GBRG", 0x94949494),
    (7, "QuadBayerBGGR", "QuadBayer BGGR", 0x94949494),
]

# spelling in the clip header -> pattern
ARRANGEMENT = {"rggb": "RGGB", "standard": "RGGB", "grbg": "GRBG", "gbrg": "GBRG", "bggr": "BGGR"}

# 2x2 filter colours, row by row: 0 = red, 1 = green, 2 = blue
CFA = {
    "RGGB": (0, 1, 1, 2),
    "GRBG": (1, 0, 2, 1),
    "GBRG": (1, 2, 0, 1),
    "BGGR": (2, 1, 1, 0),
}

# name, red x/y, green x/y, blue x/y, white x/y
GAMUT = [
    ("ACES AP1", 0.713, 0.293, 0.165, 0.830, 0.128, 0.044, 0.32168, 0.33767),
    ("Apple Wide Gamut", 0.725, 0.301, 0.221, 0.814, 0.068, -0.076, 0.3127, 0.3290),
    ("ARRI Wide Gamut 3", 0.6840, 0.3130, 0.2210, 0.8480, 0.0861, -0.1020, 0.3127, 0.3290),
    ("ARRI Wide Gamut 4", 0.7347, 0.2653, 0.1424, 0.8576, 0.0991, -0.0308, 0.3127, 0.3290),
    ("Canon Cinema Gamut", 0.7400, 0.2700, 0.1700, 1.1400, 0.0800, -0.1000, 0.3127, 0.3290),
    ("DaVinci Wide Gamut", 0.8000, 0.3130, 0.1682, 0.9877, 0.0790, -0.1155, 0.3127, 0.3290),
    ("DCI-P3", 0.680, 0.320, 0.265, 0.690, 0.150, 0.060, 0.314, 0.351),
    ("Display P3", 0.680, 0.320, 0.265, 0.690, 0.150, 0.060, 0.3127, 0.3290),
    ("F-Gamut", 0.708, 0.292, 0.170, 0.797, 0.131, 0.046, 0.3127, 0.3290),
    ("F-Gamut C", 0.7347, 0.2653, 0.0263, 0.9737, 0.1173, -0.0224, 0.3127, 0.3290),
    ("Panasonic V-Gamut", 0.7300, 0.2800, 0.1650, 0.8400, 0.1000, -0.0300, 0.3127, 0.3290),
    ("Rec.2020", 0.708, 0.292, 0.170, 0.797, 0.131, 0.046, 0.3127, 0.3290),
    ("Rec.709", 0.640, 0.330, 0.300, 0.600, 0.150, 0.060, 0.3127, 0.3290),
    ("S-Gamut3", 0.7300, 0.2800, 0.1400, 0.8550, 0.1000, -0.0500, 0.3127, 0.3290),
    ("S-Gamut3.Cinema", 0.766, 0.275, 0.225, 0.800, 0.089, -0.087, 0.3127, 0.3290),
    ("sRGB", 0.640, 0.330, 0.300, 0.600, 0.150, 0.060, 0.3127, 0.3290),
]

# Rec.709 and sRGB use this rounded matrix and not one from their primaries.
XYZ_TO_REC709 = [
    3.2404542, -1.5371385, -0.4985354,
    -0.9689294, 1.8767608, 0.0415560,
    0.0556434, -0.2040259, 1.0572252,
]
FIXED_MATRIX_GAMUTS = ("Rec.709", "sRGB")

# name, curve needs 10 bits (log or HDR)
TRANSFER = [
    ("ACES CCT", True),
    ("ARRI LogC3", True),
    ("ARRI LogC4", True),
    ("Apple Log", True),
    ("Apple Log 2", True),
    ("C-Log3", True),
    ("DaVinci Intermediate", True),
    ("F-Log2", True),
    ("Gamma 2.4", False),
    ("HLG (BT.2100)", True),
    ("Linear", False),
    ("PQ (ST.2084)", True),
    ("Rec.709", False),
    ("S-Log3", True),
    ("V-Log", True),
]

# name, red x/y, green x/y, blue x/y; the white point is always D65
TONEMAP_GAMUT = [
    ("Ap0", 0.7347, 0.2653, 0.0000, 1.0000, 0.0001, -0.0770),
    ("Ap1", 0.7130, 0.2930, 0.1650, 0.8300, 0.1280, 0.0440),
    ("P3D65", 0.6800, 0.3200, 0.2650, 0.6900, 0.1500, 0.0600),
    ("P3D60", 0.6800, 0.3200, 0.2650, 0.6900, 0.1500, 0.0600),
    ("Rec2020", 0.7080, 0.2920, 0.1700, 0.7970, 0.1310, 0.0460),
    ("Rec709", 0.6400, 0.3300, 0.3000, 0.6000, 0.1500, 0.0600),
    ("Awg3", 0.6840, 0.3130, 0.2210, 0.8480, 0.0861, -0.1020),
    ("Awg4", 0.6800, 0.3150, 0.2200, 0.8500, 0.0860, -0.1000),
    ("Rwg", 0.7300, 0.2800, 0.1400, 0.8550, 0.1000, -0.0900),
    ("SGamut3", 0.7500, 0.2700, 0.2100, 0.8000, 0.1000, -0.0500),
    ("SGamut3Cine", 0.7660, 0.2750, 0.2250, 0.8000, 0.0890, -0.0870),
    ("BlackmagicWg", 0.7500, 0.2700, 0.2100, 0.8000, 0.1000, -0.0500),
    ("CanonCinema", 0.7400, 0.2700, 0.1700, 0.7900, 0.0800, -0.1000),
    ("DaVinciWg", 0.7350, 0.2650, 0.2150, 0.8100, 0.1200, -0.0500),
    ("EGamut", 0.7300, 0.2800, 0.1700, 0.8000, 0.1000, -0.0600),
]

# export gamut -> tone-map gamut
TONEMAP_GAMUT_OF = {
    "ACES AP1": "Ap1",
    "Apple Wide Gamut": "Rec709",
    "ARRI Wide Gamut 3": "Awg3",
    "ARRI Wide Gamut 4": "Awg4",
    "Canon Cinema Gamut": "CanonCinema",
    "DaVinci Wide Gamut": "DaVinciWg",
    "DCI-P3": "P3D65",
    "Display P3": "P3D65",
    "F-Gamut": "Rwg",
    "F-Gamut C": "Ap0",
    "Panasonic V-Gamut": "Rwg",
    "Rec.2020": "Rec2020",
    "Rec.709": "Rec709",
    "S-Gamut3": "SGamut3",
    "S-Gamut3.Cinema": "SGamut3Cine",
    "sRGB": "Rec709",
}

# the 21 tone-map curves
TONEMAP_TRANSFER = [
    "Linear", "AcesCct", "ArriLogC3", "ArriLogC4", "RedLog3G10", "SonySLog3", "SonySLog2",
    "BmFilmGen5", "CanonLog3", "CanonLog2", "DaVinciIntermediate", "FilmlightTLog",
    "AgxLogKraken", "VLog", "FLog2", "FLog2C", "AppleLog2", "HLG", "PQ", "DNG", "DI",
]

# export curve -> tone-map curve
TONEMAP_TRANSFER_OF = {
    "ACES CCT": "AcesCct",
    "ARRI LogC3": "ArriLogC3",
    "ARRI LogC4": "ArriLogC4",
    "Apple Log": "Linear",
    "Apple Log 2": "Linear",
    "C-Log3": "CanonLog3",
    "DaVinci Intermediate": "DaVinciIntermediate",
    "F-Log2": "FLog2",
    "Gamma 2.4": "Linear",
    "HLG (BT.2100)": "HLG",
    "Linear": "Linear",
    "PQ (ST.2084)": "PQ",
    "Rec.709": "Linear",
    "S-Log3": "SonySLog3",
    "V-Log": "VLog",
}

# family, profile, profile is 8-bit, profile is the family's default
CODEC_PROFILE = [
    ("ProRes", "Proxy", False, False),
    ("ProRes", "LT", False, False),
    ("ProRes", "Standard", False, False),
    ("ProRes", "HQ", False, True),
    ("ProRes", "4444", False, False),
    ("ProRes", "4444 XQ", False, False),
    ("DNxHR", "SQ", False, False),
    ("DNxHR", "HD", False, False),
    ("DNxHR", "HDX", False, False),
    ("DNxHR", "HQX", False, True),
    ("DNxHR", "444", False, False),
    ("HEVC", "Main 10 4:2:0", False, True),
    ("HEVC", "Main 10 4:4:4", False, False),
    ("H.264", "Main 8-bit", True, True),
    ("H.264", "High 10-bit", False, False),
    ("AV1", "Profile 0 4:2:0 10-bit", False, True),
    ("AV1", "Profile 1 4:4:4 10-bit", False, False),
    ("VP9", "Profile 2 4:2:0 10-bit", False, True),
    ("VP9", "Profile 3 4:4:4 10-bit", False, False),
]
CODEC_FAMILIES = ["ProRes", "DNxHR", "HEVC", "H.264", "AV1", "VP9"]

# preset column that names the profile of each family
PROFILE_COLUMN = {
    "ProRes": "prores_profile",
    "DNxHR": "dnxhr_profile",
    "HEVC": "hevc_profile",
    "H.264": "h264_profile",
    "AV1": "av1_profile",
    "VP9": "vp9_profile",
}

# family -> encoders in order of preference; the last one is the fallback
ENCODER_PRIORITY = {
    "HEVC": (["hevc_nvenc", "hevc_amf", "hevc_qsv", "hevc_videotoolbox"], "libx265"),
    "H.264": (["h264_nvenc", "h264_amf", "h264_qsv", "h264_videotoolbox"], "libx264"),
    "AV1": (["av1_nvenc", "av1_amf", "av1_qsv", "libsvtav1"], "libaom-av1"),
    "ProRes": (["prores_videotoolbox"], "prores_ks"),
}

# light-source name -> DNG illuminant code
ILLUMINANT = {
    "d50": 23, "horizon": 23, "cool_white": 23,
    "d55": 22,
    "d65": 21, "daylight": 21, "fine_weather": 21, "cloudy": 21,
    "d75": 24, "shade": 24,
    "standardlighta": 17, "standard_a": 17, "tungsten": 17, "incandescent": 17,
    "warm_white": 17, "iso_studio_tungsten": 17,
    "fluorescent": 12, "tl84": 12,
    "flash": 4, "standardlightb": 4,
}

RESOLUTION = [(1920, 1080, "1080p"), (2560, 1440, "1440p"), (3840, 2160, "4K"), (4096, 2160, "4K DCI")]
FORMAT_NAME = {1: "MotionCam v1 (Legacy)", 2: "MotionCam v2", 3: "MotionCam v3"}

# name, black, white ("Dynamic" and "Static" take their levels from the clip)
LEVEL_PRESET = [
    ("Dynamic", None, None),
    ("Static", None, None),
    ("1023/64", 64.0, 1023.0),
    ("4095/256", 256.0, 4095.0),
    ("16383/1024", 1024.0, 16383.0),
    ("65535/4096", 4096.0, 65535.0),
    ("4095/64", 64.0, 4095.0),
    ("16383/64", 64.0, 16383.0),
    ("16383/0", 0.0, 16383.0),
]

# name, column, default, min, max, small step, large step, "is set" threshold
SLIDER = [
    ("Exposure", "exposure", 0.0, -5.0, 5.0, 0.1, 1.0, 0.01),
    ("Contrast", "contrast", 1.0, 0.0, 2.0, 0.05, 0.25, 0.01),
    ("Saturation", "saturation", 1.0, 0.0, 2.0, 0.05, 0.25, 0.01),
    ("Shadows", "shadows", 0.0, -1.0, 1.0, 0.05, 0.25, 0.01),
    ("Highlights", "highlights", 0.0, -1.0, 1.0, 0.05, 0.25, 0.01),
    ("Temp", "temperature", 5200.0, 2000.0, 10000.0, 50.0, 500.0, 50.0),
    ("Tint", "tint", 0.0, -100.0, 100.0, 1.0, 10.0, 0.5),
    ("Sharpen", "sharpen", 0.0, 0.0, 1.0, 0.05, 0.25, None),
]

# grade sidecar fields and the values that change nothing
SIDECAR_DEFAULT = {
    "enabled": False,
    "exposure_stops": 0.0,
    "white_balance_kelvin": 5500,
    "white_balance_tint": 0.0,
    "lift_r": 0.0, "lift_g": 0.0, "lift_b": 0.0,
    "gamma_r": 1.0, "gamma_g": 1.0, "gamma_b": 1.0,
    "gain_r": 1.0, "gain_g": 1.0, "gain_b": 1.0,
    "contrast": 1.0,
    "saturation": 1.0,
}

FPS = [23.976, 24.0, 25.0, 30.0, 50.0, 60.0, 120.0]
FPS_LABEL = ["23.976", "24", "25", "30", "50", "60", "120"]

# gamut -> (primaries tag, matrix tag); every other gamut is tagged bt2020
VUI_GAMUT = {
    "Rec.709": ("bt709", "bt709"),
    "sRGB": ("bt709", "bt709"),
    "DCI-P3": ("smpte431", "bt2020nc"),
    "Display P3": ("smpte432", "bt2020nc"),
}
VUI_GAMUT_OTHER = ("bt2020", "bt2020nc")

# curve -> transfer tag; every other curve is "unknown"
VUI_TRANSFER = {
    "Rec.709": "bt709",
    "Gamma 2.4": "bt709",
    "HLG (BT.2100)": "arib-std-b67",
    "PQ (ST.2084)": "smpte2084",
    "Linear": "linear",
}

PHASES = [
    "setup", "decode", "lens_correction", "demosaic", "normalize", "wb_hl_ccm",
    "oetf", "pack", "gpu", "encode_push", "finalize",
]
WALL_PHASES = ["setup", "decode", "encode_push", "finalize"]

# difference category -> code length in bits
CODE_LENGTH = [2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]

D50 = (0.96422, 1.0, 0.82521)
D65 = (0.95047, 1.0, 1.08883)
LUMA = (0.2126, 0.7152, 0.0722)

# ---------------------------------------------------------------------------
# Columns and tables over the values above
# ---------------------------------------------------------------------------


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """A fixed mapping as one foldable expression, with a default."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def _table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return small_table(spark, list(rows), schema)


def dim_bayer(spark: SparkSession) -> DataFrame:
    return _table(spark, BAYER, "code int, name string, label string, filters bigint")


def dim_primaries(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        GAMUT,
        "name string, xr double, yr double, xg double, yg double, xb double, yb double, "
        "xw double, yw double",
    )


def dim_transfer(spark: SparkSession) -> DataFrame:
    return _table(spark, [(n, h, h) for n, h in TRANSFER], "name string, requires_10bit boolean, is_log boolean")


def dim_tonemap_gamut(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        [(*row, 0.3127, 0.3290) for row in TONEMAP_GAMUT],
        "name string, xr double, yr double, xg double, yg double, xb double, yb double, "
        "xw double, yw double",
    )


def dim_tonemap_transfer(spark: SparkSession) -> DataFrame:
    return _table(spark, [(i, n) for i, n in enumerate(TONEMAP_TRANSFER)], "pos int, name string")


def dim_codec(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(CODEC_PROFILE)]
    return _table(spark, rows, "pos int, family string, profile string, is_8bit boolean, is_default boolean")


def dim_encoder_priority(spark: SparkSession) -> DataFrame:
    rows = [
        (family, pos, name, False)
        for family, (names, _) in ENCODER_PRIORITY.items()
        for pos, name in enumerate(names)
    ]
    rows += [(family, len(names), last, True) for family, (names, last) in ENCODER_PRIORITY.items()]
    return _table(spark, rows, "family string, pos int, encoder string, is_fallback boolean")


def dim_illuminant(spark: SparkSession) -> DataFrame:
    return _table(spark, ILLUMINANT.items(), "name string, code int")


def dim_resolution(spark: SparkSession) -> DataFrame:
    return _table(spark, RESOLUTION, "width int, height int, label string")


def dim_level_preset(spark: SparkSession) -> DataFrame:
    return _table(spark, LEVEL_PRESET, "name string, black double, white double")


def dim_slider(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        [(i, *row) for i, row in enumerate(SLIDER)],
        "pos int, name string, field string, default_value double, min_value double, "
        "max_value double, step_small double, step_large double, threshold double",
    )


def dim_fps(spark: SparkSession) -> DataFrame:
    rows = [(0, None, "Original")] + [(i + 1, v, n) for i, (v, n) in enumerate(zip(FPS, FPS_LABEL))]
    return _table(spark, rows, "pos int, fps double, label string")


def dim_vui(spark: SparkSession) -> DataFrame:
    """One row per gamut and curve with the three stream tags."""
    rows = [
        (g[0], t, *VUI_GAMUT.get(g[0], VUI_GAMUT_OTHER), VUI_TRANSFER.get(t, "unknown"))
        for g in GAMUT
        for t, _ in TRANSFER
    ]
    return _table(spark, rows, "gamut string, transfer string, primaries string, matrix string, trc string")


def dim_phase(spark: SparkSession) -> DataFrame:
    rows = [(i, p, p in WALL_PHASES) for i, p in enumerate(PHASES)]
    return _table(spark, rows, "pos int, phase string, in_wall boolean")


def dim_code_length(spark: SparkSession) -> DataFrame:
    return _table(spark, enumerate(CODE_LENGTH), "category int, bits int")
