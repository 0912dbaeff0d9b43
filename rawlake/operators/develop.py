"""From mosaic to 16-bit colour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import curves
from rawlake.functions.matrix import dot_rows
from rawlake.functions.numeric import clamp, extended_white, to_u16
from rawlake.operators import lens, tiles
from rawlake.session import attach

DISPLAY_CURVES = ("Rec.709", "Gamma 2.4", "Linear")
RGB = ("r", "g", "b")


def level_scaled(value: Column, black: Column, white: Column) -> Column:
    """Value between black and white as 0..1; a range of zero or less counts as 1."""
    span = F.when(white > black, white - black).otherwise(F.lit(1.0))
    return clamp((value - black) * (F.lit(1.0) / span), 0.0, 1.0)


def normalise(pixels: DataFrame, black: Column, white: Column) -> DataFrame:
    """One level for all channels."""
    return pixels.withColumns({c: level_scaled(F.col(c), black, white) for c in RGB})


def normalise_channels(pixels: DataFrame, black: list[Column], white: Column) -> DataFrame:
    """One black level per channel."""
    return pixels.withColumns({c: level_scaled(F.col(c), b, white) for c, b in zip(RGB, black)})


def _toward(value: Column, target: Column, t: Column) -> Column:
    return value + (target - value) * t


def display_colour(pixels: DataFrame, gain_r: Column, gain_b: Column, matrix: str) -> DataFrame:
    """White balance, highlight desaturation, matrix, no negatives."""
    p = pixels.withColumns({"r": F.col("r") * gain_r, "b": F.col("b") * gain_b})
    top = F.greatest(*RGB)
    p = p.withColumns({"_t": F.when(top > 0.95, F.least((top - 0.95) / 0.05, F.lit(1.0))).otherwise(F.lit(0.0)), "_n": F.least(top, F.lit(1.0))})
    p = p.withColumns({c: _toward(F.col(c), F.col("_n"), F.col("_t")) for c in RGB})
    out = dot_rows(matrix, list(RGB))
    return p.withColumns({c: F.greatest(v, F.lit(0.0)) for c, v in zip(RGB, out)}).drop("_t", "_n")


def log_colour(pixels: DataFrame, gain_r: Column, gain_b: Column, matrix: str) -> DataFrame:
    """White balance, matrix, and a soft clip toward luma above 1."""
    p = pixels.withColumns({"r": F.col("r") * gain_r, "b": F.col("b") * gain_b})
    out = dot_rows(matrix, list(RGB))
    p = p.withColumns({c: F.greatest(v, F.lit(0.0)) for c, v in zip(RGB, out)})
    top = F.greatest(*RGB)
    luma = sum((F.col(c) * w for c, w in zip(RGB, vocab.LUMA)), F.lit(0.0))
    p = p.withColumns(
        {
            "_l": F.greatest(F.least(luma, top), F.lit(0.0)),
            "_t": F.when(top > 1.0, F.least(top - 1.0, F.lit(1.0))).otherwise(F.lit(0.0)),
        }
    )
    return p.withColumns({c: _toward(F.col(c), F.col("_l"), F.col("_t")) for c in RGB}).drop("_l", "_t")


def highlight_clip(pixels: DataFrame, threshold: float) -> DataFrame:
    """Pull channels toward the largest one above a threshold."""
    if threshold >= 1.0:
        return pixels
    top = F.greatest(*RGB)
    t = F.when(top > threshold, F.least((top - threshold) / (1.0 - threshold), F.lit(1.0))).otherwise(F.lit(0.0))
    p = pixels.withColumns({"_m": top, "_t": t})
    return p.withColumns({c: _toward(F.col(c), F.col("_m"), F.col("_t")) for c in RGB}).drop("_m", "_t")


def quantised(pixels: DataFrame) -> DataFrame:
    """16-bit codes of the channels."""
    return pixels.withColumns({c: to_u16(F.col(c)) for c in RGB})


def packed(pixels: DataFrame, transfer: str) -> DataFrame:
    """P10: encode with the export curve, then 16-bit codes."""
    return quantised(curves.encode_table(pixels, transfer))


def with_params(pixels: DataFrame, params: DataFrame, key: str = "clip_id", spread=("frame_id", "y", "x")) -> DataFrame:
    """Attach the parameters of a clip or frame to its pixels or tiles; rows without any stay, with nulls."""
    return attach(pixels, params, [key], "left", spread=list(spread))


def colour_of(planes, p: dict) -> np.ndarray:
    """P2 to C33 on the planes of one tile: 16-bit codes, one row per pixel."""
    r, g, b = planes
    white = p["white"]
    span = [white - k if white > k else 1.0 for k in p["black"]]
    r, g, b = (np.clip((v - k) * (1.0 / s), 0.0, 1.0) for v, k, s in zip((r, g, b), p["black"], span, strict=True))
    r, b = r * p["gain_r"], b * p["gain_b"]
    display = p["transfer"] in DISPLAY_CURVES
    if display:
        top = np.maximum(np.maximum(r, g), b)
        t = np.where(top > 0.95, np.minimum((top - 0.95) / 0.05, 1.0), 0.0)
        r, g, b = (v + (np.minimum(top, 1.0) - v) * t for v in (r, g, b))
    m = p["fused"]
    out = [np.maximum(m[3 * i] * r + m[3 * i + 1] * g + m[3 * i + 2] * b, 0.0) for i in range(3)]
    if not display:
        top = np.maximum(np.maximum(out[0], out[1]), out[2])
        luma = sum(v * w for v, w in zip(out, vocab.LUMA, strict=True))
        luma = np.maximum(np.minimum(luma, top), 0.0)
        t = np.where(top > 1.0, np.minimum(top - 1.0, 1.0), 0.0)
        out = [v + (luma - v) * t for v in out]
    codes = [np.nan_to_num(curves.encode_array(p["transfer"], v), nan=0.0, posinf=1.0, neginf=0.0) for v in out]
    return np.floor(np.clip(np.stack(codes, axis=1), 0.0, 1.0) * 65535.0).astype("<u2")


METHODS = {"bilinear": tiles.export_planes_of, "edges": tiles.edge_planes_of}
SETTINGS = ["fused", "norm_black", "norm_white", "gain_r", "gain_b", "transfer", "method"]


def _developed(px: np.ndarray, t: dict) -> tuple[bytes | None]:
    known = t["transfer"] in curves.ENCODE and t["method"] in METHODS
    if not known or any(t[c] is None for c in SETTINGS):
        return (None,)
    black = t["norm_black"]
    planes = METHODS[t["method"]](px, {**t, "pattern": t["pattern"] or "", "black": black})
    if t["method"] == "edges":  # its planes are above black already, with a white level per channel
        planes = tuple(v + k for v, k in zip(planes, black, strict=True))
    p = {**t, "black": black, "white": t["norm_white"]}
    return (colour_of(planes, p).tobytes(),)


def _develop(
    tiled: DataFrame,
    params: DataFrame,
    transfer: str | Column,
    key: str = "frame_id",
    lens_mode: str | Column = "Off",
    grids: DataFrame | None = None,
    grid_key: str = "clip_id",
    method: str | Column = "bilinear",
    after=None,
) -> DataFrame:
    """:func:`develop_tiles`; ``after`` (columns and types to its schema and function) goes on in the same Python step."""
    chosen = {"transfer": transfer, "lens_mode": lens_mode, "method": method}
    chosen = {k: v if isinstance(v, Column) else F.lit(v) for k, v in chosen.items()}
    extra = [c for c in ("sensor_w", "sensor_h", "pattern") if c in params.columns and c not in tiled.columns]
    wanted = params.select(key, "fused", "src_black", "src_white", "gain_r", "gain_b", *extra, *[v.alias(k) for k, v in chosen.items()])
    t = with_params(tiled.drop(*chosen), wanted, key, spread=("tile_y", "tile_x"))
    wide = extended_white(F.col("src_white")).cast("double")
    gridded = F.lit(False)
    if grids is not None:
        shapes = grids.select(grid_key, "lens_grid", "grid_w", "grid_h")
        t = attach(t, shapes, [grid_key], "left", spread=["frame_id", "tile_y", "tile_x"])
        plain = F.when(F.col("lens_mode") == "Full", F.col("lens_grid"))
        t = t.withColumn("lens_grid", plain.when(F.col("lens_mode") == "ColorOnly", lens.colour_only(F.col("lens_grid"))))
        gridded = F.col("lens_grid").isNotNull()
    t = t.withColumns(
        {
            "out_white": wide,
            "norm_white": F.when(gridded, wide).otherwise(F.col("src_white")).cast("double"),
            "norm_black": F.when(gridded, F.array(*[F.lit(0.0)] * 3)).otherwise(F.col("src_black")),
        }
    )
    before = None
    if grids is not None:
        for column in ("crop_x", "crop_y"):
            if column not in t.columns:
                t = t.withColumn(column, F.lit(0))
        before = lens.correction(t)
    drop = [c for c in (*SETTINGS, "lens_mode", "src_black", "src_white", "out_white", "sensor_w", "sensor_h") if c in t.columns]
    if after is not None:
        after = after({f.name: f.dataType.simpleString() for f in t.schema.fields})
    need = [*tiles.GEOMETRY, "pattern", *SETTINGS]
    return tiles.over_tiles(t, _developed, need, drop, {"rgb16": pa.binary()}, "rgb16 binary", before, after)


def develop_tiles(
    tiled: DataFrame,
    params: DataFrame,
    transfer: str | Column,
    key: str = "frame_id",
    lens_mode: str | Column = "Off",
    grids: DataFrame | None = None,
    grid_key: str = "clip_id",
    method: str | Column = "bilinear",
) -> DataFrame:
    """Every tile as ``rgb16``, six bytes per covered pixel (little-endian R, G, B).

    ``params`` comes from :func:`params.frame_params` (or ``clip_params`` with gains) and is
    attached to tiles, one row per tile. ``transfer``, ``lens_mode`` (Off, Full, ColorOnly)
    and ``method`` (bilinear; edges, which needs a halo of ``tiles.EDGE_HALO``) are values,
    or columns of ``params``, so that one run serves jobs with different settings. A tile
    without parameters, or with an unknown setting, stays and has a null ``rgb16``.
    """
    return _develop(tiled, params, transfer, key, lens_mode, grids, grid_key, method)


def _long_form(types: dict[str, str]):
    """(schema, function of batches) of :func:`rgb16_pixels`."""
    keep = [c for c in types if c in ("clip_id", "frame_id")]
    names = ["y", "x", "r", "g", "b"]
    schema = ", ".join([*[f"{c} {types[c]}" for c in keep], *[f"{c} int" for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = {c: batch.column(c).to_pylist() for c in ("y0", "x0", "w", "h")}
            for i in range(batch.num_rows):
                if not batch.column("rgb16")[i].is_valid:
                    continue
                codes = np.frombuffer(batch.column("rgb16")[i].as_py(), dtype="<u2").reshape(-1, 3).astype(np.int32)
                y, x = np.divmod(np.arange(len(codes)), place["w"][i])
                rows = batch.select(keep).take(pa.array(np.full(len(codes), i)))
                spots = [pa.array((v + o[i]).astype(np.int32)) for v, o in ((y, place["y0"]), (x, place["x0"]))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *spots, *[pa.array(c) for c in codes.T.copy()]], names=[*keep, *names])

    return schema, run


def rgb16_pixels(developed: DataFrame) -> DataFrame:
    """Long form of developed tiles: a row per pixel with ``y, x, r, g, b``; undeveloped tiles have none."""
    types = dict(developed.dtypes)
    schema, run = _long_form(types)
    keep = [c for c in types if c in ("clip_id", "frame_id")]
    known = developed.where(F.col("rgb16").isNotNull()).select(*keep, "y0", "x0", "w", "h", "rgb16")
    return known.mapInArrow(run, schema)


def develop(tiled: DataFrame, params: DataFrame, transfer: str | Column, *args, **kw) -> DataFrame:
    """16-bit RGB as one row per pixel; :func:`develop_tiles` keeps them packed."""
    return _develop(tiled, params, transfer, *args, **kw, after=_long_form)
