"""Grading, previews, thumbnails and histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import curves, numeric
from rawlake.functions.numeric import clamp, smoothstep
from rawlake.operators.tiles import GEOMETRY, PLANES, PLANES_DDL, over_tiles, preview_at

RGB = ("r", "g", "b")

# ---------------------------------------------------------------------------
# Preview matrices, used as given (rows).
# ---------------------------------------------------------------------------
WORKING_TO_XYZ = {
    "ACES AP1": [
        0.6954522414, 0.1406786965, 0.1638690622,
        0.0447945634, 0.8596711185, 0.0955343182,
        -0.0055258826, 0.0040252104, 1.0015006723,
    ],
    "Apple Wide Gamut": [
        1.99650669, -0.04380294, 0.04729625,
        0.50573456, 0.86522867, -0.37096323,
        0.00612684, -0.00089651, 0.99476967,
    ],
    "ARRI Wide Gamut 3": [
        0.688161, 0.150181, 0.161658,
        0.047434, 0.807529, 0.145037,
        -0.002103, -0.004533, 1.006636,
    ],
    "ARRI Wide Gamut 4": [
        0.732690, 0.143327, 0.123983,
        0.044200, 0.878486, 0.077314,
        -0.001988, -0.003142, 1.005130,
    ],
    "DaVinci Wide Gamut": [
        0.8000, 0.3130, -0.1130,
        0.1682, 0.9877, -0.1559,
        0.0790, -0.1155, 1.0365,
    ],
    "DCI-P3": [
        0.4865709, 0.2656677, 0.1982242,
        0.2289746, 0.6917385, 0.0792869,
        0.0, 0.0451136, 1.0439444,
    ],
    "Display P3": [
        0.4865709, 0.2656677, 0.1982242,
        0.2289746, 0.6917385, 0.0792869,
        0.0, 0.0451136, 1.0439444,
    ],
    "Rec.2020": [
        0.6369580, 0.1446169, 0.1688810,
        0.2627002, 0.6779981, 0.0593017,
        0.0, 0.0280727, 1.0609052,
    ],
}
PREVIEW_XYZ_TO_RGB = [
    3.2404542, -1.9692660, 0.0556434,
    -1.5371385, 1.8760108, -0.2040259,
    -0.4985314, 0.0415560, 1.0572252,
]


def luma_of(p=F.col) -> Column:
    return sum((p(c) * w for c, w in zip(RGB, vocab.LUMA)), F.lit(0.0))


def grade(pixels: DataFrame, grade: dict[str, Column]) -> DataFrame:
    """Exposure, gains, matrix and, where active, tone, contrast and saturation.

    The matrix rows are applied as columns, unlike in the export path.
    ``grade`` names the columns: exposure, wb_r, wb_g, wb_b, ccm, adjust,
    shadows, highlights, contrast, saturation.
    """
    lift = F.pow(F.lit(2.0), grade["exposure"])
    gains = [grade["wb_r"], grade["wb_g"], grade["wb_b"]]
    p = pixels.withColumns({c: F.col(c) * lift * g for c, g in zip(RGB, gains)})
    m = [F.get(grade["ccm"], i) for i in range(9)]
    r, g, b = (F.col(c) for c in RGB)
    p = p.withColumns({c: m[i] * r + m[3 + i] * g + m[6 + i] * b for i, c in enumerate(RGB)})
    p = p.withColumn("_y", luma_of())
    lift_w = F.lit(1.0) - smoothstep(0.0, 0.35, F.col("_y"))
    high_w = smoothstep(0.5, 1.0, F.col("_y"))
    p = p.withColumns({"_s": grade["shadows"] * lift_w, "_h": grade["highlights"] * high_w})
    toned = {}
    for c in RGB:
        raised = F.col(c) + F.col("_s")
        curve = F.greatest(raised + F.col("_h") * raised, F.lit(0.0))
        pivot = F.greatest((curve - 0.18) * grade["contrast"] + 0.18, F.lit(0.0))
        toned[f"_{c}"] = pivot
    p = p.withColumns(toned).withColumn("_y", luma_of(lambda c: F.col(f"_{c}")))
    out = {
        c: F.when(grade["adjust"], F.col("_y") + (F.col(f"_{c}") - F.col("_y")) * grade["saturation"]).otherwise(F.col(c))
        for c in RGB
    }
    return p.withColumns(out).drop("_y", "_s", "_h", "_r", "_g", "_b")


def to_srgb(pixels: DataFrame, gamut: str) -> DataFrame:
    """Working gamut to clipped linear sRGB. Unlisted gamuts are clipped first."""
    clipped = {c: clamp(F.col(c), 0.0, 1.0) for c in RGB}
    if gamut in vocab.FIXED_MATRIX_GAMUTS:
        return pixels.withColumns(clipped)
    rows = WORKING_TO_XYZ.get(gamut)
    if rows is None:
        p = pixels.withColumns(clipped)
    else:
        r, g, b = (F.col(c) for c in RGB)
        p = pixels.withColumns({c: r * rows[3 * i] + g * rows[3 * i + 1] + b * rows[3 * i + 2] for i, c in enumerate(RGB)})
    x, y, z = (F.col(c) for c in RGB)
    m = PREVIEW_XYZ_TO_RGB
    return p.withColumns(
        {c: clamp(x * m[3 * i] + y * m[3 * i + 1] + z * m[3 * i + 2], 0.0, 1.0) for i, c in enumerate(RGB)}
    )


def display_bytes(pixels: DataFrame, transfer: str, gamut: str) -> DataFrame:
    """P15 tail: preview curve and back, gamut clip, sRGB encoding, 8-bit codes."""
    p = curves.encode_table(pixels, transfer, curves=curves.PREVIEW_ENCODE)
    p = curves.decode_table(p, transfer, curves=curves.PREVIEW_DECODE)
    p = to_srgb(p, gamut)
    p = p.withColumns({c: curves.srgb_display(F.col(c)) for c in RGB})
    codes = {c: F.floor(clamp(F.nanvl(F.col(c), F.lit(0.0)), 0.0, 1.0) * 255.0 + 0.5).cast("int") for c in RGB}
    return p.withColumns(codes)


def sampled(tiles: DataFrame, box_w: int = 320, box_h: int = 180) -> DataFrame:
    """P15 head: demosaic only the pixels a thumbnail samples.

    Every output pixel falls into one tile, so each tile makes its own share.
    """
    fit_w, fit_h = numeric.aspect_fit(F.col("frame_w"), F.col("frame_h"), box_w, box_h)
    t = tiles.withColumns({"out_w": fit_w.cast("int"), "out_h": fit_h.cast("int")})

    def share(start: int, size: int, out: int, full: int) -> np.ndarray:
        return np.arange(-(-start * out // full), -(-(start + size) * out // full), dtype=np.int64)

    def compute(px: np.ndarray, k: dict) -> tuple[np.ndarray, ...]:
        ty = share(k["y0"], k["h"], k["out_h"], k["frame_h"])
        tx = share(k["x0"], k["w"], k["out_w"], k["frame_w"])
        ys, xs = ty * k["frame_h"] // k["out_h"], tx * k["frame_w"] // k["out_w"]
        planes = preview_at(px, {**k, "pattern": k["pattern"] or ""}, ys, xs)
        return np.repeat(ty, len(tx)).astype(np.int32), np.tile(tx, len(ty)).astype(np.int32), *planes

    made = {"ty": pa.list_(pa.int32()), "tx": pa.list_(pa.int32()), **PLANES}
    ddl = f"ty array<int>, tx array<int>, {PLANES_DDL}"
    done = over_tiles(t, compute, [*GEOMETRY, "pattern", "out_w", "out_h"], [], made, ddl)
    keep = [c for c in done.columns if c not in (*made, "frame_w", "frame_h", "y0", "x0", "h", "w", "oy", "ox", "oh", "ow")]
    return done.select(*keep, F.inline(F.arrays_zip(*made)))


def preview_grade(sliders: dict[str, Column]) -> dict[str, Column]:
    """Columns for :func:`grade` from the eight sliders."""
    gains = numeric.gains_from_temperature(sliders["temperature"], sliders["tint"])
    return {
        **{k: sliders[k] for k in ("exposure", "shadows", "highlights", "contrast", "saturation")},
        "wb_r": gains[0],
        "wb_g": gains[1],
        "wb_b": gains[2],
        "adjust": numeric.grade_active(sliders),
    }


def thumbnails(
    tiles: DataFrame, grades: dict[str, Column], transfer: str = "Gamma 2.4", gamut: str = "Rec.709",
    box_w: int = 320, box_h: int = 180, graded: bool = False,
) -> DataFrame:
    """8-bit pixels of a preview; tiles carry ``black``, ``white``, ``pattern`` and ``ccm``."""
    p = sampled(tiles, box_w, box_h)
    span = F.greatest(F.col("white") - F.col("black"), F.lit(0.001))
    p = p.withColumns({c: (F.col(c) - F.col("black")) / span for c in RGB})
    p = grade(p, {**grades, "ccm": F.col("ccm")})
    return p if graded else display_bytes(p, transfer, gamut)


def rgba_frames(thumbs: DataFrame, keys=("frame_id",)) -> DataFrame:
    """K6: one RGBA byte string per thumbnail.

    A group holds one thumbnail, whose size is bounded by its box.
    """
    px = sum((F.col(c).cast("bigint") * (1 << shift) for c, shift in zip(RGB, (24, 16, 8))), F.lit(255).cast("bigint"))
    rows = thumbs.select(*keys, "out_w", "out_h", "ty", "tx", px.alias("_px"))
    grouped = rows.groupBy(*keys, "out_w", "out_h").agg(F.array_sort(F.collect_list(F.struct("ty", "tx", "_px"))).alias("_all"))
    packed = grouped.select(*keys, F.col("out_w").alias("w"), F.col("out_h").alias("h"), F.col("_all._px").alias("_px"))
    names = [*keys, "w", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgba = [v.values.to_numpy().astype(">u4").tobytes() for v in batch.column("_px")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(rgba, pa.binary())], names=[*names, "rgba"])

    types = dict(packed.dtypes)
    return packed.mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in names], "rgba binary"]))


def resized(images: DataFrame, out_w: Column, out_h: Column, keys=("frame_id",)) -> DataFrame:
    """Bilinear resize of RGBA images (``w``, ``h``, ``rgba`` as an int array).

    One array call per image; gives ``ty, tx, ch, v`` rows.
    """
    sized = {"out_w": out_w.cast("int"), "out_h": out_h.cast("int"), "rgba": F.col("rgba").cast("array<int>")}
    i = images.withColumns(sized).select(*keys, "w", "h", "out_w", "out_h", "rgba")
    names = [*keys, "out_w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = {c: batch.column(c).to_pylist() for c in ("w", "h", "out_w", "out_h")}
            parts = []
            for k in range(batch.num_rows):
                w, h, ow, oh = (known[c][k] for c in ("w", "h", "out_w", "out_h"))
                px = batch.column("rgba")[k].values.to_numpy(zero_copy_only=False)[: h * w * 4].reshape(h, w, 4).astype(np.float64)
                sy, sx = np.arange(oh) * float(h) / oh, np.arange(ow) * float(w) / ow
                y0, x0 = np.minimum(np.floor(sy).astype(int), h - 1), np.minimum(np.floor(sx).astype(int), w - 1)
                y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
                fy, fx = (sy - y0)[:, None, None], (sx - x0)[None, :, None]
                top = px[np.ix_(y0, x0)] + (px[np.ix_(y0, x1)] - px[np.ix_(y0, x0)]) * fx
                bottom = px[np.ix_(y1, x0)] + (px[np.ix_(y1, x1)] - px[np.ix_(y1, x0)]) * fx
                value = np.floor(top + (bottom - top) * fy + 0.5)
                parts.append(np.clip(value, 0, 255).astype(np.int32).ravel())
            sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts) if parts else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], values], names=[*names, "v"])

    types = dict(i.dtypes)
    done = i.mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in names], "v array<int>"]))
    rows = done.select(*keys, "out_w", F.posexplode("v").alias("_i", "v"))
    line = F.col("out_w") * 4
    ty, tx = F.floor(F.col("_i") / line).cast("int"), F.floor(F.col("_i") % line / 4).cast("int")
    return rows.select(*keys, ty.alias("ty"), tx.alias("tx"), (F.col("_i") % 4).alias("ch"), "v")


def histogram(pixels: DataFrame, keys=("frame_id",), bins: int = 64) -> DataFrame:
    """Counts per frame, channel and bin; only bins that occur.

    Counted on the map side, so at most 4 x bins rows per frame and task move.
    """

    def bin_of(v: Column) -> Column:
        return F.floor(clamp(F.nanvl(v, F.lit(0.0)), 0.0, 1.0) * float(bins - 1)).cast("int")

    p = pixels.select(*keys, bin_of(luma_of()).alias("luma"), *[bin_of(F.col(c)).alias(c) for c in RGB])
    long = p.unpivot(list(keys), ["luma", *RGB], "channel", "bin")
    return long.groupBy(*keys, "channel", "bin").agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(hist: DataFrame, keys=("frame_id",), bins: int = 64) -> DataFrame:
    """All bins of every channel, zeros included."""
    grid = hist.select(*keys).distinct()
    grid = grid.select("*", F.explode(F.array(*[F.lit(c) for c in ("luma", *RGB)])).alias("channel"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(hist, [*keys, "channel", "bin"], "left").fillna({"n": 0})
