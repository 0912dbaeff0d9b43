"""Lens-grid gains.

A grid is an array of four channels, each a flat array of gains, row by row,
with ``grid_w`` and ``grid_h``. It belongs to a clip and is attached to its
tiles, never to single pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions.numeric import clamp


def colour_only(grid: Column) -> Column:
    """A10: every node divided by the least gain of the four channels there."""
    nodes = F.arrays_zip(*[F.get(grid, c).alias(f"c{c}") for c in range(4)])

    def scaled(channel: int) -> Column:
        def one(node: Column) -> Column:
            low = F.least(*[node[f"c{c}"] for c in range(4)])
            return F.when(low > 0, F.try_divide(node[f"c{channel}"], low)).otherwise(F.lit(1.0))

        return F.transform(nodes, one)

    return F.array(*[scaled(c) for c in range(4)])


def grid_nodes(grids: DataFrame, key: str = "clip_id", grid: str = "lens_grid") -> DataFrame:
    """Long form of a grid: ``ch, gy, gx, gain``."""
    channels = grids.select(key, "grid_w", F.posexplode(grid).alias("ch", "_c"))
    nodes = channels.select(key, "grid_w", "ch", F.posexplode("_c").alias("_i", "gain"))
    gy = F.floor(F.col("_i") / F.col("grid_w")).cast("int")
    return nodes.select(key, "ch", gy.alias("gy"), (F.col("_i") % F.col("grid_w")).alias("gx"), "gain")


def blend(values: Column, grid_w: Column, grid_h: Column, u: Column, v: Column) -> Column:
    """Bilinear value of a flat channel at (u, v) in 0..1."""
    fx = F.least(F.greatest(u * (grid_w - 1), F.lit(0.0)), (grid_w - 1).cast("double"))
    fy = F.least(F.greatest(v * (grid_h - 1), F.lit(0.0)), (grid_h - 1).cast("double"))
    ix, iy = F.floor(fx).cast("int"), F.floor(fy).cast("int")
    dx, dy = fx - ix, fy - iy
    right, low = F.least(ix + 1, grid_w - 1), F.least(iy + 1, grid_h - 1)

    def node(yy: Column, xx: Column) -> Column:
        return F.get(values, yy * grid_w + xx).cast("double")

    top = node(iy, ix) + (node(iy, right) - node(iy, ix)) * dx
    bottom = node(low, ix) + (node(low, right) - node(low, ix)) * dx
    return top + (bottom - top) * dy


def _channel_of(ys: np.ndarray, xs: np.ndarray, pattern: str) -> np.ndarray:
    cfa = np.array(vocab.CFA.get(pattern, vocab.CFA["RGGB"])).reshape(2, 2)
    color = cfa[np.ix_(ys & 1, xs & 1)]
    green = np.where((ys & 1) == 0, 1, 2)[:, None]
    return np.where(color == 0, 0, np.where(color == 2, 3, green))


def _gains(grid: np.ndarray, gw: int, gh: int, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Bilinear gains of all four channels at rows ``v`` and columns ``u``."""
    fx, fy = np.clip(u * (gw - 1), 0, gw - 1), np.clip(v * (gh - 1), 0, gh - 1)
    ix, iy = fx.astype(int), fy.astype(int)
    dx, dy = (fx - ix)[None, None, :], (fy - iy)[None, :, None]
    nodes = grid.reshape(4, gh, gw)
    right, low = np.minimum(ix + 1, gw - 1), np.minimum(iy + 1, gh - 1)
    top = nodes[:, iy][:, :, ix] + (nodes[:, iy][:, :, right] - nodes[:, iy][:, :, ix]) * dx
    bottom = nodes[:, low][:, :, ix] + (nodes[:, low][:, :, right] - nodes[:, low][:, :, ix]) * dx
    return top + (bottom - top) * dy


def correction(tiles: DataFrame, levels: bool = True, grid: str = "lens_grid"):
    """What :func:`correct_tiles` does, for use within a longer Python step: (columns it keeps, function of batches)."""
    used = [grid, "grid_w", "grid_h", "sensor_w", "sensor_h"]
    rest = [c for c in tiles.columns if c not in (*used, "px")]
    need = ["oy", "ox", "oh", "ow", "crop_y", "crop_x", "pattern", "out_white", "grid_w", "grid_h", "sensor_w", "sensor_h"]
    need += ["src_black", "src_white"] if levels else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eps = float(np.finfo(np.float32).eps)
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            planes = []
            fields = {n: cols[n].to_pylist() for n in need}
            for i in range(batch.num_rows):
                px = cols["px"][i].values.to_numpy(zero_copy_only=False)
                if not cols[grid][i].is_valid:
                    planes.append(px.astype(np.int32))
                    continue
                t = {n: v[i] for n, v in fields.items()}
                nodes = cols[grid][i].values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ys, xs = np.arange(t["oy"], t["oy"] + t["oh"]), np.arange(t["ox"], t["ox"] + t["ow"])
                v, u = (ys + t["crop_y"]) / t["sensor_h"], (xs + t["crop_x"]) / t["sensor_w"]
                gains = _gains(nodes, t["grid_w"], t["grid_h"], v, u)
                ch = _channel_of(ys, xs, t["pattern"])
                gain = np.take_along_axis(gains, ch[None], axis=0)[0]
                value = px.reshape(len(ys), len(xs)).astype(np.float64)
                if levels:
                    r, g, b = t["src_black"]
                    black = np.array([r, g, g, b])[ch]
                    value = (value - black) / np.maximum(t["src_white"] - black, eps) * gain * t["out_white"]
                else:
                    value = value * gain
                rounded = np.floor(np.maximum(value, 0.0) + 0.5)
                planes.append(np.minimum(rounded, t["out_white"]).astype(np.int32).ravel())
            sizes = np.cumsum([0] + [len(p) for p in planes]).astype(np.int32)
            values = np.concatenate(planes) if planes else np.empty(0, np.int32)
            arrays = [cols[n] for n in rest]
            arrays.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(values, pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "px"])

    return rest, run


def correct_tiles(tiles: DataFrame, levels: bool = True, grid: str = "lens_grid") -> DataFrame:
    """P3 (``levels``) or P4: correct the stored pixels of every tile.

    Tiles carry ``pattern``, the grid and its size, ``crop_x``/``crop_y`` and
    ``sensor_w``/``sensor_h``. P3 also needs ``src_black`` (r, g, b),
    ``src_white`` and ``out_white`` and rescales to ``out_white``; P4 multiplies
    and clamps to ``out_white``. Tiles without a grid pass unchanged. The grid
    columns are dropped.
    """
    rest, run = correction(tiles, levels, grid)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema.fields if f.name in rest)
    return tiles.select(*rest, grid, "grid_w", "grid_h", "sensor_w", "sensor_h", "px").mapInArrow(run, f"{fields}, px array<int>")


def corrected(value: Column, gain: Column, black: Column, white: Column, out_white: Column) -> Column:
    """P3 on one pixel value: scale to the levels, apply the gain, round half up."""
    span = F.greatest(white - black, F.lit(1.1920928955078125e-07))
    scaled = (value - black) / span * gain * out_white
    return clamp(F.floor(F.greatest(scaled, F.lit(0.0)) + 0.5), 0, 65535)
