"""Archive-size estimate and byte sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions.numeric import bit_length
from rawlake.operators.tiles import GEOMETRY, over_tiles


def left_difference(pixels: DataFrame, frame: str = "frame_id", value: str = "v") -> DataFrame:
    """Difference to the left neighbour; the first pixel of a row keeps its value.

    For long pixel tables. A window holds one row of one frame.
    """
    row = W.partitionBy(frame, "y").orderBy("x")
    return pixels.withColumn("diff", F.col(value) - F.lag(value, 1, 0).over(row))


def _differences(px: np.ndarray, t: dict) -> np.ndarray:
    """Differences of the covered area, row by row."""
    store = px.reshape(t["oh"], t["ow"])[t["y0"] - t["oy"] : t["y0"] - t["oy"] + t["h"]].astype(np.int64)
    left = t["x0"] - t["ox"]
    here = store[:, left : left + t["w"]]
    if t["x0"] == 0:
        before = np.hstack([np.zeros((t["h"], 1), dtype=np.int64), here[:, :-1]])
    elif left > 0:
        before = store[:, left - 1 : left - 1 + t["w"]]
    else:
        raise ValueError("tiles need a halo of one pixel")
    return (here - before).ravel()


def tile_differences(tiles: DataFrame) -> DataFrame:
    """W3 on tiles: the left neighbour is in the same row of data, so nothing moves."""
    keep = [c for c in ("clip_id", "frame_id") if c in tiles.columns]
    diffs = over_tiles(tiles, lambda px, t: (_differences(px, t).astype(np.int32),), GEOMETRY, [], {"diff": pa.list_(pa.int32())}, "diff array<int>")
    rows = diffs.select(*keep, "y0", "x0", "w", F.posexplode("diff").alias("_i", "diff"))
    y = F.col("y0") + F.floor(F.col("_i") / F.col("w")).cast("int")
    return rows.select(*keep, y.alias("y"), (F.col("x0") + F.col("_i") % F.col("w")).alias("x"), "diff")


def _bits(px: np.ndarray, t: dict) -> tuple[int, int]:
    # the exponent of a number is its length in bits
    category = np.frexp(np.abs(_differences(px, t)).astype(np.float64))[1]
    return len(category), int((np.array(vocab.CODE_LENGTH)[category] + category).sum())


def compressed_tiles(tiles: DataFrame, keys=("frame_id",)) -> DataFrame:
    """A13 on tiles: pixels and bits are added up within a tile, so a row per tile is what moves."""
    counted = over_tiles(tiles, _bits, GEOMETRY, [], {"pixels": pa.int64(), "bits": pa.int64()}, "pixels bigint, bits bigint")
    bits = F.sum("bits")
    return counted.groupBy(*keys).agg(F.sum("pixels").alias("pixels"), bits.alias("bits"), F.ceil(bits / 8).cast("bigint").alias("bytes"))


def code_bits(diff: Column) -> Column:
    """Bits of one difference: code of its size category plus that many extra bits."""
    category = bit_length(F.abs(diff).cast("bigint"))
    lengths = F.array(*[F.lit(b) for b in vocab.CODE_LENGTH])
    return F.get(lengths, category) + category


def compressed_size(differences: DataFrame, keys=("frame_id",)) -> DataFrame:
    """Estimated bits and bytes of lossless predictive coding."""
    bits = F.sum(code_bits(F.col("diff")).cast("bigint"))
    return differences.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"), bits.alias("bits"), F.ceil(bits / 8).cast("bigint").alias("bytes")
    )


def frame_bytes(tiles: DataFrame, keys=("frame_id",)) -> DataFrame:
    """Raw bytes per frame; halos are not counted twice."""
    area = F.col("h").cast("bigint") * F.col("w")
    return tiles.groupBy(*keys).agg(F.sum(area * 2).alias("raw_bytes"))
