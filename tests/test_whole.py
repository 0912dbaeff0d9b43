"""Nothing vanishes silently, readers are spread, and tiles of any size give the same pixels."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rawlake.functions import curves
from rawlake.operators import develop, params, tiles
from rawlake.plans import export
from rawlake.queries import mosaic
from rawlake.session import dealt, small_table, tasks_for
from rawlake.sources import containers, dumps


def test_a_run_needs_one_preset(spark):
    clips = small_table(spark, [(1,), (2,)], "clip_id int")
    presets = small_table(spark, [("Rec.709",), ("sRGB",)], "color_space string")
    with pytest.raises(ValueError):
        export.apply_presets(clips, presets)
    with pytest.raises(ValueError):
        export.apply_presets(clips, presets.limit(0))
    assert {r.color_space for r in export.apply_presets(clips, presets.where("color_space = 'sRGB'")).collect()} == {"sRGB"}


def test_clips_of_a_batch_without_preset_stay(spark):
    clips = small_table(spark, [(1, 1), (2, 9), (3, None)], "clip_id int, batch int")
    presets = small_table(spark, [(1, "sRGB")], "batch int, color_space string")
    got = {r.clip_id: r.color_space for r in export.apply_presets(clips, presets, ["batch"]).collect()}
    assert got == {1: "sRGB", 2: None, 3: None}


def test_clips_of_an_unknown_gamut_stay(spark, sf):
    from rawlake.queries.base import clip_matrices

    clips = clip_matrices(spark, sf).withColumn("gamut", F.when(F.col("clip_id") % 2 == 0, "no such gamut").otherwise(F.col("gamut")))
    out = params.clip_params(clips)
    assert out.count() == clips.count()
    assert out.where("gamut = 'no such gamut' AND fused IS NOT NULL").count() == 0


def test_pixels_of_an_unknown_curve_stay(spark):
    px = small_table(spark, [(1, 0.5, 0.5, 0.5), (2, 0.5, 0.5, 0.5), (3, 0.5, 0.5, 0.5)], "clip_id int, r double, g double, b double")
    of = small_table(spark, [(1, "Linear"), (2, "Unheard")], "clip_id int, transfer string")
    assert {r.clip_id: r.r for r in curves.encode_by_params(px, of).collect()} == {1: 0.5, 2: None, 3: None}


def test_broken_dumps_are_named(spark, tmp_path):
    path = tmp_path / "a.raw"
    path.write_bytes(bytes(2 * 12 + 5))
    files = small_table(spark, [("a", str(path), 29, 3, 4)], "clip_id string, path string, length bigint, frame_w int, frame_h int")
    assert [tuple(r[c] for c in ("frames", "bytes_over")) for r in dumps.broken_dumps(files).collect()] == [(1, 5)]
    with pytest.raises(Exception, match="within a frame"):
        dumps.read_raw16(spark, files).collect()


def test_failed_reads_are_not_rows(monkeypatch, tmp_path):
    assert "FileNotFoundError" in containers.read_clip(str(tmp_path / "none"))["error"]

    def throttled(path):
        raise OSError("slow down")

    monkeypatch.setattr(containers, "open_clip", throttled)
    with pytest.raises(OSError):
        containers.read_clip("a")


def test_descriptors_are_dealt_over_tasks(spark):
    rows = spark.range(1500).select(F.col("id").cast("string").alias("path"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    few = tasks_for(rows, F.lit(10))
    many = tasks_for(rows, F.lit(10 << 20))
    assert few == spark.sparkContext.defaultParallelism and many > 100
    ran = dealt(rows, 16).select(F.spark_partition_id().alias("p")).distinct().count()
    assert ran == 16


def settings(spark, sf):
    p = mosaic.frame_params(spark, sf)
    k = F.col("frame_id")
    return p.withColumns(
        {
            "curve": F.when(k % 3 == 0, "S-Log3").when(k % 3 == 1, "Rec.709").otherwise("no curve"),
            "how": F.when(k % 2 == 0, "bilinear").otherwise("edges"),
        }
    )


def test_settings_per_frame(spark, sf):
    tiled = tiles.cut_tiles(mosaic.mosaics(spark, sf), 8, 8, tiles.EDGE_HALO)
    p = settings(spark, sf).where(F.col("frame_id") % 10 != 0)
    got = develop.develop_tiles(tiled, p, F.col("curve"), method=F.col("how"))
    rows = {r.frame_id: r.rgb16 for r in got.select("frame_id", "rgb16").collect()}
    assert len(rows) == tiled.count()
    for frame, packed in rows.items():
        known = frame % 10 != 0 and frame % 3 != 2
        assert (packed is not None) == known
        assert packed is None or len(packed) == 8 * 8 * 6
    alone = develop.develop_tiles(tiled, p, "S-Log3", method="edges").where("frame_id % 3 = 0 AND frame_id % 2 = 1")
    assert all(rows[r.frame_id] == r.rgb16 for r in alone.collect() if r.frame_id % 10)


def test_array_curves_equal_column_curves(spark):
    values = [-0.2, -0.01, 0.0, 0.001, 0.01, 0.0106, 0.02, 0.18, 0.5, 0.95, 1.0, 1.7, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for name, curve in curves.ENCODE.items():
        want = [r.y for r in df.select(curve(F.col("x")).alias("y")).collect()]
        got = curves.encode_array(name, np.array(values))
        for a, b in zip(want, got, strict=True):
            assert a == pytest.approx(float(b), rel=1e-12) or (a != a and b != b) or (a is None and not np.isfinite(b))


def test_cost_per_pixel_does_not_grow_with_the_tile(spark):
    n = 1024
    frames = spark.range(4, numPartitions=4).select(
        F.col("id").alias("frame_id"), F.lit("RGGB").alias("pattern"), F.lit(n).alias("frame_w"), F.lit(n).alias("frame_h"),
        F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda v: v % 16384).alias("px"),
    )

    def seconds(h: int, w: int) -> float:
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            planes = tiles._planes(tiles.cut_tiles(frames, h, w, 2), tiles.export_planes_of, "pattern")
            assert planes.agg(F.sum(F.size("r"))).first()[0] == 4 * n * n
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(256, 1024) < 2.5 * seconds(64, 64) + 1
    seconds(16, 32)
