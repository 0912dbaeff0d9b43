"""Per-clip and per-frame parameters: matrices, levels, gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import matrix as mx
from rawlake.functions import numeric
from rawlake.session import attach


def dim_gamut(spark: SparkSession) -> DataFrame:
    """M2: XYZ to RGB matrix of every gamut, from its primaries."""
    built = F.expr(mx.xyz_to_rgb(["xr", "yr", "xg", "yg", "xb", "yb"], ["xw", "yw"]))
    fixed = F.col("name").isin(*vocab.FIXED_MATRIX_GAMUTS)
    matrix = F.when(fixed, F.expr(mx.constant(vocab.XYZ_TO_REC709))).otherwise(built)
    return vocab.dim_primaries(spark).withColumn("xyz_to_rgb", matrix)


def illuminant_code(name: Column) -> Column:
    """M9: code of a light-source name, null for an unknown one."""
    return vocab.lookup(F.lower(F.trim(name)), vocab.ILLUMINANT)


def camera_matrix(clips: DataFrame, calibration: tuple[str, ...] = ("calibration_matrix1", "calibration_matrix2")) -> DataFrame:
    """M5: add ``matrix_path`` and ``cam_to_xyz``.

    Two forward matrices are averaged, one is used as it is; either is
    re-oriented when its white is far from D50. Without one, the colour matrix
    (averaged with the second) is oriented and multiplied by a calibration.
    """
    cm1 = f"coalesce(color_matrix, {mx.constant(mx.IDENTITY)})"
    plausible = "exists(_cm1, v -> abs(v) > 0.01D AND abs(v) < 10D)"
    out = clips.withColumn("_cm1", F.expr(cm1)).withColumns(
        {
            "_path": F.expr(
                "CASE WHEN forward_matrix1 IS NOT NULL AND forward_matrix2 IS NOT NULL THEN 'forward_mean' "
                f"WHEN forward_matrix1 IS NOT NULL THEN 'forward' WHEN {plausible} THEN 'color' ELSE 'identity' END"
            ),
            "_base": F.expr(
                "CASE WHEN forward_matrix1 IS NOT NULL AND forward_matrix2 IS NOT NULL "
                f"THEN {mx.mean_of('forward_matrix1', 'forward_matrix2')} WHEN forward_matrix1 IS NOT NULL THEN forward_matrix1 "
                f"WHEN {plausible} THEN CASE WHEN color_matrix2 IS NOT NULL THEN {mx.mean_of('_cm1', 'color_matrix2')} ELSE _cm1 END "
                f"ELSE {mx.constant(mx.IDENTITY)} END"
            ),
            "_cal": F.coalesce(*[F.col(c) for c in calibration]),
        }
    )
    out = out.withColumn("_turned", F.expr(f"_path LIKE 'forward%' AND NOT {mx.white_distance('_base')} < 0.05D"))
    out = out.withColumns(
        {
            "matrix_path": F.expr("CASE WHEN _turned THEN concat(_path, '_oriented') ELSE _path END"),
            "_cam": F.expr(f"CASE WHEN _turned OR _path = 'color' THEN {mx.oriented('_base')} ELSE _base END"),
        }
    )
    calibrated = f"CASE WHEN _path = 'color' AND _cal IS NOT NULL THEN {mx.product('_cam', '_cal')} ELSE _cam END"
    return out.withColumn("cam_to_xyz", F.expr(calibrated)).drop("_cm1", "_path", "_base", "_cal", "_turned", "_cam")


def reference_white(path: str = "matrix_path", cam_to_xyz: str = "cam_to_xyz") -> str:
    """M6: D50 for forward matrices, else the row sums if they are plausible."""

    def choose(s: str) -> str:
        top = f"greatest({s}[0], {s}[1], {s}[2])"
        return f"CASE WHEN {path} LIKE 'forward%' OR {top} < 0.1D OR {top} > 5D THEN {mx.constant(vocab.D50)} ELSE {s} END"

    return mx.let(mx.row_sums(cam_to_xyz), choose)


def fused(xyz_to_rgb: str, white: str, cam_to_xyz: str) -> str:
    """M7: camera to output RGB through an adaptation to D65."""
    return mx.product(xyz_to_rgb, mx.product(mx.bradford(white), cam_to_xyz))


def static_levels(levels: Column, count: Column) -> Column:
    """Black level (r, g, b) of a clip."""
    four = count >= 4
    return F.array(
        F.get(levels, 0),
        F.when(four, (F.get(levels, 1) + F.get(levels, 2)) / 2.0).otherwise(F.get(levels, 0)),
        F.when(four, F.get(levels, 3)).otherwise(F.get(levels, 0)),
    )


def dynamic_levels(levels: Column) -> Column:
    """Black level (r, g, b) of a frame's own four values."""
    g1, g2 = F.get(levels, 1), F.get(levels, 2)
    green = F.when((g1 > 0) & (g2 > 0), (g1 + g2) / 2.0).otherwise(F.greatest(g1, g2))
    return F.array(F.get(levels, 0), green, F.get(levels, 3))


def source_levels(mode: str, static: Column, white: Column, dyn_black: Column, dyn_white: Column) -> list[Column]:
    """Black (r, g, b) and white level of a level mode."""
    preset = {name: (b, w) for name, b, w in vocab.LEVEL_PRESET}[mode]
    if preset[0] is not None:
        return [F.expr(mx.constant([preset[0]] * 3)), F.lit(preset[1])]
    if mode == "Static":
        return [static, white]
    own = dyn_black.isNotNull()
    return [
        F.when(own, dynamic_levels(dyn_black)).otherwise(static),
        F.when(own, F.coalesce(dyn_white, white)).otherwise(white),
    ]


def _placement(columns: list[str]) -> dict[str, str]:
    """Crop offset and sensor size; without a sensor size, the frame and its offset."""
    if "active_offset_x" not in columns:
        return {}
    return {
        "crop_x": "active_offset_x",
        "crop_y": "active_offset_y",
        "sensor_w": "CASE WHEN sensor_width > 0 THEN sensor_width ELSE width + active_offset_x END",
        "sensor_h": "CASE WHEN sensor_height > 0 THEN sensor_height ELSE height + active_offset_y END",
    }


def clip_params(clips: DataFrame, gamut: str | None = None) -> DataFrame:
    """One row per clip with its fused matrix, levels and crop.

    ``gamut`` fixes the output gamut; otherwise the clips' ``gamut`` column is used.
    """
    spark = clips.sparkSession
    named = clips.withColumn("gamut", F.lit(gamut)) if gamut else clips
    # 16 rows, fixed
    dim = F.broadcast(dim_gamut(spark).select(F.col("name").alias("gamut"), "xyz_to_rgb"))
    # clips of an unknown gamut stay, without a fused matrix
    out = camera_matrix(named).join(dim, "gamut", "left")
    return out.withColumns(
        {
            "fused": F.when(F.col("xyz_to_rgb").isNotNull(), F.expr(fused("xyz_to_rgb", reference_white(), "cam_to_xyz"))),
            "black_rgb": static_levels(F.col("black_levels"), F.col("black_level_count")),
            "crop_w": numeric.active_size(F.col("active_width"), F.col("width")),
            "crop_h": numeric.active_size(F.col("active_height"), F.col("height")),
            **{name: F.expr(text) for name, text in _placement(out.columns).items()},
        }
    )


def scene_white(cam_to_xyz: str = "cam_to_xyz", neutral: str = "neutral") -> str:
    """M8: white of a frame from its neutral, each part within 0.3..3."""
    usable = " AND ".join(f"{neutral}[{i}] > 1e-6D" for i in range(3))
    own = f"transform({mx.apply(cam_to_xyz, neutral)}, c -> least(greatest(c, 0.3D), 3D))"
    return f"CASE WHEN {usable} THEN {own} ELSE {mx.constant(vocab.D65)} END"


def frame_params(params: DataFrame, frame_meta: DataFrame, mode: str = "Dynamic", spread=("frame_id",)) -> DataFrame:
    """One row per frame with its fused matrix, levels and gains.

    Only colour-matrix clips with a neutral away from 1 get a matrix per frame;
    the others keep the one computed for the clip.
    """
    wanted = ["clip_id", "matrix_path", "cam_to_xyz", "xyz_to_rgb", "fused", "black_rgb", "white_level"]
    extra = [c for c in params.columns if c not in wanted and c not in frame_meta.columns]
    j = attach(frame_meta, params.select(*wanted, *extra), ["clip_id"], "inner", spread=list(spread))
    n = [F.get("neutral", i) for i in range(3)]
    flat = (F.abs(n[0] - 1.0) < 1e-3) & (F.abs(n[1] - 1.0) < 1e-3) & (F.abs(n[2] - 1.0) < 1e-3)
    per_frame = F.col("matrix_path").startswith("color") & ~flat
    own = F.expr(fused("xyz_to_rgb", scene_white(), "cam_to_xyz"))
    black, white = source_levels(
        mode, F.col("black_rgb"), F.col("white_level"), F.col("dynamic_black"), F.col("dynamic_white")
    )
    return j.withColumns(
        {
            "fused": F.when(per_frame, own).otherwise(F.col("fused")),
            "src_black": black,
            "src_white": white,
            "gain_r": numeric.wb_gain_clamped(n[1], n[0]),
            "gain_b": numeric.wb_gain_clamped(n[1], n[2]),
        }
    )


def preview_matrix(clips: DataFrame) -> DataFrame:
    """M5 twin: camera to Rec.709 for previews; only the first calibration counts."""
    out = camera_matrix(clips, ("calibration_matrix1",))
    return out.withColumn("ccm", F.expr(fused(mx.constant(vocab.XYZ_TO_REC709), reference_white(), "cam_to_xyz")))
