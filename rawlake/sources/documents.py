"""JSON documents: presets, reports, grade sidecars."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import text
from rawlake.operators.catalog import valid_presets
from rawlake.session import attach

PRESET_FIELDS = [
    "name", "color_space", "transfer_function", "codec_family", "prores_profile", "dnxhr_profile", "hevc_profile",
    "h264_profile", "av1_profile", "vp9_profile", "rate_control", "export_folder",
]
PRESET_FILE = f"schema_version bigint, presets array<struct<{', '.join(f'{n}: string' for n in PRESET_FIELDS)}>>"
PRESETS_VERSION = 1

SNAPSHOT = "frames: bigint, avg_us: bigint, min_us: bigint, max_us: bigint, stddev_us: bigint, fps: double"
REPORT = (
    "run_id string, total_frames bigint, total_wall_secs double, overall_fps double, gpu_frames bigint, "
    f"gpu_path_pct double, phases array<struct<name: string, snapshot: struct<{SNAPSHOT}>>>, "
    "encode_push_per_frame_us array<struct<frame_id: bigint, us: bigint>>"
)


def _json(spark: SparkSession, path: str, schema: str, whole: bool) -> DataFrame:
    """Documents of a path with their ``_path``; a missing path gives no rows,
    a bad document a null row."""
    reader = spark.read.schema(schema).option("multiLine", str(whole).lower()).option("mode", "PERMISSIVE")
    try:
        docs = reader.json(path)
        return docs.withColumn("_path", F.col("_metadata.file_path"))
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        none = spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("d"), F.lit("").alias("_path"))
        return none.select("d.*", "_path")


def presets_of(documents: DataFrame) -> DataFrame:
    """Valid presets of parsed preset documents; the required fields must be there."""
    listed = documents.select(F.posexplode("presets").alias("pos", "p")).select("pos", "p.*")
    required = ["name", "color_space", "transfer_function", "codec_family", "rate_control"]
    return valid_presets(listed.dropna(subset=required))


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """Presets of JSON files; missing or corrupt files give none."""
    return presets_of(_json(spark, path, PRESET_FILE, True))


def preset_documents(presets: DataFrame, group: list[str] | None = None) -> DataFrame:
    """K3: one document per preset list. A list is one user's saved presets."""
    entry = F.struct(*PRESET_FIELDS)
    listed = F.array_sort(F.collect_list(F.struct(F.col("pos"), entry.alias("p")))).alias("_l")
    out = presets.groupBy(*(group or [])).agg(listed)
    return out.select(
        *(group or []),
        F.lit(PRESETS_VERSION).alias("schema_version"),
        F.transform("_l", lambda e: e["p"]).alias("presets"),
    )


def write_presets(presets: DataFrame, path: str) -> None:
    """K3: replace the stored list."""
    preset_documents(presets).write.mode("overwrite").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """K2: one JSON document per run."""
    reports.write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports; the per-frame list is optional."""
    return _json(spark, path, REPORT, False).drop("_path")


def _kind(value) -> str:
    return {bool: "boolean", int: "int", float: "double"}[type(value)]


SIDECAR = {name: _kind(value) for name, value in vocab.SIDECAR_DEFAULT.items()}


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Grade sidecars; the clip is the file's name without its last extension."""
    schema = ", ".join(f"{name} {kind}" for name, kind in SIDECAR.items())
    docs = _json(spark, path, schema, True)
    named = docs.withColumn("clip_id", text.file_stem(F.col("_path")))
    return named.select("clip_id", *SIDECAR)


def with_sidecars(clips: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Every clip with its grade, or the grade that changes nothing.

    The fields are carried only; there is no maths behind them.
    """
    own = sidecars.select("clip_id", *[F.col(n).alias(f"_{n}") for n in vocab.SIDECAR_DEFAULT])
    j = attach(clips, own, ["clip_id"], "left", spread=[c for c in clips.columns if c != "clip_id"] or None)
    return j.select(
        *clips.columns,
        *[F.coalesce(F.col(f"_{n}"), F.lit(v).cast(SIDECAR[n])).alias(n) for n, v in vocab.SIDECAR_DEFAULT.items()],
    )
