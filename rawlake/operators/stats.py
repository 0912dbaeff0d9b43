"""Phase timings and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake import vocab


def whole(num: Column, den: Column | int) -> Column:
    """Whole-number quotient, never passing through doubles."""
    return F.call_function("div", num, den if isinstance(den, Column) else F.lit(den))


def _fps(frames: Column, total_ns: Column) -> Column:
    seconds = total_ns.cast("double") / 1e9
    return F.when(total_ns > 0, F.try_divide(frames.cast("double"), seconds)).otherwise(F.lit(0.0))


def phase_snapshot(phase_events: DataFrame, keys=("run_id", "phase"), ns: str = "ns") -> DataFrame:
    """Count, mean, extremes, deviation and rate per phase.

    All microsecond values are truncated step by step, and the deviation is the
    population form over truncated microseconds. Zero samples are ignored (F15).
    """
    timed = phase_events.where(F.col(ns) > 0).withColumn("_us", whole(F.col(ns), 1000))
    sums = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum(ns).alias("_total"),
        F.min(ns).alias("_min"),
        F.max(ns).alias("_max"),
        F.sum(F.col("_us").cast("decimal(38,0)") * F.col("_us").cast("decimal(38,0)")).alias("_squares"),
    )
    avg_us = whole(whole(F.col("_total"), F.col("frames")), 1000)
    spread = F.col("_squares").cast("double") / F.col("frames").cast("double") - avg_us.cast("double") * avg_us.cast(
        "double"
    )
    deviation = F.when(F.col("frames") > 1, F.floor(F.sqrt(F.greatest(spread, F.lit(0.0))))).otherwise(F.lit(0))
    return sums.select(
        *keys,
        "frames",
        avg_us.alias("avg_us"),
        whole(F.col("_min"), 1000).alias("min_us"),
        whole(F.col("_max"), 1000).alias("max_us"),
        deviation.cast("bigint").alias("stddev_us"),
        _fps(F.col("frames"), F.col("_total")).alias("fps"),
    )


def run_report(phase_events: DataFrame, runs: DataFrame, key: str = "run_id", ns: str = "ns") -> DataFrame:
    """A4: wall time, overall rate and accelerated share per run.

    ``runs`` has one row per run with ``frames_total`` and ``gpu_frames``. Only
    four phases count as wall time.
    """
    wall = F.sum(F.when(F.col("phase").isin(*vocab.WALL_PHASES), F.col(ns)).otherwise(F.lit(0)))
    timed = phase_events.groupBy(key).agg(wall.alias("wall_ns"))
    joined = runs.join(timed, key, "left").withColumn("wall_ns", F.coalesce("wall_ns", F.lit(0)))
    frames = F.col("frames_total").cast("double")
    return joined.select(
        key,
        F.col("frames_total").alias("total_frames"),
        (F.col("wall_ns").cast("double") / 1e9).alias("total_wall_secs"),
        F.when(F.col("frames_total") > 0, _fps(F.col("frames_total"), F.col("wall_ns")))
        .otherwise(F.lit(0.0))
        .alias("overall_fps"),
        F.col("gpu_frames"),
        F.when(F.col("frames_total") > 0, F.try_divide(F.col("gpu_frames").cast("double") * 100.0, frames))
        .otherwise(F.lit(0.0))
        .alias("gpu_path_pct"),
    )


def push_ring(phase_events: DataFrame, keys=("run_id",), phase: str = "encode_push", ns: str = "ns") -> DataFrame:
    """A5: one row per pushed frame with its time in microseconds.

    The list stays exploded: a run may have any number of frames.
    """
    pushed = phase_events.where(F.col("phase") == phase)
    return pushed.select(*keys, "frame_id", whole(F.col(ns), 1000).alias("us"))


def full_phases(snapshot: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Every phase of every run with its place in the report, and zeros where nothing ran."""
    listed = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(p).alias("phase")) for i, p in enumerate(vocab.PHASES)])
    grid = runs.select(key).distinct().select(key, F.inline(listed))
    out = grid.join(snapshot, [key, "phase"], "left")
    filled = {c: 0 for c in ("frames", "avg_us", "min_us", "max_us", "stddev_us")}
    return out.fillna({**filled, "fps": 0.0})


def report_documents(phase_events: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """K2: one nested report per run.

    ``encode_push_per_frame_us`` is not a list in it, as a run may have any number of
    frames: :func:`push_ring` is that list as a table of rows beside the reports.
    """
    report = run_report(phase_events, runs, key)
    phases = full_phases(phase_snapshot(phase_events, (key, "phase")), runs, key)
    entry = F.struct(
        "pos", "phase", F.struct("frames", "avg_us", "min_us", "max_us", "stddev_us", "fps").alias("snapshot")
    )
    listed = phases.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    listed = listed.select(
        key,
        F.transform("_p", lambda e: F.struct(e["phase"].alias("name"), e["snapshot"].alias("snapshot"))).alias("phases"),
    )
    return report.join(listed, key, "left")


def export_rates(export_runs: DataFrame, by: str = "codec") -> DataFrame:
    """Average rate per run and rolled up per codec."""
    n = F.sum("frame_count")
    total = F.sum("elapsed_ms")
    rate = F.when((total > 0) & (n > 0), F.try_divide(n.cast("double"), total.cast("double") / 1000.0))
    return export_runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"), n.alias("frames"), total.alias("elapsed_ms"),
        rate.otherwise(F.lit(0.0)).alias("avg_fps"),
    )


def export_rate(frames: Column, elapsed_ms: Column) -> Column:
    """Average rate of one run."""
    rate = F.try_divide(frames.cast("double"), elapsed_ms.cast("double") / 1000.0)
    return F.when((elapsed_ms > 0) & (frames > 0), rate).otherwise(F.lit(0.0))
