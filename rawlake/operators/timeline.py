"""Clip timelines and frame order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake.operators.ordered import next_matching, ordinal, smoothed
from rawlake.session import attach


def _rate(count: Column, span_ns: Column, previous: Column) -> Column:
    rate = F.try_divide((count - 1).cast("double"), span_ns.cast("double") / 1e9)
    return F.when((count >= 2) & (span_ns > 0), rate).otherwise(previous)


def clip_timeline(frame_index: DataFrame, key: str = "clip_id", ts: str = "ts_ns") -> DataFrame:
    """A1: frame count, first timestamp and frame rate per clip."""
    n, first, last = F.count(F.lit(1)), F.min(ts), F.max(ts)
    return frame_index.groupBy(key).agg(
        n.alias("frame_count"),
        first.alias("first_ts"),
        _rate(n, last - first, F.lit(0.0)).alias("fps"),
    )


def stored_timeline(
    frame_index: DataFrame, key: str = "clip_id", ts: str = "ts_ns", position: Column | None = None
) -> DataFrame:
    """A2: the same from the first and last stored entries, without sorting."""
    position = F.col("ordinal") if position is None else position
    n = F.count(F.lit(1))
    first, last = F.min_by(ts, position), F.max_by(ts, position)
    return frame_index.groupBy(key).agg(
        n.alias("frame_count"),
        first.alias("first_ts"),
        _rate(n, last - first, F.lit(0.0)).alias("fps"),
    )


def frame_ordinals(frame_index: DataFrame, key="clip_id", order=("ts_ns", "offset"), **kw) -> DataFrame:
    """Position of every frame in time order, from 0."""
    out = ordinal(frame_index, [key], list(order), "ordinal", **kw)
    return out.withColumn("ordinal", F.col("ordinal") - 1)


def frame_gaps(frame_index: DataFrame, key="clip_id", ts="ts_ns", order=("ts_ns", "offset"), **kw) -> DataFrame:
    """Timestamp of the next frame and the gap to it."""
    out = next_matching(frame_index, [key], list(order), F.col(ts), F.lit(True), "next_ts", **kw)
    return out.withColumn("gap", F.col("next_ts") - F.col(ts))


def progress(frames: DataFrame, key="clip_id", order=("ts_ns", "offset"), **kw) -> DataFrame:
    """Written share in percent after each frame."""
    totals = frames.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    done = ordinal(frames, [key], list(order), "written", **kw)
    # frames without a clip have no total, and no share
    out = attach(done, totals, [key], "inner", spread=list(order))
    return out.withColumn("percent", F.col("written").cast("double") / F.col("total").cast("double") * 100.0)


def per_second(frames: DataFrame, key="clip_id", second: Column | None = None) -> DataFrame:
    """Frames per whole second; combined on the map side, so no group is large."""
    second = F.floor(F.col("ts_ns") / 1_000_000_000) if second is None else second
    return frames.groupBy(key, second.alias("second")).agg(F.count(F.lit(1)).alias("n"))


def smoothed_rate(rates: DataFrame, key="clip_id", keep: float = 0.9, tasks: int | None = None) -> DataFrame:
    """Exponential smoothing of the per-second rate, starting at the first value.

    The recurrence is a chain of maps y -> keep * y + (1 - keep) * n, composed within each
    range of seconds and then from range to range, so all history counts and any ``keep`` from
    0 to 1 works.
    """
    return smoothed(rates, [key], ["second"], F.col("n"), keep, "rate", tasks).select(key, "second", "n", "rate")
