"""Timelines, windows and phase timings."""

from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.operators import stats, timeline
from rawlake.queries.base import FRAME_INDEX, PHASE_EVENTS, RUNS, case_sql, frame_index, micro, micro_sql, phase_events, query, runs

RATE = "CASE WHEN count(*) >= 2 AND {span} > 0 THEN (count(*) - 1)::DOUBLE / ({span}::DOUBLE / 1e9) ELSE 0.0 END"


@query(
    "a1_clip_timeline",
    f"SELECT clip_id, count(*) AS frame_count, min(ts_ns) AS first_ts, {RATE.format(span='(max(ts_ns) - min(ts_ns))')} AS fps "
    f"FROM {FRAME_INDEX} GROUP BY clip_id",
)
def a1(spark, sf):
    return timeline.clip_timeline(frame_index(spark, sf))


A2_SPAN = '(arg_max(ts_ns, "offset") - arg_min(ts_ns, "offset"))'


@query(
    "a2_stored_timeline",
    f'SELECT clip_id, count(*) AS frame_count, arg_min(ts_ns, "offset") AS first_ts, {RATE.format(span=A2_SPAN)} AS fps '
    f"FROM {FRAME_INDEX} GROUP BY clip_id",
)
def a2(spark, sf):
    return timeline.stored_timeline(frame_index(spark, sf), position=F.col("offset"))


ORDER = 'PARTITION BY clip_id ORDER BY ts_ns, "offset"'


@query(
    "w1_frame_ordinal",
    f'SELECT clip_id, "offset", ts_ns, row_number() OVER ({ORDER}) - 1 AS ordinal FROM {FRAME_INDEX}',
)
def w1(spark, sf):
    return timeline.frame_ordinals(frame_index(spark, sf))


@query(
    "o3_sorted_timestamps",
    f"SELECT clip_id, ts_ns, row_number() OVER ({ORDER}) - 1 AS ordinal FROM {FRAME_INDEX}",
)
def o3(spark, sf):
    return timeline.frame_ordinals(frame_index(spark, sf)).select("clip_id", "ts_ns", "ordinal")


@query(
    "w2_next_frame",
    f'SELECT clip_id, "offset", coalesce(lead(ts_ns) OVER ({ORDER}), -1) AS next_ts, '
    f"coalesce(lead(ts_ns) OVER ({ORDER}) - ts_ns, -1) AS gap FROM {FRAME_INDEX}",
)
def w2(spark, sf):
    out = timeline.frame_gaps(frame_index(spark, sf))
    return out.select("clip_id", "offset", F.coalesce("next_ts", F.lit(-1)).alias("next_ts"), F.coalesce("gap", F.lit(-1)).alias("gap"))


@query(
    "w8_progress",
    f'SELECT clip_id, "offset", row_number() OVER ({ORDER}) AS written, count(*) OVER (PARTITION BY clip_id) AS total, '
    f"row_number() OVER ({ORDER})::DOUBLE / (count(*) OVER (PARTITION BY clip_id))::DOUBLE * 100.0 AS percent FROM {FRAME_INDEX}",
)
def w8(spark, sf):
    return timeline.progress(frame_index(spark, sf)).select("clip_id", "offset", "written", "total", "percent")


W10 = f"""
WITH RECURSIVE per AS (
  SELECT clip_id, ts_ns // 1000000000 AS second, count(*) AS n FROM {FRAME_INDEX} GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY second) AS k FROM per),
ema AS (
  SELECT clip_id, second, n, k, n::DOUBLE AS rate FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.clip_id, r.second, r.n, r.k, e.rate * 0.9::DOUBLE + r.n::DOUBLE * 0.1::DOUBLE
  FROM ema e JOIN ranked r ON r.clip_id = e.clip_id AND r.k = e.k + 1
)
SELECT clip_id, second, n, {micro_sql('rate')} AS rate FROM ema
"""


@query("w10_smoothed_rate", W10)
def w10(spark, sf):
    out = timeline.smoothed_rate(timeline.per_second(frame_index(spark, sf)))
    return out.withColumn("rate", micro(F.col("rate")))


SNAP = f"""
SELECT run_id, phase, count(*) AS frames, CAST((sum(ns) // count(*)) // 1000 AS BIGINT) AS avg_us, min(ns) // 1000 AS min_us,
  max(ns) // 1000 AS max_us,
  CASE WHEN count(*) > 1 THEN CAST(floor(sqrt(greatest(sum((ns // 1000) * (ns // 1000))::DOUBLE / count(*)::DOUBLE
    - ((sum(ns) // count(*)) // 1000)::DOUBLE * ((sum(ns) // count(*)) // 1000)::DOUBLE, 0.0))) AS BIGINT) ELSE 0 END AS stddev_us,
  count(*)::DOUBLE / (sum(ns)::DOUBLE / 1e9) AS fps
FROM {PHASE_EVENTS} WHERE ns > 0 GROUP BY run_id, phase
"""


@query("a3_phase_snapshot", SNAP)
def a3(spark, sf):
    return stats.phase_snapshot(phase_events(spark, sf))


@query("a3b_phase_deviation", f"SELECT run_id, phase, stddev_us FROM ({SNAP})")
def a3b(spark, sf):
    return stats.phase_snapshot(phase_events(spark, sf)).select("run_id", "phase", "stddev_us")


WALL = ", ".join(f"'{p}'" for p in vocab.WALL_PHASES)
REPORT = f"""
SELECT r.run_id, r.frames_total AS total_frames, coalesce(w.ns, 0)::DOUBLE / 1e9 AS total_wall_secs,
  CASE WHEN r.frames_total > 0 AND w.ns > 0 THEN r.frames_total::DOUBLE / (w.ns::DOUBLE / 1e9) ELSE 0.0 END AS overall_fps,
  r.gpu_frames, CASE WHEN r.frames_total > 0 THEN r.gpu_frames::DOUBLE * 100.0 / r.frames_total::DOUBLE ELSE 0.0 END AS gpu_path_pct
FROM {RUNS} r LEFT JOIN (SELECT run_id, sum(ns) AS ns FROM {PHASE_EVENTS} WHERE phase IN ({WALL}) GROUP BY 1) w USING (run_id)
"""


@query("a4_run_report", REPORT)
def a4(spark, sf):
    return stats.run_report(phase_events(spark, sf), runs(spark, sf))


@query(
    "a5_push_ring",
    f"SELECT run_id, frame_id, ns // 1000 AS us FROM {PHASE_EVENTS} WHERE phase = 'encode_push'",
)
def a5(spark, sf):
    return stats.push_ring(phase_events(spark, sf))


@query("f15_timed_samples", f"SELECT run_id, phase, count(*) AS n FROM {PHASE_EVENTS} WHERE ns % 1000 > 500 GROUP BY 1, 2")
def f15(spark, sf):
    e = phase_events(spark, sf).withColumn("ns", F.when(F.col("ns") % 1000 > 500, F.col("ns")).otherwise(F.lit(0)))
    return stats.phase_snapshot(e).select("run_id", "phase", F.col("frames").alias("n"))


POS = {p: i for i, p in enumerate(vocab.PHASES)}


@query(
    "o5_phase_order",
    f"SELECT r.run_id, p.phase, {case_sql('p.phase', POS, None)}::INTEGER AS pos, coalesce(s.frames, 0) AS frames, coalesce(s.avg_us, 0) AS avg_us "
    f"FROM {RUNS} r CROSS JOIN (SELECT unnest([{', '.join(repr(p) for p in vocab.PHASES)}]) AS phase) p "
    f"LEFT JOIN ({SNAP}) s ON s.run_id = r.run_id AND s.phase = p.phase",
)
def o5(spark, sf):
    snap = stats.phase_snapshot(phase_events(spark, sf))
    return stats.full_phases(snap, runs(spark, sf)).select("run_id", "phase", "pos", "frames", "avg_us")


@query(
    "k2_report_document",
    f"SELECT s.run_id, string_agg(p.phase || ':' || coalesce(s2.frames, 0) || ':' || coalesce(s2.max_us, 0), ',' ORDER BY "
    f"{case_sql('p.phase', POS, None)}) AS phases FROM {RUNS} s CROSS JOIN (SELECT unnest([{', '.join(repr(p) for p in vocab.PHASES)}]) AS phase) p "
    f"LEFT JOIN ({SNAP}) s2 ON s2.run_id = s.run_id AND s2.phase = p.phase GROUP BY s.run_id",
)
def k2(spark, sf):
    docs = stats.report_documents(phase_events(spark, sf), runs(spark, sf))
    line = F.transform(
        "phases",
        lambda e: F.concat_ws(
            ":", e["name"], e["snapshot"]["frames"].cast("string"), e["snapshot"]["max_us"].cast("string")
        ),
    )
    return docs.select("run_id", F.array_join(line, ",").alias("phases"))


@query(
    "a12_export_rate",
    "SELECT o_orderpriority AS codec, count(*) AS runs, CAST(sum(o_custkey) AS BIGINT) AS frames, "
    "CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS elapsed_ms, sum(o_custkey)::DOUBLE / (sum(CAST(floor(o_totalprice) AS BIGINT))::DOUBLE / 1000.0) AS avg_fps "
    "FROM orders GROUP BY 1",
)
def a12(spark, sf):
    from rawlake.queries.base import table

    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("codec"),
        F.col("o_custkey").alias("frame_count"),
        F.floor("o_totalprice").alias("elapsed_ms"),
    )
    return stats.export_rates(o)
