"""Streaming forms, run over the given tables to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.queries.base import IMPORTS, epoch_micros, micro, micro_sql, pick, query
from rawlake.queries.catalog import EVENTS, KINDS
from rawlake.queries.sources import CLIP_EVENTS, CLIP_FOLDERS, LEGACY, clip_folder, clip_number, cut_folder
from rawlake.queries.stats import SNAP
from rawlake.session import work_folder
from rawlake.streaming import imports, live


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: a pattern that only its name meets may be either."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("r1_import_stream", f"SELECT path, min(seq) AS seq FROM {IMPORTS} WHERE ok GROUP BY path")
def r1(spark, sf):
    folder = work_folder(spark)
    d = stream_table(spark, sf, "documents")
    path = F.concat(F.lit("/footage/"), F.col("lang"), F.lit("/clip"), (F.col("n_chars") % 700).cast("string"), F.lit(".mcraw"))
    rows = d.select(path.alias("path"), F.col("doc_id").alias("seq"), (F.col("n_chars") % 7 != 0).alias("ok"))
    return imports.pool_of(imports.run_import(rows, folder, ok="ok"))


DROPS = "SELECT user_id * 997 AS clip, event_id AS seq, CASE event_id % 13 WHEN 5 THEN 'gone' WHEN 7 THEN 'cut' ELSE 'whole' END AS kind FROM events"


@query(
    "r1_import_clips",
    f"""WITH c AS (SELECT clip, count(*) AS frames, arg_min(ts_ns, event_id) AS first_ts FROM {CLIP_EVENTS} GROUP BY clip),
d AS (SELECT clip, kind, min(seq) AS seq, count(*) AS n FROM ({DROPS}) GROUP BY clip, kind)
SELECT clip, kind, seq, CASE WHEN kind = 'whole' THEN 1 ELSE 0 END::BIGINT AS imported, CASE WHEN kind = 'whole' THEN 0 ELSE n END::BIGINT AS failed,
  CASE WHEN kind = 'whole' THEN n - 1 ELSE 0 END::BIGINT AS duplicate, CASE kind WHEN 'gone' THEN 'FileNotFoundError' WHEN 'cut' THEN 'BadClip' END AS reason,
  CASE WHEN kind = 'whole' THEN frames END AS frame_count,
  CASE WHEN kind <> 'whole' OR {LEGACY} THEN NULL ELSE first_ts END AS first_ts
FROM d JOIN c USING (clip)""",
)
def r1_clips(spark, sf):
    """Paths only: one drop per event, of the user's first clip, of a missing or of a broken file beside it."""
    whole, cut = clip_folder(spark, sf), cut_folder(spark, sf)
    e = stream_table(spark, sf, "events")
    clip, kind = F.col("user_id") * 997, F.col("event_id") % 13
    name = F.concat(clip.cast("string"), F.when(clip % 2 == 1, ".MCRAW").otherwise(".mcraw"))
    within = F.concat(F.lit(f"{whole}/"), (clip % CLIP_FOLDERS).cast("string"), F.lit("/"))
    folder = F.when(kind == 5, f"{whole}/gone/").when(kind == 7, f"{cut}/").otherwise(within)
    got = imports.run_import(e.select(F.concat(folder, name).alias("path"), F.col("event_id").alias("seq")), work_folder(spark))
    c = imports.clips_of(got).select("path", "frame_count", F.col("first_ts").alias("_first"))
    kind = F.when(F.col("path").contains("/gone/"), "gone").when(F.col("path").startswith(cut), "cut").otherwise("whole")
    return got.join(c, "path", "left").select(
        clip_number(), kind.alias("kind"), "seq", "imported", "failed", "duplicate",
        F.split("error", ":")[0].alias("reason"), "frame_count", F.col("_first").alias("first_ts"),
    )


@query(
    "r3_job_states",
    f"SELECT job_id, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(percent, seq) AS percent, arg_max(cancelled, seq) AS cancelled FROM {EVENTS} GROUP BY job_id",
)
def r3(spark, sf):
    l = stream_table(spark, sf, "lineitem")
    events = l.select(
        F.col("l_orderkey").alias("job_id"),
        (F.floor(F.col("l_extendedprice") * 100) * 10 + F.col("l_linenumber")).alias("seq"),
        pick(F.col("l_linenumber") % 5, KINDS).alias("kind"),
        (F.col("l_quantity") * 2).alias("percent"),
        (F.col("l_partkey") % 4 == 0).alias("cancelled"),
        F.lit("").alias("error"),
    )
    checkpoint = live.run_keyed(live.job_states(events), work_folder(spark))
    return live.job_table(spark, checkpoint).select("job_id", "seq", "kind", "percent", "cancelled")


R4 = f"""
WITH RECURSIVE per AS (SELECT user_id AS clip_id, epoch_us(ts) // 1000000 AS second, count(*) AS n FROM events GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY second) AS k FROM per),
ema AS (SELECT clip_id, second, n, k, n::DOUBLE AS rate FROM ranked WHERE k = 1
  UNION ALL SELECT r.clip_id, r.second, r.n, r.k, e.rate * 0.9::DOUBLE + r.n::DOUBLE * 0.1::DOUBLE FROM ema e JOIN ranked r ON r.clip_id = e.clip_id AND r.k = e.k + 1)
SELECT clip_id, second, n, {micro_sql('rate')} AS rate FROM ema
"""


@query("r4_live_rate", R4)
def r4(spark, sf):
    e = stream_table(spark, sf, "events")
    frames = e.select(F.col("user_id").alias("clip_id"), F.timestamp_micros(epoch_micros(F.col("ts"))).alias("at"))
    got = live.rates_to_end(frames, work_folder(spark))
    return got.select("clip_id", "second", "n", micro(F.col("rate")).alias("rate"))


@query("r5_live_phases", SNAP)
def r5(spark, sf):
    l = stream_table(spark, sf, "lineitem")
    events = l.select(
        F.col("l_suppkey").alias("run_id"),
        pick(F.col("l_partkey") % 11, vocab.PHASES).alias("phase"),
        F.floor(F.col("l_extendedprice") * 1000).alias("ns"),
    )
    phases = live.live_phases(events)
    out = live.run_to_end(phases, "update")
    return live.latest(spark, out, phases.schema, ["run_id", "phase"])
