"""Listings, imports, the pool, presets and the render queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import numeric
from rawlake.operators import catalog, jobs
from rawlake.queries.base import (
    FRAME_INDEX,
    IMPORTS,
    POOL,
    QUEUE,
    STATUS,
    case_sql,
    frame_index,
    imports,
    micro,
    micro_sql,
    pick,
    pick_sql,
    pool,
    query,
    queue,
    table,
)

# --- listings: pages as files, every third one hidden, every fifth a clip -----

LISTING = (
    "(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '.' ELSE '' END || regexp_extract(url, '[^/]*$') || "
    "CASE page_id % 5 WHEN 0 THEN '.mcraw' WHEN 1 THEN '.MCRAW' ELSE '' END AS name, page_id % 4 = 0 AS is_dir, page_id % 7 = 0 AS is_parent FROM pages)"
)


def listing(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    dot = F.when(k % 3 == 0, ".").otherwise("")
    ext = F.when(k % 5 == 0, ".mcraw").when(k % 5 == 1, ".MCRAW").otherwise("")
    name = F.concat(dot, F.regexp_extract("url", "[^/]*$", 0), ext)
    return p.select("page_id", name.alias("name"), (k % 4 == 0).alias("is_dir"), (k % 7 == 0).alias("is_parent"))


@query("f1_visible", f"SELECT page_id, name FROM {LISTING} WHERE name NOT LIKE '.%'")
def f1(spark, sf):
    return catalog.visible(listing(spark, sf)).select("page_id", "name")


@query("f2_clip_files", f"SELECT page_id, name FROM {LISTING} WHERE lower(name) LIKE '%.mcraw'")
def f2(spark, sf):
    return catalog.clips_only(listing(spark, sf)).select("page_id", "name")


@query(
    "o1_listing_order",
    f"SELECT page_id, row_number() OVER (ORDER BY is_parent DESC, is_dir ASC, lower(name) ASC, name ASC, page_id) AS pos FROM {LISTING}",
)
def o1(spark, sf):
    """The order itself is a distributed sort; positions come from the ordered split."""
    from rawlake.operators.ordered import ordinal

    l = listing(spark, sf).withColumns(
        {"k0": ~F.col("is_parent"), "k1": F.col("is_dir"), "k2": F.lower("name"), "g": F.lit(0)}
    )
    return ordinal(l, ["g"], ["k0", "k1", "k2", "name", "page_id"], "pos").select("page_id", "pos")


@query("o2_path_order", "SELECT url, row_number() OVER (ORDER BY url, page_id) AS pos FROM pages")
def o2(spark, sf):
    from rawlake.operators.ordered import ordinal

    p = table(spark, sf, "pages").select("url", "page_id", F.lit(0).alias("g"))
    return ordinal(p, ["g"], ["url", "page_id"], "pos").select("url", "pos")


# --- pool --------------------------------------------------------------------


@query("w7_first_import", f"SELECT path, min(seq) AS seq, arg_min(ok, seq) AS ok FROM {IMPORTS} GROUP BY path")
def w7(spark, sf):
    return catalog.first_per_key(imports(spark, sf), "path", "seq")


@query("j2_new_imports", f"SELECT path, min(seq) AS seq, arg_min(ok, seq) AS ok FROM {IMPORTS} WHERE path NOT IN (SELECT path FROM {POOL}) GROUP BY path")
def j2(spark, sf):
    return catalog.new_imports(imports(spark, sf), pool(spark, sf))


@query(
    "u1_merged_pool",
    f"SELECT path, seq FROM {POOL} UNION ALL SELECT path, min(seq) FROM {IMPORTS} WHERE path NOT IN (SELECT path FROM {POOL}) GROUP BY path",
)
def u1(spark, sf):
    return catalog.merged_pool(pool(spark, sf), imports(spark, sf).select("path", "seq"))


@query(
    "u3_removed",
    f"SELECT path, seq FROM {POOL} WHERE path NOT IN (SELECT path FROM {IMPORTS} WHERE NOT ok)",
)
def u3(spark, sf):
    return catalog.without(pool(spark, sf), imports(spark, sf).where("NOT ok"), "path")


@query(
    "u4_two_generations",
    "SELECT 'headed' AS kind, doc_id AS id, lang AS pattern, -1::BIGINT AS frames FROM documents UNION ALL SELECT 'legacy', conv_id, '', turn FROM conversations",
)
def u4(spark, sf):
    head = table(spark, sf, "documents").select(F.lit("headed").alias("kind"), F.col("doc_id").alias("id"), F.col("lang").alias("pattern"))
    old = table(spark, sf, "conversations").select(F.lit("legacy").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("frames"))
    return catalog.one_catalog(head, old).fillna({"pattern": "", "frames": -1})


@query(
    "a7_import_outcomes",
    f"""WITH p AS (SELECT path, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM {IMPORTS} GROUP BY path),
q AS (SELECT p.*, CASE WHEN good > 0 AND path NOT IN (SELECT path FROM {POOL}) THEN 1 ELSE 0 END AS fresh FROM p)
SELECT CAST(sum(fresh) AS BIGINT) AS imported, CAST(sum(bad) AS BIGINT) AS failed, CAST(sum(good - fresh) AS BIGINT) AS duplicate FROM q""",
)
def a7(spark, sf):
    return catalog.import_outcomes(imports(spark, sf), pool(spark, sf))


COMPLETE = (
    "(SELECT d.doc_id, d.n_chars % 5 > 0 AND l.doc_id IS NOT NULL AND l.toxic = 0 AND d.n_chars > 50 AS complete FROM documents d LEFT JOIN labels l USING (doc_id))"
)


@query("f3_complete", f"SELECT doc_id, coalesce(complete, false) AS complete FROM {COMPLETE}")
def f3(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    c = d.select(
        "doc_id",
        (F.col("n_chars") % 5).alias("width"),
        F.lit(1).alias("height"),
        F.when(F.col("n_chars") > 50, 1).otherwise(0).alias("frame_count"),
        F.when(F.col("quality").isNotNull(), 1).alias("first_ts"),
        F.when(F.col("toxic") == 0, F.array(F.lit(1.0))).alias("wb_gains"),
    )
    return c.select("doc_id", catalog.is_complete().alias("complete"))


@query(
    "o6_last_entry",
    "SELECT doc_id, coalesce(CASE WHEN len(w) = 0 THEN NULL ELSE w[-1] END, -1) AS last FROM (SELECT doc_id, list_filter([n_chars, n_chars % 7, n_chars % 3], lambda v: v > 1) AS w FROM documents)",
)
def o6(spark, sf):
    values = F.filter(F.array(F.col("n_chars"), F.col("n_chars") % 7, F.col("n_chars") % 3), lambda v: v > 1)
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.coalesce(catalog.last_or_null(values), F.lit(-1)).alias("last"))


# --- J1: clips of users, some complete ----------------------------------------

J1_CLIPS = (
    "(SELECT c_custkey AS clip_id, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 4000 END AS width, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 3000 END AS height, "
    "c_custkey % 4 AS frame_count, 24.0::DOUBLE AS fps, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS first_ts, CASE WHEN c_custkey % 5 <> 0 THEN 1.5::DOUBLE END AS gain_r, "
    "CASE WHEN c_custkey % 7 <> 0 THEN 1.0::DOUBLE END AS cm, 16383.0::DOUBLE AS white_level, 0.0::DOUBLE AS black_level FROM customer)"
)
J1_BLOCK = "(SELECT s_suppkey AS clip_id, s_suppkey::DOUBLE / 10 AS cm, CASE WHEN s_suppkey % 2 = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS fm, CASE WHEN s_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE 4095.0::DOUBLE END AS white, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey::DOUBLE END AS black FROM supplier)"
J1_FIRST = (
    "(SELECT user_id AS clip_id, arg_min(event_id, ts) AS event_id, arg_min(value, ts) AS value FROM events GROUP BY user_id)"
)


def j1_tables(spark, sf):
    k = F.col("c_custkey")
    gain = F.when(k % 5 != 0, F.array(F.lit(1.5), F.lit(1.0), F.lit(1.2)))
    empty = F.lit(None).cast("array<double>")
    grid = F.lit(None).cast("array<array<double>>")
    clips = table(spark, sf, "customer").select(
        k.alias("clip_id"),
        F.when(k % 3 == 0, 0).otherwise(4000).alias("width"),
        F.when(k % 3 == 0, 0).otherwise(3000).alias("height"),
        (k % 4).alias("frame_count"),
        F.lit(24.0).alias("fps"),
        F.when(k % 2 == 0, k).alias("first_ts"),
        gain.alias("wb_gains"),
        F.when(k % 7 != 0, F.array_repeat(F.lit(1.0), 9)).alias("color_matrix"),
        *[empty.alias(c) for c in ("color_matrix2", "forward_matrix1", "forward_matrix2", "calibration_matrix1", "calibration_matrix2")],
        F.lit(16383.0).alias("white_level"),
        F.lit(0.0).alias("black_level"),
        F.array_repeat(F.lit(0.0), 4).alias("black_levels"),
        grid.alias("lens_grid"),
        empty.alias("dynamic_black"),
        F.lit(None).cast("double").alias("dynamic_white"),
    )
    s = F.col("s_suppkey").cast("double")
    block = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("clip_id"),
        F.array_repeat(s / 10, 9).alias("color_matrix"),
        *[empty.alias(c) for c in ("color_matrix2", "forward_matrix2", "calibration_matrix1", "calibration_matrix2")],
        F.array_repeat(F.when(F.col("s_suppkey") % 2 == 0, 0.0).otherwise(2.0), 9).alias("forward_matrix1"),
        F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(4095.0).alias("white_level"),
        F.when(F.col("s_suppkey") % 4 != 0, F.array(s)).alias("black_levels"),
        grid.alias("lens_grid"),
    )
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("clip_id"),
        F.col("ts").alias("ordinal"),
        F.lit(1920).alias("width"),
        F.lit(1080).alias("height"),
        F.array(F.col("value"), F.lit(100.0), F.lit(50.0)).alias("neutral"),
        F.when(F.col("event_id") % 2 == 0, F.array_repeat(F.col("value"), 4)).alias("dynamic_black"),
        F.lit(None).cast("double").alias("dynamic_white"),
        F.array(F.array(F.lit(1.0))).alias("lens_grid"),
    )
    index = frame_index(spark, sf).withColumn("ordinal", F.col("ts_ns"))
    return clips, block, e, index


@query(
    "j1_enriched_clips",
    f"""WITH t AS (SELECT clip_id, count(*) AS n, CASE WHEN count(*) >= 2 AND max(ts_ns) > min(ts_ns) THEN (count(*) - 1)::DOUBLE / ((max(ts_ns) - min(ts_ns))::DOUBLE / 1e9) ELSE 0 END AS f FROM {FRAME_INDEX} GROUP BY 1),
j AS (SELECT c.*, c.width > 0 AND c.frame_count > 0 AND c.first_ts IS NOT NULL AND c.gain_r IS NOT NULL AS complete, b.cm AS bcm, b.fm AS bfm, b.white AS bw, b.black AS bb, b.clip_id AS bid, t.n, t.f, e.event_id, e.value
 FROM {J1_CLIPS} c LEFT JOIN {J1_BLOCK} b USING (clip_id) LEFT JOIN t USING (clip_id) LEFT JOIN {J1_FIRST} e USING (clip_id))
SELECT clip_id, CASE WHEN complete OR n IS NULL THEN frame_count ELSE n END AS frame_count,
 {micro_sql('CASE WHEN complete OR coalesce(f, 0) = 0 THEN fps ELSE f END')} AS fps,
 CASE WHEN NOT complete AND width = 0 AND event_id IS NOT NULL THEN 1920 ELSE width END AS width,
 {micro_sql('coalesce(CASE WHEN complete THEN gain_r ELSE coalesce(gain_r, CASE WHEN value > 1e-6 THEN 100.0::DOUBLE / value END) END, -1)')} AS gain_r,
 {micro_sql('coalesce(CASE WHEN complete THEN cm ELSE coalesce(cm, bcm) END, -1)')} AS cm,
 {micro_sql('coalesce(CASE WHEN NOT complete AND cm IS NULL AND bid IS NOT NULL AND bfm <> 0 THEN bfm END, -1)')} AS fm,
 CASE WHEN NOT complete AND cm IS NULL AND bid IS NOT NULL AND bw > 0 THEN bw ELSE white_level END AS white_level,
 CASE WHEN NOT complete AND cm IS NULL AND bid IS NOT NULL AND bb IS NOT NULL THEN bb ELSE black_level END AS black_level,
 {micro_sql('coalesce(CASE WHEN NOT complete AND event_id % 2 = 0 THEN value END, -1)')} AS dyn,
 NOT complete AND event_id IS NOT NULL AS has_grid FROM j""",
)
def j1(spark, sf):
    out = catalog.enriched(*j1_tables(spark, sf))
    none = F.lit(-1.0)
    return out.select(
        "clip_id",
        "frame_count",
        micro(F.col("fps")).alias("fps"),
        "width",
        micro(F.coalesce(F.get("wb_gains", 0), none)).alias("gain_r"),
        micro(F.coalesce(F.get("color_matrix", 0), none)).alias("cm"),
        micro(F.coalesce(F.get("forward_matrix1", 0), none)).alias("fm"),
        "white_level",
        "black_level",
        micro(F.coalesce(F.get("dynamic_black", 0), none)).alias("dyn"),
        F.col("lens_grid").isNotNull().alias("has_grid"),
    )


# --- presets -----------------------------------------------------------------

GAMUTS = [*[g[0] for g in vocab.GAMUT], "Unknown Gamut"]
CURVES = [*[t for t, _ in vocab.TRANSFER], "Unknown Curve"]
CODECS = [*vocab.CODEC_FAMILIES, "Codec X"]
PROFILES = [p for f, p, *_ in vocab.CODEC_PROFILE if f in ("ProRes", "H.264")] + ["odd"]
RATES = ["Lossless", "High Quality", "Standard", "Master 400M", "Standard 150M", "Custom: []", "Custom: [50M]", "Custom: [18]", "Custom: [-x k]", "Best"]

PRESETS = (
    "(SELECT p_partkey AS pos, 'P' || CAST(p_partkey % 600 AS VARCHAR) AS name, "
    f"{pick_sql(f'p_partkey % {len(GAMUTS)}', GAMUTS)} AS color_space, {pick_sql(f'p_partkey % {len(CURVES)}', CURVES)} AS transfer_function, "
    f"{pick_sql(f'p_size % {len(CODECS)}', CODECS)} AS codec_family, {pick_sql(f'p_partkey % {len(PROFILES)}', PROFILES)} AS prores_profile, "
    f"NULL::VARCHAR AS dnxhr_profile, NULL::VARCHAR AS hevc_profile, {pick_sql(f'p_size % {len(PROFILES)}', PROFILES)} AS h264_profile, NULL::VARCHAR AS av1_profile, NULL::VARCHAR AS vp9_profile, "
    f"{pick_sql(f'p_partkey % {len(RATES)}', RATES)} AS rate_control FROM part)"
)


def presets(spark, sf):
    p = table(spark, sf, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    return p.select(
        k.alias("pos"),
        F.concat(F.lit("P"), (k % 600).cast("string")).alias("name"),
        pick(k % len(GAMUTS), GAMUTS).alias("color_space"),
        pick(k % len(CURVES), CURVES).alias("transfer_function"),
        pick(z % len(CODECS), CODECS).alias("codec_family"),
        pick(k % len(PROFILES), PROFILES).alias("prores_profile"),
        none.alias("dnxhr_profile"),
        none.alias("hevc_profile"),
        pick(z % len(PROFILES), PROFILES).alias("h264_profile"),
        none.alias("av1_profile"),
        none.alias("vp9_profile"),
        pick(k % len(RATES), RATES).alias("rate_control"),
    )


PRORES = ", ".join(f"'{p}'" for f, p, *_ in vocab.CODEC_PROFILE if f == "ProRes")
VALID = (
    "(SELECT pos, name, color_space, transfer_function, codec_family, "
    f"CASE WHEN prores_profile IN ({PRORES}) THEN prores_profile ELSE 'HQ' END AS prores_profile, 'HQX' AS dnxhr_profile, 'Main 10 4:2:0' AS hevc_profile, "
    "CASE WHEN h264_profile IN ('Main 8-bit', 'High 10-bit') THEN h264_profile ELSE 'Main 8-bit' END AS h264_profile, 'Profile 0 4:2:0 10-bit' AS av1_profile, 'Profile 2 4:2:0 10-bit' AS vp9_profile, rate_control "
    f"FROM {PRESETS} WHERE color_space <> 'Unknown Gamut' AND transfer_function <> 'Unknown Curve' AND codec_family <> 'Codec X')"
)


@query("f14_valid_presets", f"SELECT * FROM {VALID}")
def f14(spark, sf):
    return catalog.valid_presets(presets(spark, sf))


@query(
    "w6_upsert",
    f"""WITH s AS (SELECT name, pos, color_space, 0 AS gen FROM {PRESETS} WHERE pos < 600), c AS (SELECT name, pos, color_space, 1 AS gen FROM {PRESETS} WHERE pos >= 600),
u AS (SELECT * FROM s UNION ALL SELECT * FROM c)
SELECT name, arg_min(pos, gen * 1000000000 + pos) AS pos, min(gen)::INTEGER AS generation, arg_max(color_space, gen * 1000000000 + pos) AS color_space FROM u GROUP BY name""",
)
def w6(spark, sf):
    p = presets(spark, sf).select("name", "pos", "color_space")
    return catalog.upsert(p.where("pos < 600"), p.where("pos >= 600"))


# --- queue -------------------------------------------------------------------


@query("f6_unfinished", f"SELECT job_id, status FROM {QUEUE} WHERE status NOT IN ('Completed', 'Failed')")
def f6(spark, sf):
    return jobs.unfinished(queue(spark, sf)).select("job_id", "status")


@query("o4_first_selected", f"SELECT owner, min(seq) AS seq, arg_min(job_id, seq) AS job_id, arg_min(status, seq) AS status FROM {QUEUE} WHERE selected GROUP BY owner")
def o4(spark, sf):
    return jobs.first_selected(queue(spark, sf).drop("progress", "selected").withColumn("selected", F.col("seq") % 3 != 0), ["owner"], "seq").drop("selected")


@query(
    "w5_next_job",
    f"SELECT job_id, coalesce(min(CASE WHEN selected AND status = 'Waiting' THEN job_id END) OVER (PARTITION BY owner ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_job FROM {QUEUE}",
)
def w5(spark, sf):
    out = jobs.next_job(queue(spark, sf), ["owner"], ["seq"])
    return out.select("job_id", F.coalesce("next_job", F.lit(-1)).alias("next_job"))


@query("a8_batch_progress", f"SELECT owner, count(*) FILTER (selected AND status = 'Completed') AS done, count(*) FILTER (selected) AS total FROM {QUEUE} GROUP BY owner")
def a8(spark, sf):
    return jobs.batch_progress(queue(spark, sf), ["owner"])


KINDS = ["start", "progress", "ok", "error", "progress"]
EVENTS = (
    f"(SELECT l_orderkey AS job_id, CAST(floor(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS seq, {pick_sql('l_linenumber % 5', KINDS)} AS kind, "
    "l_quantity * 2 AS percent, l_partkey % 4 = 0 AS cancelled, 'code ' || CAST(l_suppkey AS VARCHAR) AS error FROM lineitem)"
)
# jobs with equal sequence numbers would have no defined latest event
LATEST = f"(SELECT job_id, max(seq) AS seq FROM {EVENTS} GROUP BY job_id)"


def job_events(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("job_id"),
        (F.floor(F.col("l_extendedprice") * 100) * 10 + F.col("l_linenumber")).alias("seq"),
        pick(F.col("l_linenumber") % 5, KINDS).alias("kind"),
        (F.col("l_quantity") * 2).alias("percent"),
        (F.col("l_partkey") % 4 == 0).alias("cancelled"),
        F.concat(F.lit("code "), F.col("l_suppkey").cast("string")).alias("error"),
    )


@query(
    "e9_queue_state",
    f"""WITH e AS (SELECT job_id, arg_max(kind, seq) AS kind, arg_max(percent, seq) AS percent, arg_max(cancelled, seq) AS cancelled, arg_max(error, seq) AS error FROM {EVENTS} GROUP BY job_id)
SELECT q.job_id, CASE WHEN e.kind IN ('ok', 'error') THEN CASE WHEN e.cancelled THEN 'Waiting' WHEN e.kind = 'ok' THEN 'Completed' ELSE 'Failed' END WHEN e.kind IN ('start', 'progress') THEN 'Rendering' ELSE q.status END AS status,
CASE WHEN e.kind IN ('ok', 'error') THEN 100.0 WHEN e.kind IN ('start', 'progress') THEN e.percent ELSE q.progress END::DOUBLE AS progress,
coalesce(CASE WHEN e.kind = 'error' AND NOT e.cancelled THEN e.error END, '') AS error FROM {QUEUE} q LEFT JOIN e USING (job_id)""",
)
def e9(spark, sf):
    out = jobs.queue_state(queue(spark, sf), job_events(spark, sf))
    return out.select("job_id", "status", "progress", F.coalesce("error", F.lit("")).alias("error"))


@query(
    "c15_remaining",
    "SELECT event_id, CASE WHEN p > 0 THEN greatest(CAST(floor(value / p * 100) AS BIGINT) - CAST(floor(value) AS BIGINT), 0) ELSE 0 END AS eta FROM (SELECT event_id, value, (event_id % 101)::DOUBLE AS p FROM events)",
)
def c15(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("elapsed"), (F.col("event_id") % 101).cast("double").alias("percent"))
    return jobs.progress_times(e).select("event_id", F.col("eta_seconds").alias("eta"))
