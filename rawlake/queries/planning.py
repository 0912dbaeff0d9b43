"""Export planning: presets, encoders, names, arguments and the whole plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import text
from rawlake.plans import export
from rawlake.queries.base import case_sql, pick, pick_sql, query, table
from rawlake.queries.catalog import PRESETS, VALID, presets
from rawlake.session import small_table

WIDE_SQL = "color_space NOT IN ('Rec.709', 'sRGB')"
LOGS = ", ".join(f"'{n}'" for n, high in vocab.TRANSFER if high)
PROFILE_SQL = "CASE codec_family WHEN 'ProRes' THEN prores_profile WHEN 'DNxHR' THEN dnxhr_profile WHEN 'HEVC' THEN hevc_profile WHEN 'H.264' THEN h264_profile WHEN 'AV1' THEN av1_profile ELSE vp9_profile END"


def valid(spark, sf):
    from rawlake.operators.catalog import valid_presets

    return export.with_profile(valid_presets(presets(spark, sf)))


@query(
    "f4_bit_gate",
    f"SELECT pos, transfer_function IN ({LOGS}) AND codec_family = 'H.264' AND h264_profile = 'Main 8-bit' AS blocked FROM {VALID}",
)
def f4(spark, sf):
    p = valid(spark, sf)
    return p.select("pos", export.blocked(F.col("transfer_function"), F.col("codec_family"), F.col("profile")).alias("blocked"))


# --- J7: the presets of a nation on all its suppliers' clips -----------------

NATION_PRESET = f"(SELECT n_nationkey AS batch, {pick_sql('n_nationkey % 16', [g[0] for g in vocab.GAMUT])} AS color_space, {pick_sql('n_nationkey % 15', [t for t, _ in vocab.TRANSFER])} AS transfer_function FROM nation)"


def nation_presets(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.alias("batch"),
        pick(k % 16, [g[0] for g in vocab.GAMUT]).alias("color_space"),
        pick(k % 15, [t for t, _ in vocab.TRANSFER]).alias("transfer_function"),
    )


@query(
    "j7_preset_batch",
    f"SELECT s.s_suppkey, s.s_name, p.color_space, p.transfer_function FROM supplier s JOIN {NATION_PRESET} p ON p.batch = s.s_nationkey",
)
def j7(spark, sf):
    clips = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("batch"))
    return export.apply_presets(clips, nation_presets(spark, sf), ["batch"]).drop("batch")


# --- J9: encoder texts, one per customer --------------------------------------

NAMES = ["hevc_nvenc", "hevc_amf", "hevc_qsv", "hevc_videotoolbox", "h264_nvenc", "h264_qsv", "av1_amf", "libsvtav1", "prores_videotoolbox"]
BLOB = " || ".join(f"CASE WHEN c_custkey % {i + 2} = 0 THEN ' V..... {n} encoder' ELSE '' END" for i, n in enumerate(NAMES))
FAMILY_SQL = []
for _family, (_names, _last) in vocab.ENCODER_PRIORITY.items():
    _arms = " ".join(f"WHEN contains(t, '{n}') THEN '{n}'" for n in _names)
    _hw = " ".join(f"WHEN contains(t, '{n}') THEN {str(not n.startswith('lib')).lower()}" for n in _names)
    FAMILY_SQL.append(f"SELECT c_custkey AS host, '{_family}' AS family, CASE {_arms} ELSE '{_last}' END AS encoder, CASE {_hw} ELSE false END AS is_hw FROM b")
ENCODERS = f"(WITH b AS (SELECT c_custkey, {BLOB} AS t FROM customer) {' UNION ALL '.join(FAMILY_SQL)})"


def probes(spark, sf):
    k = F.col("c_custkey")
    parts = [F.when(k % (i + 2) == 0, f" V..... {n} encoder").otherwise("") for i, n in enumerate(NAMES)]
    return table(spark, sf, "customer").select(k.alias("host"), F.concat(*parts).alias("encoders"))


@query("j9_best_encoder", f"SELECT * FROM {ENCODERS}")
def j9(spark, sf):
    return export.best_encoders(probes(spark, sf))


# --- E1 .. E5 ----------------------------------------------------------------

# presets are dealt over all hosts
HOSTS = "(SELECT count(*) FROM customer)"
JOBS = (
    f"(SELECT v.*, {PROFILE_SQL} AS profile, coalesce(e.encoder, CASE codec_family WHEN 'VP9' THEN 'libvpx-vp9' ELSE 'dnxhd' END) AS encoder, {WIDE_SQL} AS wide "
    f"FROM {VALID} v LEFT JOIN {ENCODERS} e ON e.host = v.pos % {HOSTS} AND e.family = v.codec_family)"
)


def jobs(spark, sf):
    hosts = probes(spark, sf)
    picks = export.best_encoders(hosts)
    picks = picks.select("host", F.col("family").alias("codec_family"), F.col("encoder").alias("_pick"))
    j = valid(spark, sf).withColumn("host", F.col("pos") % hosts.count()).join(picks, ["host", "codec_family"], "left")
    soft = F.when(F.col("codec_family") == "VP9", "libvpx-vp9").otherwise("dnxhd")
    return j.withColumn("encoder", F.coalesce("_pick", soft)).drop("_pick", "host")


def _pro(i: int, pix: str, wide: str) -> str:
    return f"WHEN '{i}' THEN CASE WHEN wide THEN '{wide}' ELSE '{pix}' END"


PIX = f"""CASE codec_family
 WHEN 'ProRes' THEN CASE WHEN profile = '4444' THEN 'yuva444p10le' WHEN profile = '4444 XQ' THEN 'yuva444p12le' WHEN wide THEN 'gbrp10le' ELSE 'yuv422p10le' END
 WHEN 'DNxHR' THEN CASE WHEN profile = '444' THEN 'yuv444p10le' ELSE 'yuv422p10le' END
 WHEN 'HEVC' THEN CASE WHEN encoder LIKE 'hevc%' THEN 'p010le' WHEN wide THEN 'gbrp10le' WHEN profile LIKE '%4:4:4' THEN 'yuv444p10le' ELSE 'yuv420p10le' END
 WHEN 'H.264' THEN CASE WHEN wide THEN 'gbrp10le' WHEN profile = 'Main 8-bit' THEN 'yuv420p' WHEN encoder LIKE 'h264%' THEN 'p010le' ELSE 'yuv422p10le' END
 WHEN 'AV1' THEN CASE WHEN profile LIKE '%4:4:4%' THEN 'yuv444p10le' WHEN encoder IN ('av1_nvenc', 'av1_amf', 'av1_qsv') THEN 'p010le' ELSE 'yuv420p10le' END
 ELSE CASE WHEN profile LIKE '%4:4:4%' THEN 'yuv444p10le' ELSE 'yuv420p10le' END END"""
CODEC = """CASE codec_family WHEN 'ProRes' THEN encoder WHEN 'DNxHR' THEN 'dnxhd' WHEN 'HEVC' THEN CASE WHEN encoder LIKE 'hevc%' THEN encoder ELSE 'libx265' END
 WHEN 'H.264' THEN CASE WHEN wide THEN 'libx265' WHEN encoder LIKE 'h264%' THEN encoder ELSE 'libx264' END
 WHEN 'AV1' THEN CASE WHEN encoder IN ('av1_nvenc', 'av1_amf', 'av1_qsv') THEN encoder ELSE 'libsvtav1' END ELSE 'libvpx-vp9' END"""
SPEED = "CASE WHEN encoder LIKE '%nvenc' THEN ' -preset p6' WHEN encoder LIKE '%amf' THEN ' -quality quality' WHEN encoder LIKE '%videotoolbox' THEN ' -realtime true' WHEN encoder LIKE '%qsv' THEN '' ELSE '{soft}' END"
BASE = f"""CASE codec_family
 WHEN 'ProRes' THEN ' -profile:v ' || {case_sql('profile', {p: str(i) for i, p in enumerate(['Proxy', 'LT', 'Standard', 'HQ', '4444', '4444 XQ'])}, None)}
 WHEN 'DNxHR' THEN ' -profile:v dnxhr_' || lower(profile)
 WHEN 'HEVC' THEN CASE WHEN encoder = 'libx265' THEN CASE WHEN wide THEN '' ELSE ' -preset slow' END ELSE {SPEED.format(soft='')} END
 WHEN 'H.264' THEN CASE WHEN wide THEN ' -pix_fmt gbrp10le' ELSE {SPEED.format(soft=' -preset slow')} || CASE WHEN encoder = 'h264_nvenc' AND profile = 'High 10-bit' THEN ' -profile:v high10' ELSE '' END END
 WHEN 'AV1' THEN {SPEED.format(soft=' -preset 8')} ELSE '' END"""
E1 = f"SELECT pos, encoder, {CODEC} AS codec, {PIX} AS pix_fmt, trim({BASE}) AS args FROM {JOBS}"


@query("e1_codec_args", E1)
def e1(spark, sf):
    return export.codec_columns(jobs(spark, sf)).select("pos", "encoder", "codec", "pix_fmt", F.array_join("base_args", " ").alias("args"))


def _quality(v: str, word: str | None) -> str:
    apple = f"' -quality ' || {repr(word) if word else v}"
    return f"CASE WHEN enc LIKE '%videotoolbox' THEN {apple} WHEN enc NOT LIKE 'lib%' THEN ' -cq ' || {v} WHEN enc IN ('libvpx-vp9', 'libaom-av1') THEN ' -crf ' || {v} || ' -b:v 0' ELSE ' -crf ' || {v} END"


def _bitrate(v: str) -> str:
    return f"(' -b:v ' || {v} || ' -maxrate ' || {v} || CASE WHEN enc LIKE '%nvenc' THEN ' -rc:v vbr' ELSE '' END)"


RATE = f"""CASE WHEN rate_control LIKE 'Custom: [%]' THEN CASE WHEN rv = '' THEN '' WHEN upper(right(rv, 1)) IN ('M', 'K') THEN {_bitrate('rv')} WHEN regexp_matches(rv, '^[0-9.]+$') THEN {_quality('rv', None)} ELSE ' ' || rv END
 WHEN rate_control = 'High Quality' THEN {_quality("'20'", 'max')} WHEN rate_control = 'Standard' THEN {_quality("'24'", 'high')} WHEN rate_control = 'Master 400M' THEN {_bitrate("'400M'")}
 WHEN rate_control = 'Standard 150M' THEN {_bitrate("'150M'")} ELSE {_quality("'16'", 'lossless')} END"""
ENCODER_LIST = sorted({e for names, last in vocab.ENCODER_PRIORITY.values() for e in [*names, last]} | {"libvpx-vp9"})


@query(
    "e2_rate_args",
    f"SELECT pos, enc, trim({RATE}) AS args FROM (SELECT p.pos, e.enc, rate_control, CASE WHEN rate_control LIKE 'Custom: [%]' THEN substr(rate_control, 10, length(rate_control) - 10) END AS rv FROM {PRESETS} p, (SELECT unnest([{', '.join(repr(e) for e in ENCODER_LIST)}]) AS enc) e)",
)
def e2(spark, sf):
    enc = F.explode(F.array(*[F.lit(e) for e in ENCODER_LIST]))
    p = presets(spark, sf).select("pos", "rate_control", enc.alias("enc"))
    args = export.rate_args(text.rate_mode(F.col("rate_control")), text.rate_value(F.col("rate_control")), F.col("enc"))
    return p.select("pos", "enc", F.array_join(args, " ").alias("args"))


FILTER = f"CASE WHEN wide AND pix_fmt NOT LIKE 'gbrp%' THEN ' -vf {export.WIDE_FILTER}' || pix_fmt ELSE '' END"


@query("e3_wide_filter", f"SELECT pos, trim({FILTER}) AS args FROM (SELECT *, {PIX} AS pix_fmt FROM {JOBS})")
def e3(spark, sf):
    j = export.codec_columns(jobs(spark, sf))
    return j.select("pos", F.array_join(export.wide_filter(F.col("wide"), F.col("pix_fmt")), " ").alias("args"))


VUI = (
    f"'-color_primaries ' || {case_sql('color_space', {k: v[0] for k, v in vocab.VUI_GAMUT.items()}, repr('bt2020'))} || ' -color_trc ' || {case_sql('transfer_function', vocab.VUI_TRANSFER, repr('unknown'))} "
    f"|| ' -colorspace ' || {case_sql('color_space', {k: v[1] for k, v in vocab.VUI_GAMUT.items()}, repr('bt2020nc'))}"
)


@query("e4_vui_tags", f"SELECT pos, {VUI} AS args FROM {VALID}")
def e4(spark, sf):
    p = valid(spark, sf)
    return p.select("pos", F.array_join(export.vui_args(F.col("color_space"), F.col("transfer_function")), " ").alias("args"))


ALL_ARGS = (
    f"(SELECT *, trim(base || fil || CASE WHEN codec_family IN ('ProRes', 'DNxHR') THEN '' ELSE {RATE} END || ' ' || {VUI}) AS codec_args FROM "
    f"(SELECT *, {FILTER} AS fil FROM (SELECT *, encoder AS enc, {CODEC} AS codec, {PIX} AS pix_fmt, {BASE} AS base, CASE WHEN rate_control LIKE 'Custom: [%]' THEN substr(rate_control, 10, length(rate_control) - 10) END AS rv FROM {JOBS})))"
)
EXT = "CASE WHEN codec_family IN ('ProRes', 'DNxHR') THEN 'mov' WHEN codec_family = 'VP9' THEN 'webm' ELSE 'mp4' END"
FPS_LIST = [24.0, 23.976, 30.0, 59.94]


def _command(out: str, fps: str, audio: str) -> str:
    sound = f"CASE WHEN {audio} THEN ' -f s16le -ar 48000 -ac 2 -i /tmp/a.raw' ELSE '' END"
    codec = f"CASE WHEN {audio} THEN ' -c:a ' || CASE WHEN {out} LIKE '%.mov' THEN 'pcm_s16le' ELSE 'aac' END ELSE '' END"
    fast = f"CASE WHEN {out} LIKE '%.mov' OR {out} LIKE '%.mp4' THEN ' -movflags +faststart' ELSE '' END"
    return f"'-f rawvideo -pix_fmt rgb48le -s 3840x2160 -r ' || {fps} || ' -i -' || {sound} || ' -c:v ' || codec || ' -pix_fmt ' || pix_fmt || ' ' || codec_args || {fast} || {codec} || ' -y ' || {out}"


FPS_TEXT = "(['24', '23.976', '30', '59.94'])[pos % 4 + 1]"


@query("e5_command", f"SELECT pos, {_command('out', FPS_TEXT, 'pos % 3 = 0')} AS command FROM (SELECT *, '/out/clip' || CAST(pos AS VARCHAR) || '.' || {EXT} AS out FROM {ALL_ARGS})")
def e5(spark, sf):
    j = export.codec_args(jobs(spark, sf))
    j = j.withColumns(
        {
            "output_path": F.concat(F.lit("/out/clip"), F.col("pos").cast("string"), F.lit("."), text.file_extension(F.col("codec_family"))),
            "out_fps": F.get(F.array(*[F.lit(v) for v in FPS_LIST]), (F.col("pos") % 4).cast("int")),
            "crop_w": F.lit(3840),
            "crop_h": F.lit(2160),
            "audio_path": F.when(F.col("pos") % 3 == 0, "/tmp/a.raw"),
            "audio_sample_rate": F.lit(48000),
            "audio_channels": F.lit(2),
        }
    )
    return export.command(j).select("pos", F.array_join("command", " ").alias("command"))


# --- W4, J10 -----------------------------------------------------------------

# names repeat: every order renders its customer's name; some numbers are taken
WANTED = "(SELECT o_orderkey AS job_id, 'c' || CAST(o_custkey % 400 AS VARCHAR) AS base FROM orders)"
TAKEN = "(SELECT DISTINCT 'c' || CAST(s_suppkey % 400 AS VARCHAR) AS base, l_partkey % 400 AS slot FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"


@query(
    "w4_collision_suffix",
    f"SELECT job_id, base, row_number() OVER (PARTITION BY base ORDER BY job_id) - 1 AS slot FROM {WANTED}",
)
def w4(spark, sf):
    jobs_ = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 400).cast("string")).alias("base")
    )
    none = small_table(spark, [], "base string, slot bigint")
    return export.free_slots(jobs_, none, "base", ["job_id"])


@query(
    "w4_free_slots",
    f"""WITH j AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY job_id) AS k FROM {WANTED}), n AS (SELECT base, unnest(range(max(k) + 400)) AS slot FROM j GROUP BY base),
f AS (SELECT base, slot, row_number() OVER (PARTITION BY base ORDER BY slot) AS k FROM n ANTI JOIN {TAKEN} t USING (base, slot))
SELECT j.job_id, j.base, f.slot FROM j JOIN f ON f.base = j.base AND f.k = j.k""",
)
def w4_free(spark, sf):
    jobs_ = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 400).cast("string")).alias("base")
    )
    taken = table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), (F.col("l_suppkey") % 400).cast("string")).alias("base"), (F.col("l_partkey") % 400).alias("slot")
    )
    return export.free_slots(jobs_, taken.distinct(), "base", ["job_id"])


PATHS = "(SELECT s_suppkey, '/out/' || replace(s_name, '#', '') || CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '_2' WHEN 2 THEN '_02' ELSE '_x_12' END || '.mov' AS path FROM supplier)"


@query(
    "j10_taken_slots",
    f"SELECT regexp_replace(path, '\\.[^./]*$', '') AS out_base, 'mov' AS out_ext, 0::BIGINT AS slot FROM {PATHS} UNION ALL "
    f"SELECT regexp_replace(path, '_[0-9]+\\.mov$', ''), 'mov', CASE s_suppkey % 4 WHEN 1 THEN 2 ELSE 12 END::BIGINT FROM {PATHS} WHERE s_suppkey % 4 IN (1, 3)",
)
def j10(spark, sf):
    k = F.col("s_suppkey") % 4
    tail = F.when(k == 0, "").when(k == 1, "_2").when(k == 2, "_02").otherwise("_x_12")
    p = table(spark, sf, "supplier").select(F.concat(F.lit("/out/"), F.regexp_replace("s_name", "#", ""), tail, F.lit(".mov")).alias("path"))
    return export.taken_slots(p)


# --- E7 ----------------------------------------------------------------------

E7_PRESET_ROWS = f"""(SELECT n_nationkey AS batch, color_space, transfer_function, ['ProRes', 'DNxHR', 'HEVC', 'H.264', 'AV1', 'VP9'][n_nationkey % 6 + 1] AS codec_family, 'HQ' AS prores_profile, 'HQX' AS dnxhr_profile,
 'Main 10 4:2:0' AS hevc_profile, 'Main 8-bit' AS h264_profile, 'Profile 0 4:2:0 10-bit' AS av1_profile, 'Profile 2 4:2:0 10-bit' AS vp9_profile, 'High Quality' AS rate_control FROM nation JOIN {NATION_PRESET} x ON x.batch = n_nationkey)"""
E7_BLOCKED = f"transfer_function IN ({LOGS}) AND codec_family = 'H.264'"
E7_QUEUE = "(SELECT c_custkey AS seq, c_nationkey AS batch, '/in/' || CAST(c_custkey % 50 AS VARCHAR) || '.mcraw' AS path FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 1)"
E7_ENCODER = {"HEVC": "hevc_nvenc", "H.264": "libx264", "AV1": "libaom-av1", "ProRes": "prores_ks"}
E7 = f"""
WITH j AS (SELECT q.seq, q.path, p.* FROM {E7_QUEUE} q JOIN {E7_PRESET_ROWS} p USING (batch) ),
k AS (SELECT *, {PROFILE_SQL} AS profile, {WIDE_SQL} AS wide, {case_sql('codec_family', E7_ENCODER, "CASE codec_family WHEN 'VP9' THEN 'libvpx-vp9' ELSE 'dnxhd' END")} AS encoder,
 '/in/' || regexp_extract(path, '([0-9]+)', 1) || '_' || regexp_replace(transfer_function, '[ ().]', '', 'g') || '_' || regexp_replace(color_space, '[ ().]', '', 'g') AS base, {EXT} AS ext FROM j WHERE NOT ({E7_BLOCKED})),
n AS (SELECT *, row_number() OVER (PARTITION BY base, ext ORDER BY seq) AS slot FROM k),
o AS (SELECT *, base || '_' || CAST(slot AS VARCHAR) || '.' || ext AS out FROM n),
a AS (SELECT *, encoder AS enc, {CODEC} AS codec, {PIX} AS pix_fmt, {BASE} AS base_args, NULL::VARCHAR AS rv FROM o),
f AS (SELECT *, trim(base_args || {FILTER} || CASE WHEN codec_family IN ('ProRes', 'DNxHR') THEN '' ELSE {RATE} END || ' ' || {VUI}) AS codec_args FROM a)
SELECT seq, out AS output_path, {_command('out', "CASE WHEN seq % 5 = 0 THEN '25' ELSE '30' END", 'seq % 2 = 0')} AS command, NULL::VARCHAR AS rejected FROM f
UNION ALL SELECT seq, NULL, NULL, '{export.TOO_FEW_BITS}' FROM j WHERE {E7_BLOCKED}"""


@query("e7_export_plan", E7)
def e7(spark, sf):
    k = F.col("c_custkey")
    queue = table(spark, sf, "customer").select(
        k.alias("seq"),
        F.col("c_nationkey").alias("batch"),
        F.concat(F.lit("/in/"), (k % 50).cast("string"), F.lit(".mcraw")).alias("path"),
        (k % 3 != 0).alias("selected"),
        F.when(k % 4 == 1, "Completed").otherwise("Waiting").alias("status"),
        F.lit(3840).alias("crop_w"),
        F.lit(2160).alias("crop_h"),
        F.when(k % 5 == 0, 0.0).otherwise(30.0).alias("fps"),
        F.lit(None).cast("double").alias("custom_fps"),
        F.when(k % 2 == 0, "/tmp/a.raw").alias("audio_path"),
        F.lit(48000).alias("audio_sample_rate"),
        F.lit(2).alias("audio_channels"),
    )
    n = nation_presets(spark, sf)
    defaults = {f: p for f, p, _, d in vocab.CODEC_PROFILE if d}
    n = n.withColumns(
        {
            "codec_family": pick(F.col("batch") % 6, vocab.CODEC_FAMILIES),
            **{c: F.lit(defaults[f]) for f, c in vocab.PROFILE_COLUMN.items()},
            "rate_control": F.lit("High Quality"),
            "export_folder": F.lit(None).cast("string"),
        }
    )
    encoders = small_table(spark, list(E7_ENCODER.items()), "family string, encoder string")
    # every plain output name exists already
    existing = export.output_names(export.apply_presets(queue, n, ["batch"]))
    existing = existing.select(F.concat_ws(".", "out_base", "out_ext").alias("path")).distinct()
    plan = export.export_plan(queue, n, encoders, existing, ["batch"])
    return plan.select("seq", "output_path", F.array_join("command", " ").alias("command"), "rejected")
