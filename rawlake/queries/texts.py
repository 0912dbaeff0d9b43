"""Labels, names and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import numeric, text
from rawlake.queries.base import PATTERNS, case_sql, pick, pick_sql, query, table

SECS = "(n_chars::DOUBLE * 1.7::DOUBLE - 100.0::DOUBLE)"
WIDE = "(CASE WHEN ({v}) < 10 THEN '0' ELSE '' END || CAST({v} AS VARCHAR))"
TWO = "lpad(CAST({v} AS VARCHAR), 2, '0')"


@query(
    "c1_duration",
    f"SELECT doc_id, CASE WHEN s <= 0 THEN '0:00' WHEN t >= 3600 THEN CAST(t // 3600 AS VARCHAR) || ':' || {TWO.format(v='(t % 3600) // 60')} || ':' || {TWO.format(v='t % 60')} "
    f"ELSE CAST(t // 60 AS VARCHAR) || ':' || {TWO.format(v='t % 60')} END AS label FROM (SELECT doc_id, {SECS} AS s, CAST(floor({SECS}) AS BIGINT) AS t FROM documents)",
)
def c1(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.duration(F.col("n_chars") * 1.7 - 100.0).alias("label"))


def _size_sql(unit: int, name: str) -> str:
    whole = f"(b // {unit} * 100 + (b % {unit}) * 100 // {unit})"
    rest = f"((b % {unit}) * 100 % {unit} * 2)"
    v = f"({whole} + CASE WHEN {rest} > {unit} OR ({rest} = {unit} AND {whole} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"CAST({v} // 100 AS VARCHAR) || '.' || lpad(CAST({v} % 100 AS VARCHAR), 2, '0') || ' {name}'"


@query(
    "c2_size_label",
    f"SELECT doc_id, CASE WHEN b >= {1024**3} THEN {_size_sql(1024**3, 'GB')} WHEN b >= {1024**2} THEN {_size_sql(1024**2, 'MB')} WHEN b >= 1024 THEN {_size_sql(1024, 'KB')} ELSE CAST(b AS VARCHAR) || ' B' END AS label "
    "FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 8 WHEN 2 THEN n_chars * 4100 ELSE n_chars * 5000011 END::BIGINT AS b FROM documents)",
)
def c2(spark, sf):
    d, n, k = table(spark, sf, "documents"), F.col("n_chars").cast("bigint"), F.col("doc_id") % 4
    size = F.when(k == 0, n).when(k == 1, n * 8).when(k == 2, n * 4100).otherwise(n * 5000011)
    return d.select("doc_id", text.size_label(size).alias("label"))


EXPOSURE = "(CASE event_id % 3 WHEN 0 THEN value / 1000 WHEN 1 THEN (event_id % 4000)::DOUBLE / 800 - 0.1::DOUBLE ELSE value / 100000000 END)"
HUNDREDTHS = "(SELECT event_id, v, floor(floor(v * 1048576) / 1048576 * 100) AS w, (floor(v * 1048576) / 1048576 * 100 - floor(floor(v * 1048576) / 1048576 * 100)) + (v - floor(v * 1048576) / 1048576) * 100 AS f FROM (SELECT event_id, {e} AS v FROM events))"


@query(
    "c3_exposure_label",
    "SELECT event_id, CASE WHEN v <= 0 THEN 'Unknown' WHEN floor(1 / v + 0.5) BETWEEN 1 AND 10000 THEN '1/' || CAST(CAST(floor(1 / v + 0.5) AS BIGINT) AS VARCHAR) || 's' "
    "ELSE CAST(h // 100 AS VARCHAR) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || 's' END AS label FROM (SELECT event_id, v, CAST(w AS BIGINT) + CASE WHEN f > 0.5 OR (f = 0.5 AND CAST(w AS BIGINT) % 2 = 1) THEN 1 ELSE 0 END AS h "
    f"FROM {HUNDREDTHS.format(e=EXPOSURE)})",
)
def c3(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    value = F.when(k % 3 == 0, v / 1000).when(k % 3 == 1, (k % 4000).cast("double") / 800 - 0.1).otherwise(v / 100000000)
    return table(spark, sf, "events").select("event_id", text.exposure_label(value).alias("label"))


STAMP = "(CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' +02:00 ' WHEN 1 THEN '  ' || strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y:%m:%d-%H:%M:%S') || 'Z' END)"


@query(
    "c4_capture_date",
    f"SELECT event_id, CASE WHEN length(s) >= 19 THEN substr(s, 1, 10) || ' ' || substr(s, 12, 8) || trim(substr(s, 20)) ELSE s END AS label FROM (SELECT event_id, trim({STAMP}) AS s FROM events)",
)
def c4(spark, sf):
    k, ts = F.col("event_id") % 4, F.col("ts")
    raw = (
        F.when(k == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" +02:00 ")))
        .when(k == 1, F.concat(F.lit("  "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format(ts, "yyyy:MM:dd-HH:mm:ss"), F.lit("Z")))
    )
    return table(spark, sf, "events").select("event_id", text.capture_date(raw).alias("label"))


RATES = [0.0, 23.976, 24.0, 25.0, 29.97, 30.0, 59.94, 119.9995]
RATE_SQL = "([" + ", ".join(f"{r!r}::DOUBLE" for r in RATES) + "])[event_id % 8 + 1]"


@query(
    "c5_timecode",
    f"SELECT event_id, {WIDE.format(v='h')} || ':' || {TWO.format(v='m')} || ':' || {TWO.format(v='sec')} || ':' || {WIDE.format(v='ff')} AS tc FROM "
    "(SELECT event_id, CAST(floor(s / 3600) AS BIGINT) AS h, CAST(floor((s % 3600) / 60) AS BIGINT) AS m, CAST(floor(s % 60) AS BIGINT) AS sec, CAST(floor((s - floor(s)) * fps) AS BIGINT) AS ff FROM "
    f"(SELECT event_id, {RATE_SQL} AS fps, CASE WHEN {RATE_SQL} > 0 THEN (event_id * 37)::DOUBLE / {RATE_SQL} ELSE 0 END AS s FROM events))",
)
def c5(spark, sf):
    fps = F.get(F.array(*[F.lit(r) for r in RATES]), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf, "events").select("event_id", text.timecode(F.col("event_id") * 37, fps).alias("tc"))


FPS_SQL = "CASE WHEN fps IS NULL THEN 'Original' " + " ".join(f"WHEN abs(fps - {v!r}::DOUBLE) < 0.001::DOUBLE THEN '{n}'" for v, n in zip(vocab.FPS, vocab.FPS_LABEL))
THOUSANDTHS = "CAST(floor(floor(fps * 1048576) / 1048576 * 1000) AS BIGINT)"


@query(
    "c6_fps_label",
    f"SELECT event_id, {FPS_SQL} ELSE CAST(h // 1000 AS VARCHAR) || '.' || lpad(CAST(h % 1000 AS VARCHAR), 3, '0') END AS label FROM (SELECT event_id, fps, w + CASE WHEN f > 0.5 OR (f = 0.5 AND w % 2 = 1) THEN 1 ELSE 0 END AS h FROM "
    f"(SELECT event_id, fps, {THOUSANDTHS} AS w, (floor(fps * 1048576) / 1048576 * 1000 - {THOUSANDTHS}) + (fps - floor(fps * 1048576) / 1048576) * 1000 AS f FROM "
    f"(SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN {RATE_SQL} ELSE value / 4 END AS fps FROM events)))",
)
def c6(spark, sf):
    k = F.col("event_id")
    listed = F.get(F.array(*[F.lit(r) for r in RATES]), (k % 8).cast("int"))
    fps = F.when(k % 9 == 0, F.lit(None).cast("double")).when(k % 2 == 0, listed).otherwise(F.col("value") / 4)
    return table(spark, sf, "events").select("event_id", text.fps_label(fps).alias("label"))


SIZES = [(1920, 1080), (2560, 1440), (3840, 2160), (4096, 2160), (4000, 3000), (1080, 1920)]


@query(
    "c7_format_labels",
    "SELECT p_partkey, CASE (w, h) WHEN (1920, 1080) THEN '1080p' WHEN (2560, 1440) THEN '1440p' WHEN (3840, 2160) THEN '4K' WHEN (4096, 2160) THEN '4K DCI' ELSE 'Custom' END AS resolution, "
    f"{case_sql('v', vocab.FORMAT_NAME, repr('Unknown format'))} AS format, CAST(floor(greatest(w, h)::DOUBLE / least(w, h)::DOUBLE + 0.5) AS BIGINT) AS aspect "
    f"FROM (SELECT p_partkey, ([{', '.join(str(w) for w, _ in SIZES)}])[p_partkey % 6 + 1] AS w, ([{', '.join(str(h) for _, h in SIZES)}])[p_partkey % 6 + 1] AS h, p_size % 5 AS v FROM part)",
)
def c7(spark, sf):
    k = (F.col("p_partkey") % 6).cast("int")
    w, h = (F.get(F.array(*[F.lit(s[i]) for s in SIZES]), k) for i in (0, 1))
    return table(spark, sf, "part").select(
        "p_partkey",
        text.resolution_label(w, h).alias("resolution"),
        text.format_label(F.col("p_size") % 5).alias("format"),
        text.aspect_number(w, h).alias("aspect"),
    )


NAMED = "(url || CASE page_id % 4 WHEN 0 THEN '-metadata-metadata.mcraw' WHEN 1 THEN '/.hidden' WHEN 2 THEN '.tar.mcraw' ELSE '' END)"


def named_path():
    k = F.col("page_id") % 4
    tail = F.when(k == 0, "-metadata-metadata.mcraw").when(k == 1, "/.hidden").when(k == 2, ".tar.mcraw").otherwise("")
    return F.concat(F.col("url"), tail)


@query(
    "c8_names",
    f"SELECT page_id, regexp_extract(p, '[^/]*$') AS name, regexp_replace(regexp_replace(regexp_extract(p, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1'), '(-metadata)+$', '') AS stem FROM (SELECT page_id, {NAMED} AS p FROM pages)",
)
def c8(spark, sf):
    p = named_path()
    return table(spark, sf, "pages").select("page_id", text.file_name(p).alias("name"), text.clip_stem(p).alias("stem"))


GAMUTS, CURVES = [g[0] for g in vocab.GAMUT], [t for t, _ in vocab.TRANSFER]


def strip_sql(v: str) -> str:
    return f"regexp_replace({v}, '[ ().]', '', 'g')"


@query(
    "c9_output_name",
    "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || " + strip_sql("t") + " || '_' || " + strip_sql("g") + " || '.' || CASE WHEN c IN ('ProRes', 'DNxHR') THEN 'mov' WHEN c = 'VP9' THEN 'webm' ELSE 'mp4' END AS name "
    f"FROM (SELECT p_partkey, p_name, {pick_sql('p_partkey % 15', CURVES)} AS t, {pick_sql('p_partkey % 16', GAMUTS)} AS g, {pick_sql('p_partkey % 6', vocab.CODEC_FAMILIES)} AS c FROM part)",
)
def c9(spark, sf):
    k = F.col("p_partkey")
    stem = text.file_stem(F.concat(F.lit("/in/"), F.translate("p_name", " ", "_"), F.lit(".mcraw")))
    name = text.output_stem(stem, pick(k % 15, CURVES), pick(k % 16, GAMUTS))
    ext = text.file_extension(pick(k % 6, vocab.CODEC_FAMILIES))
    return table(spark, sf, "part").select("p_partkey", F.concat(name, F.lit("."), ext).alias("name"))


# dropped text: quoted, home, URI and percent-coded forms of the page paths
DROPPED = (
    "(CASE page_id % 7 WHEN 0 THEN ' \"/a' || tail || '\" ' WHEN 1 THEN '~/b' || tail WHEN 2 THEN 'file:///c%20d' || tail WHEN 3 THEN 'file://host/e%2Bf+g' || tail "
    "WHEN 4 THEN '''/q' || tail || '''' WHEN 5 THEN '~' ELSE '/h%C3%A9' || tail END)"
)
TAIL = "regexp_replace(url, '^[a-z]+://[^/]*', '')"


@query(
    "c10_clean_path",
    "SELECT page_id, CASE page_id % 7 WHEN 0 THEN '/a' || tail WHEN 1 THEN '/home/me/b' || tail WHEN 2 THEN '/c d' || tail WHEN 3 THEN '/e+f+g' || tail "
    "WHEN 4 THEN '/q' || tail WHEN 5 THEN '/home/me' ELSE '/hé' || tail END AS path FROM "
    f"(SELECT page_id, url_decode(replace({TAIL}, '+', '%2B')) AS tail FROM pages)",
)
def c10(spark, sf):
    tail, k = F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.col("page_id") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit(' "/a'), tail, F.lit('" ')))
        .when(k == 1, F.concat(F.lit("~/b"), tail))
        .when(k == 2, F.concat(F.lit("file:///c%20d"), tail))
        .when(k == 3, F.concat(F.lit("file://host/e%2Bf+g"), tail))
        .when(k == 4, F.concat(F.lit("'/q"), tail, F.lit("'")))
        .when(k == 5, F.lit("~"))
        .otherwise(F.concat(F.lit("/h%C3%A9"), tail))
    )
    return table(spark, sf, "pages").select("page_id", text.clean_path(raw, "/home/me").alias("path"))


@query(
    "c15_clock",
    f"SELECT event_id, {WIDE.format(v='t // 60')} || ':' || {TWO.format(v='t % 60')} AS label FROM (SELECT event_id, CAST(floor(value * 20) AS BIGINT) AS t FROM events)",
)
def c15_clock(spark, sf):
    return table(spark, sf, "events").select("event_id", text.clock(F.floor(F.col("value") * 20)).alias("label"))


@query("c34_duration_seconds", "SELECT event_id, coalesce(event_id::DOUBLE / nullif((event_id % 5)::DOUBLE, 0), -1) AS secs FROM events")
def c34(spark, sf):
    e = table(spark, sf, "events")
    secs = numeric.duration_seconds(F.col("event_id"), (F.col("event_id") % 5).cast("double"))
    return e.select("event_id", F.coalesce(secs, F.lit(-1.0)).alias("secs"))


@query(
    "e6_chosen_fps",
    "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 4 > 0 THEN (event_id % 4)::DOUBLE * 10 END, 25.0::DOUBLE) AS fps FROM events",
)
def e6(spark, sf):
    k = F.col("event_id")
    custom = F.when(k % 3 == 0, F.col("value"))
    return table(spark, sf, "events").select("event_id", text.chosen_fps(custom, (k % 4).cast("double") * 10).alias("fps"))


LABELS = [*text.RATE_NAMES, "Custom: []", "Custom: [50M]", "Custom: [18]", "Custom: [a] b]", "Custom", "fast", "Custom: ["]


@query(
    "e8_rate_labels",
    "SELECT p_partkey, mode, coalesce(value, '') AS value, CASE WHEN mode = 'Custom' THEN 'Custom: [' || coalesce(value, '') || ']' ELSE mode END AS stored FROM (SELECT p_partkey, "
    f"CASE WHEN l LIKE 'Custom: [%]' THEN 'Custom' WHEN l IN ({', '.join(repr(n) for n in text.RATE_NAMES)}) THEN l ELSE 'Lossless' END AS mode, CASE WHEN l LIKE 'Custom: [%]' THEN substr(l, 10, length(l) - 10) END AS value "
    f"FROM (SELECT p_partkey, {pick_sql(f'p_partkey % {len(LABELS)}', LABELS)} AS l FROM part))",
)
def e8(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", pick(F.col("p_partkey") % len(LABELS), LABELS).alias("l"))
    mode, value = text.rate_mode(F.col("l")), text.rate_value(F.col("l"))
    return p.select("p_partkey", mode.alias("mode"), F.coalesce(value, F.lit("")).alias("value"), text.rate_label(mode, value).alias("stored"))
