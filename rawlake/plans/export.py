"""Batch export planning.

The plan is a table with one row per output: names, encoder, pixel format and
the encoder's argument list. Nothing is run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import text
from rawlake.operators.ordered import running_total
from rawlake.session import attach, small_table

# ---------------------------------------------------------------------------
# Pixel formats and arguments per codec family.
# family, encoder (* = any other), profile (* = any), wide gamut (None = both),
# codec (None = the encoder itself), pixel format, arguments
# ---------------------------------------------------------------------------
CODEC_PLAN = [
    ("ProRes", "*", "Proxy", False, None, "yuv422p10le", "-profile:v 0"),
    ("ProRes", "*", "Proxy", True, None, "gbrp10le", "-profile:v 0"),
    ("ProRes", "*", "LT", False, None, "yuv422p10le", "-profile:v 1"),
    ("ProRes", "*", "LT", True, None, "gbrp10le", "-profile:v 1"),
    ("ProRes", "*", "Standard", False, None, "yuv422p10le", "-profile:v 2"),
    ("ProRes", "*", "Standard", True, None, "gbrp10le", "-profile:v 2"),
    ("ProRes", "*", "HQ", False, None, "yuv422p10le", "-profile:v 3"),
    ("ProRes", "*", "HQ", True, None, "gbrp10le", "-profile:v 3"),
    ("ProRes", "*", "4444", None, None, "yuva444p10le", "-profile:v 4"),
    ("ProRes", "*", "4444 XQ", None, None, "yuva444p12le", "-profile:v 5"),
    ("DNxHR", "*", "SQ", None, "dnxhd", "yuv422p10le", "-profile:v dnxhr_sq"),
    ("DNxHR", "*", "HD", None, "dnxhd", "yuv422p10le", "-profile:v dnxhr_hd"),
    ("DNxHR", "*", "HDX", None, "dnxhd", "yuv422p10le", "-profile:v dnxhr_hdx"),
    ("DNxHR", "*", "HQX", None, "dnxhd", "yuv422p10le", "-profile:v dnxhr_hqx"),
    ("DNxHR", "*", "444", None, "dnxhd", "yuv444p10le", "-profile:v dnxhr_444"),
    ("HEVC", "libx265", "*", True, "libx265", "gbrp10le", ""),
    ("HEVC", "libx265", "Main 10 4:2:0", False, "libx265", "yuv420p10le", "-preset slow"),
    ("HEVC", "libx265", "Main 10 4:4:4", False, "libx265", "yuv444p10le", "-preset slow"),
    ("HEVC", "hevc_nvenc", "*", None, "hevc_nvenc", "p010le", "-preset p6"),
    ("HEVC", "hevc_amf", "*", None, "hevc_amf", "p010le", "-quality quality"),
    ("HEVC", "hevc_qsv", "*", None, "hevc_qsv", "p010le", ""),
    ("HEVC", "hevc_videotoolbox", "*", None, "hevc_videotoolbox", "p010le", "-realtime true"),
    ("HEVC", "*", "*", True, "libx265", "gbrp10le", "-preset slow"),
    ("HEVC", "*", "Main 10 4:2:0", False, "libx265", "yuv420p10le", "-pix_fmt yuv420p10le -preset slow"),
    ("HEVC", "*", "Main 10 4:4:4", False, "libx265", "yuv444p10le", "-pix_fmt yuv444p10le -preset slow"),
    ("H.264", "*", "*", True, "libx265", "gbrp10le", "-pix_fmt gbrp10le"),
    ("H.264", "h264_nvenc", "High 10-bit", False, "h264_nvenc", "p010le", "-preset p6 -profile:v high10"),
    ("H.264", "h264_nvenc", "Main 8-bit", False, "h264_nvenc", "yuv420p", "-preset p6"),
    ("H.264", "h264_amf", "High 10-bit", False, "h264_amf", "p010le", "-quality quality"),
    ("H.264", "h264_amf", "Main 8-bit", False, "h264_amf", "yuv420p", "-quality quality"),
    ("H.264", "h264_qsv", "High 10-bit", False, "h264_qsv", "p010le", ""),
    ("H.264", "h264_qsv", "Main 8-bit", False, "h264_qsv", "yuv420p", ""),
    ("H.264", "h264_videotoolbox", "High 10-bit", False, "h264_videotoolbox", "p010le", "-realtime true"),
    ("H.264", "h264_videotoolbox", "Main 8-bit", False, "h264_videotoolbox", "yuv420p", "-realtime true"),
    ("H.264", "*", "Main 8-bit", False, "libx264", "yuv420p", "-preset slow"),
    ("H.264", "*", "High 10-bit", False, "libx264", "yuv422p10le", "-preset slow"),
    ("AV1", "av1_nvenc", "Profile 0 4:2:0 10-bit", None, "av1_nvenc", "p010le", "-preset p6"),
    ("AV1", "av1_nvenc", "Profile 1 4:4:4 10-bit", None, "av1_nvenc", "yuv444p10le", "-preset p6"),
    ("AV1", "av1_amf", "Profile 0 4:2:0 10-bit", None, "av1_amf", "p010le", "-quality quality"),
    ("AV1", "av1_amf", "Profile 1 4:4:4 10-bit", None, "av1_amf", "yuv444p10le", "-quality quality"),
    ("AV1", "av1_qsv", "Profile 0 4:2:0 10-bit", None, "av1_qsv", "p010le", ""),
    ("AV1", "av1_qsv", "Profile 1 4:4:4 10-bit", None, "av1_qsv", "yuv444p10le", ""),
    ("AV1", "*", "Profile 0 4:2:0 10-bit", None, "libsvtav1", "yuv420p10le", "-preset 8"),
    ("AV1", "*", "Profile 1 4:4:4 10-bit", None, "libsvtav1", "yuv444p10le", "-preset 8"),
    ("VP9", "*", "Profile 2 4:2:0 10-bit", None, "libvpx-vp9", "yuv420p10le", ""),
    ("VP9", "*", "Profile 3 4:4:4 10-bit", None, "libvpx-vp9", "yuv444p10le", ""),
]
WIDE_FILTER = "scale=flags=accurate_rnd+full_chroma_int:out_color_matrix=bt2020nc:out_range=full,format="
QUALITY = {"Lossless": "16", "High Quality": "20", "Standard": "24"}
QUALITY_WORD = {"Lossless": "lossless", "High Quality": "max", "Standard": "high"}
BITRATE = {"Master 400M": "400M", "Standard 150M": "150M"}
SOFTWARE_ENCODER = {"VP9": "libvpx-vp9"}


def dim_codec_plan(spark: SparkSession) -> DataFrame:
    """One row per family, encoder, profile and gamut width, wildcards resolved."""
    rows = {}
    for family, profile, _, _ in vocab.CODEC_PROFILE:
        known = {e for f, e, *_ in CODEC_PLAN if f == family}
        for encoder in known | {"*"}:
            for wide in (False, True):
                for f, e, p, w, codec, pix, args in CODEC_PLAN:
                    fits = f == family and p in ("*", profile) and w in (None, wide) and e in ("*", encoder)
                    key = (family, encoder, profile, wide)
                    if fits and (key not in rows or e == encoder):
                        rows[key] = (codec, pix, args)
    return small_table(
        spark,
        [(*k, *v) for k, v in sorted(rows.items())],
        "family string, encoder string, profile string, wide boolean, codec string, pix_fmt string, args string",
    )


def best_encoders(probes: DataFrame, key: str = "host", blob: str = "encoders") -> DataFrame:
    """Best encoder per family that a probe's text names, else the fallback.

    One row per probe and family. The candidates are four short lists, so each
    is a chain of tests on the row's own text and nothing is joined.
    """
    picks = []
    for family, (names, last) in vocab.ENCODER_PRIORITY.items():
        chosen = F.coalesce(*[F.when(F.contains(F.col(blob), F.lit(n)), n) for n in names])
        picks.append(
            F.struct(
                F.lit(family).alias("family"),
                F.coalesce(chosen, F.lit(last)).alias("encoder"),
                (chosen.isNotNull() & ~F.coalesce(chosen, F.lit("lib")).startswith("lib")).alias("is_hw"),
            )
        )
    return probes.select(key, F.inline(F.array(*picks)))


def with_profile(presets: DataFrame) -> DataFrame:
    """The one profile that applies to each preset's codec family."""
    chosen = F.when(F.lit(False), F.lit(""))
    for family, column in vocab.PROFILE_COLUMN.items():
        chosen = chosen.when(F.col("codec_family") == family, F.col(column))
    return presets.withColumn("profile", chosen)


def blocked(transfer: Column, family: Column, profile: Column) -> Column:
    """a log or HDR curve cannot go to an 8-bit profile."""
    log_curves = [n for n, high in vocab.TRANSFER if high]
    eight = F.lit(False)
    for f, p, is_8bit, _ in vocab.CODEC_PROFILE:
        if is_8bit:
            eight = eight | ((family == f) & (profile == p))
    return transfer.isin(log_curves) & eight


def apply_presets(clips: DataFrame, presets: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Every setting of a preset on every clip of its batch.

    ``on`` names the batch key, by which presets are unique; clips of a batch without
    preset stay, with null settings. Without it the presets must be the single preset of
    the whole run, and any other number of them is an error.
    """
    if on:
        return attach(clips, presets, on, "left", spread=[c for c in clips.columns if c not in on])
    found = presets.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a run without batch key needs exactly one preset")
    kinds = dict(presets.dtypes)
    return clips.withColumns({c: F.lit(found[0][c]).cast(kinds[c]) for c in presets.columns})


NO_PRESET = "no preset for the batch"
TOO_FEW_BITS = "a log curve cannot go to an 8-bit profile"


def is_wide(gamut: Column) -> Column:
    return ~gamut.isin(*vocab.FIXED_MATRIX_GAMUTS)


def _args(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _list(*items) -> Column:
    return F.array(*[i if isinstance(i, Column) else F.lit(i) for i in items]).cast("array<string>")


def rate_args(mode: Column, value: Column, encoder: Column) -> Column:
    """Quality or bit-rate arguments for an encoder."""
    apple = encoder.endswith("_videotoolbox")
    hardware = ~encoder.startswith("lib")
    pinned = encoder.isin("libvpx-vp9", "libaom-av1")

    def quality(v) -> Column:
        return (
            F.when(apple, _list("-quality", v))
            .when(hardware, _list("-cq", v))
            .when(pinned, _list("-crf", v, "-b:v", "0"))
            .otherwise(_list("-crf", v))
        )

    def bitrate(v) -> Column:
        base = _list("-b:v", v, "-maxrate", v)
        return F.when(encoder.endswith("_nvenc"), F.concat(base, _list("-rc:v", "vbr"))).otherwise(base)

    named = F.when(F.lit(False), _list())
    for name, v in QUALITY.items():
        named = named.when(mode == name, F.when(apple, _list("-quality", QUALITY_WORD[name])).otherwise(quality(v)))
    for name, v in BITRATE.items():
        named = named.when(mode == name, bitrate(v))
    number = r"(?i)^[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"
    empty = F.coalesce(value, F.lit("")) == ""
    unit = F.upper(value)
    custom = (
        F.when(empty, _list())
        .when(unit.endswith("M") | unit.endswith("K"), bitrate(value))
        .when(value.rlike(number), quality(value))
        .otherwise(_list(value))
    )
    return named.otherwise(custom)


def wide_filter(wide: Column, pix_fmt: Column) -> Column:
    """Scale filter for wide gamuts, unless the format is planar RGB."""
    planar = pix_fmt.startswith("gbrp") | pix_fmt.startswith("rgb")
    return F.when(wide & ~planar, _list("-vf", F.concat(F.lit(WIDE_FILTER), pix_fmt))).otherwise(_list())


def vui_args(gamut: Column, transfer: Column) -> Column:
    """Colour tags of the stream."""
    primaries = vocab.lookup(gamut, {g: v[0] for g, v in vocab.VUI_GAMUT.items()}, vocab.VUI_GAMUT_OTHER[0])
    matrix = vocab.lookup(gamut, {g: v[1] for g, v in vocab.VUI_GAMUT.items()}, vocab.VUI_GAMUT_OTHER[1])
    trc = vocab.lookup(transfer, vocab.VUI_TRANSFER, "unknown")
    return _list("-color_primaries", primaries, "-color_trc", trc, "-colorspace", matrix)


def codec_columns(jobs: DataFrame) -> DataFrame:
    """Codec, pixel format and base arguments, from family, encoder, profile, gamut."""
    spark = jobs.sparkSession
    plan = dim_codec_plan(spark)
    by_family: dict[str, list[str]] = {}
    for family, encoder in sorted({(f, e) for f, e, *_ in CODEC_PLAN if e != "*"}):
        by_family.setdefault(family, []).append(encoder)
    listed = F.lit(False)
    for family, names in by_family.items():
        listed = listed | ((F.col("codec_family") == family) & F.col("encoder").isin(names))
    keyed = jobs.withColumns({"wide": is_wide(F.col("color_space")), "_enc": F.when(listed, F.col("encoder")).otherwise("*")})
    dim = plan.select(
        F.col("family").alias("codec_family"), F.col("encoder").alias("_enc"), "profile", "wide",
        F.col("codec").alias("_codec"), "pix_fmt", F.col("args").alias("_args"),
    )
    # under 200 rows, fixed
    out = keyed.join(F.broadcast(dim), ["codec_family", "_enc", "profile", "wide"], "left")
    return out.withColumns({"codec": F.coalesce("_codec", "encoder"), "base_args": _args(F.col("_args"))}).drop(
        "_enc", "_codec", "_args"
    )


def codec_args(jobs: DataFrame) -> DataFrame:
    """All codec arguments in their order."""
    out = codec_columns(jobs)
    rated = ~F.col("codec_family").isin("ProRes", "DNxHR")
    mode, value = text.rate_mode(F.col("rate_control")), text.rate_value(F.col("rate_control"))
    rate = F.when(rated, rate_args(mode, value, F.col("encoder"))).otherwise(_list())
    return out.withColumn(
        "codec_args",
        F.concat(
            "base_args",
            wide_filter(F.col("wide"), F.col("pix_fmt")),
            rate,
            vui_args(F.col("color_space"), F.col("transfer_function")),
        ),
    )


def command(jobs: DataFrame, audio: str = "audio_path") -> DataFrame:
    """E5: argument list of the encoder run, as text only."""
    has_audio = F.col(audio).isNotNull()
    target = F.lower("output_path")
    movie = target.endswith(".mp4") | target.endswith(".mov")
    size = F.concat_ws("x", F.col("crop_w").cast("string"), F.col("crop_h").cast("string"))
    sound_in = _list(
        "-f", "s16le", "-ar", F.col("audio_sample_rate").cast("string"),
        "-ac", F.col("audio_channels").cast("string"), "-i", F.col(audio),
    )
    sound_codec = F.when(target.endswith(".mov"), "pcm_s16le").otherwise("aac")
    return jobs.withColumn(
        "command",
        F.concat(
            _list("-f", "rawvideo", "-pix_fmt", "rgb48le", "-s", size, "-r", text.number_text(F.col("out_fps")), "-i", "-"),
            F.when(has_audio, sound_in).otherwise(_list()),
            _list("-c:v", F.col("codec"), "-pix_fmt", F.col("pix_fmt")),
            "codec_args",
            F.when(movie, _list("-movflags", "+faststart")).otherwise(_list()),
            F.when(has_audio, _list("-c:a", sound_codec)).otherwise(_list()),
            _list("-y", F.col("output_path")),
        ),
    )


def free_slots(jobs: DataFrame, existing: DataFrame, base: str, order: list[str], taken: str = "slot", **kw) -> DataFrame:
    """Give the k-th job of a name the k-th free number (0 = plain name).

    ``existing`` has one row per taken number of a name. With taken numbers
    t0 < t1 < ... the k-th free number is k plus how many i have t_i - i <= k,
    which is a running count after a merge of both lists. So a name shared by
    any number of jobs is never gathered in one place.
    """
    used = existing.select(base, F.col(taken).cast("bigint").alias("_t")).distinct()
    used = used.join(jobs.select(base).distinct(), base, "left_semi").withColumn("_kind", F.lit(0))
    both = jobs.withColumn("_kind", F.lit(1)).unionByName(used, allowMissingColumns=True)
    both = running_total(both, [base, "_kind"], ["_t", *order], F.lit(1), "_k", **kw).withColumn("_k", F.col("_k") - 1)
    merged = both.withColumn("_k", F.when(F.col("_kind") == 1, F.col("_k")).otherwise(F.col("_t") - F.col("_k")))
    merged = merged.withColumn("_n", 1 - F.col("_kind"))
    counted = running_total(merged, [base], ["_k", "_kind"], F.col("_n"), "_shift", **kw)
    out = counted.where(F.col("_kind") == 1).withColumn("slot", F.col("_k") + F.col("_shift"))
    return out.select(*jobs.columns, "slot")


def output_names(jobs: DataFrame) -> DataFrame:
    """Folder, stem and extension of the wanted output."""
    folder = F.coalesce(F.col("export_folder"), text.parent_folder(F.col("path")))
    stem = text.output_stem(text.file_stem(F.col("path")), F.col("transfer_function"), F.col("color_space"))
    sep = F.when((folder == "") | folder.endswith("/"), "").otherwise("/")
    return jobs.withColumns(
        {"out_base": F.concat(folder, sep, stem), "out_ext": text.file_extension(F.col("codec_family"))}
    )


def slot_path(base: Column, slot: Column, ext: Column, cut_at_dot: bool = False) -> Column:
    """Path of a slot. With ``cut_at_dot`` a suffixed name loses what follows
    the last dot of its own stem, as replacing the extension does."""
    numbered = F.concat_ws("_", base, slot.cast("string"))
    if cut_at_dot:
        numbered = F.regexp_replace(numbered, r"^(.*[^/])\.[^./]*$", "$1")
    return F.concat(F.when(slot == 0, base).otherwise(numbered), F.lit("."), ext)


def taken_slots(paths: DataFrame, path: str = "path") -> DataFrame:
    """Existing output paths as (name, number) pairs, plain names as 0.

    Longer numbers than 18 digits are part of a plain name: no count of jobs reaches them.
    """
    p = F.col(path)
    plain = F.regexp_replace(p, r"\.[^./]*$", "")
    ext = F.regexp_extract(p, r"\.([^./]*)$", 1)
    zero = F.struct(plain.alias("out_base"), ext.alias("out_ext"), F.lit(0).cast("bigint").alias("slot"))
    cut = F.regexp_replace(plain, r"_[1-9][0-9]{0,17}$", "")
    number = F.try_to_number(F.regexp_extract(plain, r"_([1-9][0-9]{0,17})$", 1), F.lit("9" * 18)).cast("bigint")
    suffixed = F.when(number.isNotNull(), F.struct(cut.alias("out_base"), ext.alias("out_ext"), number.alias("slot")))
    return paths.select(F.inline(F.array_compact(F.array(zero, suffixed)))).distinct()


def export_plan(
    queue: DataFrame, presets: DataFrame, encoders: DataFrame, existing: DataFrame,
    on: list[str] | None = None, order: list[str] = ["seq"], **kw,
) -> DataFrame:
    """One row per selected waiting job, with everything its run needs.

    ``queue`` holds jobs with their clip columns, ``presets`` one row per batch
    key, ``encoders`` one row per family, ``existing`` the output paths present.
    Jobs that cannot run have the reason in ``rejected`` (blocked by F4, or without
    preset), take no output name and have no command.
    """
    ready = queue.where(F.col("selected") & (F.col("status") == "Waiting"))
    jobs = with_profile(apply_presets(ready, presets, on))
    stopped = F.coalesce(blocked(F.col("transfer_function"), F.col("codec_family"), F.col("profile")), F.lit(False))
    reason = F.when(F.col("transfer_function").isNull(), NO_PRESET).when(stopped, TOO_FEW_BITS)
    jobs = jobs.withColumn("rejected", reason)
    refused, jobs = jobs.where(F.col("rejected").isNotNull()), jobs.where(F.col("rejected").isNull())
    # six families, fixed
    picks = encoders.select(F.col("family").alias("codec_family"), F.col("encoder").alias("_pick"))
    jobs = jobs.join(F.broadcast(picks), "codec_family", "left")
    soft = F.when(F.col("codec_family") == "VP9", SOFTWARE_ENCODER["VP9"]).when(F.col("codec_family") == "DNxHR", "dnxhd")
    jobs = jobs.withColumn("encoder", F.coalesce("_pick", soft)).drop("_pick")
    jobs = output_names(jobs)
    keyed = jobs.withColumn("_name", F.concat_ws(".", "out_base", "out_ext"))
    used = taken_slots(existing).select(F.concat_ws(".", "out_base", "out_ext").alias("_name"), "slot")
    placed = free_slots(keyed, used, "_name", order, **kw).drop("_name")
    placed = placed.withColumn("output_path", slot_path(F.col("out_base"), F.col("slot"), F.col("out_ext")))
    placed = placed.withColumn("out_fps", text.chosen_fps(F.col("custom_fps"), F.col("fps")))
    return command(codec_args(placed)).unionByName(refused, allowMissingColumns=True)
