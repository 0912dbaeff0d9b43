"""Labels, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions.numeric import fixed_text, half_even, round_half_away


def two_digits(value: Column) -> Column:
    """At least two digits; longer numbers are kept whole."""
    text = value.cast("bigint").cast("string")
    return F.when(value < 10, F.concat(F.lit("0"), text)).otherwise(text)


def duration(seconds: Column) -> Column:
    """``H:MM:SS`` or ``M:SS``, seconds truncated."""
    total = F.floor(seconds)
    hours = F.floor(total / 3600)
    minutes = F.floor((total % 3600) / 60)
    tail = F.concat(F.lit(":"), two_digits(total % 60))
    long = F.concat(hours.cast("string"), F.lit(":"), two_digits(minutes), tail)
    short = F.concat(minutes.cast("string"), tail)
    return F.when(seconds <= 0, "0:00").when(hours > 0, long).otherwise(short)


def size_label(size: Column) -> Column:
    """Size in B, KB, MB or GB with two decimals, ties to even."""
    size = size.cast("bigint")

    def scaled(unit: int, name: str) -> Column:
        rest = (size % unit) * 100
        hundredths = ((size - size % unit) / unit).cast("bigint") * 100 + ((rest - rest % unit) / unit).cast("bigint")
        over = (rest % unit) * 2
        up = (over > unit) | ((over == unit) & (hundredths % 2 == 1))
        value = hundredths + F.when(up, 1).otherwise(0)
        return F.concat(fixed_text(value, 2), F.lit(f" {name}"))

    return (
        F.when(size >= 1024**3, scaled(1024**3, "GB"))
        .when(size >= 1024**2, scaled(1024**2, "MB"))
        .when(size >= 1024, scaled(1024, "KB"))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def exposure_label(seconds: Column) -> Column:
    """``1/Ns`` for N up to 10000, else seconds with two decimals."""
    inverse = round_half_away(F.try_divide(F.lit(1.0), seconds))
    fraction = F.concat(F.lit("1/"), inverse.cast("string"), F.lit("s"))
    plain = F.concat(fixed_text(half_even(seconds, 2), 2), F.lit("s"))
    return (
        F.when(seconds <= 0, "Unknown")
        .when((inverse > 0) & (inverse <= 10000), fraction)
        .otherwise(plain)
    )


def capture_date(raw: Column) -> Column:
    """C4: ``date time`` and a zone if one follows; short text is kept."""
    text = F.trim(raw)
    stamp = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8))
    zone = F.trim(F.substring(text, F.lit(20), F.greatest(F.length(text) - 19, F.lit(0))))
    return F.when(F.length(text) >= 19, F.concat(stamp, zone)).otherwise(text)


def timecode(frame: Column, fps: Column) -> Column:
    """``HH:MM:SS:FF`` of a frame number."""
    seconds = F.when(fps > 0, F.try_divide(frame.cast("double"), fps)).otherwise(F.lit(0.0))
    parts = [
        F.floor(seconds / 3600.0),
        F.floor((seconds % 3600.0) / 60.0),
        F.floor(seconds % 60.0),
        F.floor((seconds - F.floor(seconds).cast("double")) * fps),
    ]
    return F.concat_ws(":", *[two_digits(p) for p in parts])


def fps_label(fps: Column) -> Column:
    """Name of a preset rate within 0.001, else three decimals."""
    label = F.when(fps.isNull(), "Original")
    for value, name in zip(vocab.FPS, vocab.FPS_LABEL):
        label = label.when(F.abs(fps - value) < 0.001, name)
    return label.otherwise(fixed_text(half_even(fps, 3), 3))


def resolution_label(width: Column, height: Column) -> Column:
    """Name of an exact frame size."""
    sizes = {f"{w}x{h}": label for w, h, label in vocab.RESOLUTION}
    return vocab.lookup(F.concat_ws("x", width.cast("int"), height.cast("int")), sizes, "Custom")


def format_label(version: Column) -> Column:
    """Name of a container version."""
    return vocab.lookup(version.cast("int"), vocab.FORMAT_NAME, "Unknown format")


def aspect_number(width: Column, height: Column) -> Column:
    """Long side over short side, rounded."""
    long, short = F.greatest(width, height), F.least(width, height)
    return round_half_away(F.try_divide(long.cast("double"), short.cast("double")))


def file_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def clip_stem(path: Column) -> Column:
    """Stem without any trailing ``-metadata`` marks."""
    return F.regexp_replace(file_stem(path), r"(-metadata)+$", "")


def parent_folder(path: Column) -> Column:
    """Folder of a path; empty for a bare name."""
    cut = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when((cut == "") & path.startswith("/"), "/").otherwise(cut)


def plain_label(label: Column) -> Column:
    """Label without spaces, brackets and dots, for use in a file name."""
    return F.translate(label, " ().", "")


def file_extension(family: Column) -> Column:
    return F.when(family.isin("ProRes", "DNxHR"), "mov").when(family == "VP9", "webm").otherwise("mp4")


def output_stem(stem: Column, transfer: Column, gamut: Column) -> Column:
    """``{stem}_{curve}_{gamut}``."""
    return F.concat_ws("_", stem, plain_label(transfer), plain_label(gamut))


def clean_path(raw: Column, home: str) -> Column:
    """Path of dropped text: quotes, ``~``, ``file://`` and percent codes."""
    text = F.trim(raw)
    text = F.regexp_replace(text, r"""(?s)^(["'])(.*)\1$""", "$2")
    text = (
        F.when(text == "~", F.lit(home))
        .when(text.startswith("~/"), F.concat(F.lit(home), F.substring(text, F.lit(2), F.length(text))))
        .otherwise(text)
    )
    text = F.regexp_replace(text, r"^file://[^/]*/", "/")
    text = F.regexp_replace(text, r"^file://", "")
    return percent_decoded(text)


def percent_decoded(text: Column) -> Column:
    """Percent codes as UTF-8; stray percent signs stay, bad UTF-8 keeps the text."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    safe = F.regexp_replace(safe, r"\+", "%2B")
    decoded = F.try_url_decode(safe)
    broken = decoded.isNull() | (decoded.contains("�") & ~text.contains("�"))
    return F.when(~text.contains("%"), text).when(broken, text).otherwise(decoded)


def clock(seconds: Column) -> Column:
    return F.concat(two_digits(F.floor(seconds / 60)), F.lit(":"), two_digits(seconds % 60))


def remaining_seconds(elapsed: Column, percent: Column) -> Column:
    """Seconds left from the elapsed time and the progress, never negative."""
    estimate = F.floor(F.try_divide(elapsed, percent) * 100.0)
    estimate = F.when(percent > 0, estimate).otherwise(F.lit(0))
    return F.greatest(estimate - F.floor(elapsed), F.lit(0))


def chosen_fps(custom: Column, clip: Column) -> Column:
    """The custom rate, else the clip's, else 25."""
    return F.coalesce(custom, F.when(clip > 0, clip), F.lit(25.0))


def number_text(value: Column) -> Column:
    """Shortest text of a number; whole numbers without a fraction."""
    whole = value == F.floor(value).cast("double")
    return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))


RATE_NAMES = ["Lossless", "High Quality", "Standard", "Master 400M", "Standard 150M"]


def rate_mode(label: Column) -> Column:
    """Rate mode of a stored label; unknown labels are Lossless."""
    custom = label.startswith("Custom: [") & label.endswith("]") & (F.length(label) >= 10)
    return F.when(custom, "Custom").when(label.isin(*RATE_NAMES), label).otherwise("Lossless")


def rate_value(label: Column) -> Column:
    """Text between the brackets of a custom label, else null."""
    inner = F.substring(label, F.lit(10), F.greatest(F.length(label) - 10, F.lit(0)))
    return F.when(rate_mode(label) == "Custom", inner)


def rate_label(mode: Column, value: Column) -> Column:
    """The label that is stored for a mode and a custom value."""
    custom = F.concat(F.lit("Custom: ["), F.coalesce(value, F.lit("")), F.lit("]"))
    return F.when(mode == "Custom", custom).otherwise(mode)
