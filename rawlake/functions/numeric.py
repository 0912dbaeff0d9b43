"""Numbers and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rawlake import vocab


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def half_even(value: Column, places: int) -> Column:
    """``value`` times ``10^places`` as a whole number, ties to even.

    Rounds the exact binary value: the value is split so that the product of
    the high part is exact and the low part only decides near ties.
    """
    scale = F.lit(float(10**places))
    high = F.floor(value * F.lit(1048576.0)).cast("double") / F.lit(1048576.0)
    low = value - high
    whole = F.floor(high * scale)
    part = (high * scale - whole.cast("double")) + low * scale
    up = (part > 0.5) | ((part == 0.5) & (whole % 2 == 1))
    return whole + F.when(up, 1).otherwise(0)


def fixed_text(scaled: Column, places: int) -> Column:
    """A whole number of ``10^-places`` units as a decimal string."""
    unit = 10**places
    whole = F.floor(scaled / F.lit(unit)).cast("string")
    rest = F.lpad((scaled % F.lit(unit)).cast("string"), places, "0")
    return F.concat(whole, F.lit("."), rest)


def bit_depth(white: Column) -> Column:
    """C20: sensor bit depth from the white level."""
    return (
        F.when(white <= 1024, 10)
        .when(white <= 4096, 12)
        .when(white <= 16384, 14)
        .when(white <= 65536, 16)
        .otherwise(12)
    )


def bayer_name(code: Column) -> Column:
    """Pattern of a code; unknown codes are RGGB."""
    return vocab.lookup(code.cast("int"), {c: n for c, n, _, _ in vocab.BAYER}, "RGGB")


def bayer_code(name: Column) -> Column:
    return vocab.lookup(name, {n: c for c, n, _, _ in vocab.BAYER}, 0)


def bayer_label(name: Column) -> Column:
    return vocab.lookup(name, {n: label for _, n, label, _ in vocab.BAYER}, "RGGB")


def bayer_filters(name: Column) -> Column:
    return vocab.lookup(name, {n: w for _, n, _, w in vocab.BAYER}, vocab.BAYER[0][3])


def cfa_at(pattern: Column, odd_row: Column, odd_col: Column) -> Column:
    """Filter colour (0 red, 1 green, 2 blue) of a site; quad patterns read as RGGB."""
    tables = {name: "".join(map(str, codes)) for name, codes in vocab.CFA.items()}
    codes = vocab.lookup(pattern, tables, tables["RGGB"])
    pos = odd_row.cast("int") * 2 + odd_col.cast("int") + 1
    return F.substring(codes, pos, F.lit(1)).cast("int")


def cfa_shifted(pattern: Column, offset_x: Column, offset_y: Column) -> Column:
    """The 2x2 filter block seen from a crop offset, as an array of four codes."""
    ox, oy = offset_x % 2 == 1, offset_y % 2 == 1
    sites = [(r, c) for r in (False, True) for c in (False, True)]
    return F.array(*[cfa_at(pattern, oy != F.lit(r), ox != F.lit(c)) for r, c in sites])


def site_color(pattern: Column, x: Column, y: Column) -> Column:
    """Filter colour at a pixel, for any sign of x and y."""
    return cfa_at(pattern, F.pmod(y, F.lit(2)) == 1, F.pmod(x, F.lit(2)) == 1)


def lens_channel(pattern: Column, x: Column, y: Column) -> Column:
    """Lens-grid channel: 0 red, 3 blue, green 1 on even rows and 2 on odd rows."""
    color = site_color(pattern, x, y)
    return F.when(color == 0, 0).when(color == 2, 3).when(F.pmod(y, F.lit(2)) == 0, 1).otherwise(2)


def neutral_ok(neutral: Column) -> Column:
    """F16: all three neutral values are usable."""
    n = [F.get(neutral, i) for i in range(3)]
    return F.coalesce((n[0] > 1e-6) & (n[1] > 1e-6) & (n[2] > 1e-6), F.lit(False))


def wb_gains(neutral: Column) -> Column:
    """Gains (G/R, 1, G/B), null without a usable neutral."""
    r, g, b = (F.get(neutral, i) for i in range(3))
    return F.when(neutral_ok(neutral), F.array(g / r, F.lit(1.0), g / b))


def wb_gain_clamped(green: Column, other: Column) -> Column:
    """One export gain, 1 without usable values, within [0.1, 10]."""
    usable = (other > 1e-6) & (green > 1e-6)
    return clamp(F.when(usable, F.try_divide(green, other)).otherwise(F.lit(1.0)), 0.1, 10.0)


def temperature_from_gains(red: Column, blue: Column) -> Column:
    """Slider temperature from the gain ratio."""
    ratio = clamp(red / F.greatest(blue, F.lit(1e-6)), 0.1, 10.0)
    warm = F.lit(5200.0) + (ratio - 1.0) * 3000.0
    cool = F.lit(5200.0) - (F.lit(1.0) - ratio) * 3000.0
    temp = clamp(F.when(ratio >= 1.0, warm).otherwise(cool), 2000.0, 10000.0)
    return F.when(red.isNull() | blue.isNull(), F.lit(5200.0)).otherwise(temp)


def gains_from_temperature(temperature: Column, tint: Column) -> list[Column]:
    """Preview gains (r, g, b) of the temperature and tint sliders."""
    shift = (temperature - 5200.0) / 10000.0
    return [F.lit(1.0) + shift, F.lit(1.0), F.lit(1.0) - shift + tint / 100.0]


def aspect_fit(width: Column, height: Column, box_w: int = 320, box_h: int = 180) -> list[Column]:
    """Largest size with the frame's aspect ratio inside a box."""
    aspect = width.cast("double") / height.cast("double")
    wide = aspect > F.lit(box_w / box_h)
    fit_h = F.greatest(F.floor(F.lit(float(box_w)) / aspect).cast("int"), F.lit(1))
    fit_w = F.greatest(F.floor(F.lit(float(box_h)) * aspect).cast("int"), F.lit(1))
    return [F.when(wide, F.lit(box_w)).otherwise(fit_w), F.when(wide, fit_h).otherwise(F.lit(box_h))]


def round_half_away(value: Column) -> Column:
    """Nearest whole number, halves away from zero, on the exact binary value."""
    mag = F.floor(F.abs(value))
    mag = mag + F.when(F.abs(value) - mag.cast("double") >= 0.5, 1).otherwise(0)
    return F.when(value < 0, -mag).otherwise(mag)


def signed_rational(value: Column) -> Column:
    """Value as a fraction with denominator 10000, saturating like a 32-bit cast."""
    scaled = round_half_away(F.nanvl(value, F.lit(0.0)) * 10000.0)
    n = F.least(F.greatest(scaled, F.lit(-2147483648)), F.lit(2147483647)).cast("int")
    return F.struct(n.alias("n"), F.lit(10000).alias("d"))


def bit_length(value: Column) -> Column:
    """Number of bits of a non-negative whole number (0 for 0)."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value)))


def extended_white(white: Column) -> Column:
    """White level with two bits of headroom, at most 16 bits."""
    word = F.least(F.greatest(F.floor(white), F.lit(0)), F.lit(65535)).cast("bigint")
    bits = F.least(F.greatest(bit_length(word), F.lit(1)) + 2, F.lit(16))
    return F.pow(F.lit(2.0), bits).cast("bigint") - 1


def to_u16(value: Column) -> Column:
    """16-bit code of a 0..1 value, truncated; NaN is 0."""
    return F.floor(clamp(F.nanvl(value, F.lit(0.0)), 0.0, 1.0) * 65535.0).cast("int")


def duration_seconds(frames: Column, fps: Column) -> Column:
    """Clip length; null where the rate is zero."""
    return F.try_divide(frames.cast("double"), fps)


def smoothstep(edge0: float, edge1: float, x: Column) -> Column:
    """Smooth ramp from 0 to 1 between two edges."""
    t = clamp((x - edge0) / F.lit(edge1 - edge0), 0.0, 1.0)
    return t * t * (F.lit(3.0) - t * 2.0)


def level_stats(levels: Column) -> list[Column]:
    """Mean, count and the list padded to four entries with the mean."""
    total = F.aggregate(levels, F.lit(0.0), lambda acc, v: acc + v)
    count = F.coalesce(F.size(levels), F.lit(0))
    count = F.when(levels.isNull(), 0).otherwise(count)
    mean = F.when(count > 0, F.try_divide(total, count.cast("double"))).otherwise(F.lit(0.0))
    padded = F.array(*[F.coalesce(F.get(levels, i), mean) for i in range(4)])
    return [mean, count, padded]


def has_colour_matrix(matrix: Column) -> Column:
    """some element has a magnitude between 0.01 and 10."""
    found = F.exists(matrix, lambda v: (F.abs(v) > 0.01) & (F.abs(v) < 10.0))
    return F.coalesce(found, F.lit(False))


def non_zero_matrix(matrix: Column) -> Column:
    """the matrix, or null if every element is zero."""
    return F.when(F.exists(matrix, lambda v: v != 0.0), matrix)


def grade_active(sliders: dict[str, Column]) -> Column:
    """some slider is away from its default by more than its threshold."""
    active = F.lit(False)
    for _, field, default, *_, threshold in vocab.SLIDER:
        if threshold is not None:
            active = active | (F.abs(sliders[field] - default) > threshold)
    return active


def active_size(active: Column, full: Column) -> Column:
    """crop size, or the full size where no crop is given."""
    return F.when(active > 0, active).otherwise(full)
