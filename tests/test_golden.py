"""Known values of curves, labels, codes and timers."""

import pytest
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import curves, numeric, text
from rawlake.functions import matrix as mx
from rawlake.operators import develop, preview, stats, tonemap
from rawlake.session import small_table


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "curve, x, want, tol",
    [
        ("Rec.709", 0.01, 0.045, 1e-6),
        ("Rec.709", 1.0, 1.0, 1e-6),
        ("V-Log", 0.01, 0.181, 1e-3),
        ("ARRI LogC3", 0.0, 0.092809, 1e-6),
        ("ARRI LogC4", 0.18, 0.2783958, 1e-6),
        ("ARRI LogC4", 1.0, 0.4275194, 1e-6),
        ("S-Log3", 0.18, 0.4106, 1e-3),
        ("S-Log3", 0.0, 0.0929, 1e-3),
        ("S-Log3", 1.0, 0.596, 1e-3),
        ("HLG (BT.2100)", 1.0 / 12.0, 0.5, 1e-6),
        ("Gamma 2.4", -1.0, 0.0, 0.0),
        ("Linear", 0.3, 0.3, 0.0),
        ("Apple Log", -0.1, 0.0, 0.0),
    ],
)
def test_encode(spark, curve, x, want, tol):
    assert one(spark, curves.ENCODE[curve](F.lit(x))) == pytest.approx(want, abs=tol)


def test_logc4_constants():
    got = (curves.LOGC4_A, curves.LOGC4_B, curves.LOGC4_C, curves.LOGC4_S, curves.LOGC4_T)
    assert got == pytest.approx((2231.8263, 0.90713587, 0.09286413, 0.1135972, -0.0180570), rel=1e-5)


@pytest.mark.parametrize("curve", sorted(curves.ENCODE))
def test_round_trip(spark, curve):
    rows = spark.range(0, 201).select((F.col("id") / 200.0).alias("x"))
    back = curves.DECODE[curve](curves.ENCODE[curve](F.col("x")))
    worst = rows.select(F.max(F.abs(back - F.col("x"))).alias("e")).first().e
    assert worst < 2e-4


def test_every_curve_and_gamut_is_known():
    names = {n for n, _ in vocab.TRANSFER}
    assert names == set(curves.ENCODE) == set(curves.DECODE) == set(vocab.TONEMAP_TRANSFER_OF)
    assert {g[0] for g in vocab.GAMUT} == set(vocab.TONEMAP_GAMUT_OF)
    assert set(vocab.TONEMAP_TRANSFER) == set(tonemap.TONE_ENCODE) == set(tonemap.TONE_DECODE)
    assert (len(vocab.GAMUT), len(vocab.TRANSFER), len(vocab.CODEC_PROFILE), len(vocab.TONEMAP_TRANSFER)) == (16, 15, 19, 21)


@pytest.mark.parametrize(
    "white, bits",
    [(0, 10), (1023, 10), (1024, 10), (1025, 12), (4095, 12), (4096, 12), (4097, 14), (16383, 14), (16384, 14),
     (16385, 16), (65535, 16), (65536, 16), (65537, 12)],
)
def test_bit_depth(spark, white, bits):
    assert one(spark, numeric.bit_depth(F.lit(float(white)))) == bits


# one query for all: (column, expected value)
LABELS = lambda: [
    (text.duration(F.lit(0.0)), "0:00"),
    (text.duration(F.lit(-5.0)), "0:00"),
    (text.duration(F.lit(59.9)), "0:59"),
    (text.duration(F.lit(3661.0)), "1:01:01"),
    (text.duration(F.lit(359999.0)), "99:59:59"),
    (text.size_label(F.lit(1023)), "1023 B"),
    (text.size_label(F.lit(1024)), "1.00 KB"),
    (text.size_label(F.lit(1024 * 1024 - 1)), "1024.00 KB"),
    (text.size_label(F.lit(1152)), "1.12 KB"),
    (text.size_label(F.lit(5 * 1024**3)), "5.00 GB"),
    (text.exposure_label(F.lit(0.0)), "Unknown"),
    (text.exposure_label(F.lit(1.0 / 60.0)), "1/60s"),
    (text.exposure_label(F.lit(2.5)), "2.50s"),
    (text.exposure_label(F.lit(2.675)), "2.67s"),
    (text.exposure_label(F.lit(0.00001)), "0.00s"),
    (text.capture_date(F.lit("2024-01-02T03:04:05+02:00")), "2024-01-02 03:04:05+02:00"),
    (text.capture_date(F.lit(" 2024 ")), "2024"),
    (text.timecode(F.lit(100), F.lit(24.0)), "00:00:04:04"),
    (text.timecode(F.lit(100), F.lit(0.0)), "00:00:00:00"),
    (text.fps_label(F.lit(23.976)), "23.976"),
    (text.fps_label(F.lit(29.97)), "29.970"),
    (text.clip_stem(F.lit("/a/b-metadata-metadata.mcraw")), "b"),
    (text.file_stem(F.lit("/a/.hidden")), ".hidden"),
    (text.parent_folder(F.lit("/a/b/c.mcraw")), "/a/b"),
    (text.parent_folder(F.lit("/c.mcraw")), "/"),
    (text.parent_folder(F.lit("c.mcraw")), ""),
    (text.clean_path(F.lit("'file:///a%20b+c%zz'"), "/h"), "/a b+c%zz"),
    (text.clean_path(F.lit("/bad%FF"), "/h"), "/bad%FF"),
    (text.clean_path(F.lit("file://host"), "/h"), "host"),
    (text.number_text(F.lit(30.0)), "30"),
    (text.number_text(F.lit(29.97)), "29.97"),
    (numeric.extended_white(F.lit(1023.0)), 4095),
    (numeric.extended_white(F.lit(0.0)), 7),
    (numeric.extended_white(F.lit(65535.0)), 65535),
    (numeric.to_u16(F.lit(float("nan"))), 0),
    (numeric.to_u16(F.lit(2.0)), 65535),
]


def test_labels_and_codes(spark):
    cases = LABELS()
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_bradford_is_identity_for_equal_whites(spark):
    got = one(spark, F.expr(mx.bradford(mx.constant(vocab.D65))))
    assert got == pytest.approx(mx.IDENTITY, abs=1e-5)


def test_orientation_of_a_known_matrix(spark):
    good = [0.7, 0.2, 0.06422, 0.3, 0.6, 0.1, 0.02, 0.1, 0.70521]
    turned = [good[3 * c + r] for r in range(3) for c in range(3)]
    for given in (good, turned):
        assert one(spark, F.expr(mx.oriented(mx.constant(given)))) == pytest.approx(good)


def test_singular_matrix_never_wins(spark):
    flat = [1.0] * 9
    assert one(spark, F.expr(mx.orientation_pick(mx.constant(flat)))) == 0
    assert one(spark, F.expr(mx.inverse(mx.constant(flat)))) == [None] * 9


def test_normalise(spark):
    px = small_table(spark, [(1000.0, 2000.0, 1500.0)], "r double, g double, b double")
    assert tuple(develop.normalise(px, F.lit(0.0), F.lit(4000.0)).first()) == (0.25, 0.5, 0.375)
    assert tuple(develop.normalise(px, F.lit(9.0), F.lit(9.0)).first()) == (1.0, 1.0, 1.0)


def test_phase_timer(spark):
    rows = [(1, "decode", i * 10_000_000) for i in range(1, 11)] + [(1, "decode", 0), (2, "pack", 5)]
    snap = {r.run_id: r for r in stats.phase_snapshot(small_table(spark, rows, "run_id int, phase string, ns bigint")).collect()}
    assert (snap[1].frames, snap[1].avg_us, snap[1].min_us, snap[1].max_us) == (10, 55_000, 10_000, 100_000)
    assert snap[1].fps == pytest.approx(18.18, abs=0.01)
    assert (snap[2].avg_us, snap[2].stddev_us) == (0, 0)
    even = small_table(spark, [(1, "gpu", 100_000)], "run_id int, phase string, ns bigint").crossJoin(spark.range(8000))
    got = stats.phase_snapshot(even).first()
    assert (got.frames, got.avg_us, got.stddev_us) == (8000, 100, 0)


def test_run_report(spark):
    events = small_table(spark, [(1, "setup", 5), (1, "gpu", 7)], "run_id int, phase string, ns bigint")
    runs = small_table(spark, [(1, 100, 75), (2, 0, 0)], "run_id int, frames_total bigint, gpu_frames bigint")
    got = {r.run_id: r for r in stats.run_report(events, runs).collect()}
    assert (got[1].gpu_path_pct, got[2].gpu_path_pct, got[2].overall_fps) == (75.0, 0.0, 0.0)
    assert got[1].total_wall_secs == 5e-9
    phases = stats.full_phases(stats.phase_snapshot(events), runs)
    assert [r.phase for r in phases.where("run_id = 2").collect()] == vocab.PHASES


def test_histogram_counts_every_pixel(spark):
    px = spark.range(500).select((F.col("id") % 7).alias("frame_id"), *[(F.rand(i) * 1.4 - 0.2).alias(c) for i, c in enumerate("rgb")])
    hist = preview.histogram(px)
    per = hist.groupBy("frame_id", "channel").agg(F.sum("n").alias("n")).groupBy("channel").agg(F.sum("n").alias("n"))
    assert {r.channel: r.n for r in per.collect()} == dict.fromkeys(("luma", "r", "g", "b"), 500)
    assert preview.dense_histogram(hist).count() == 7 * 4 * 64


def test_tone_curve_meets_its_pivot(spark):
    c = tonemap.ToneConfig()
    x = small_table(spark, [(c.working_mid_grey,), (0.0,), (1.0,)], "x double")
    mid, low, high = [r.y for r in x.select(tonemap.tone_curve("x", c).alias("y")).collect()]
    assert mid == pytest.approx(0.5) and low == pytest.approx(0.0, abs=1e-6) and high == pytest.approx(1.0, abs=1e-6)
    px = small_table(spark, [(0.18, 0.18, 0.18), (-1.0, 0.5, 9.0)], "r double, g double, b double")
    for row in tonemap.tonemap(px, c).collect():
        assert all(v is not None and v >= 0.0 for v in row)
    assert all(v == v for v in tonemap.tonemap(px, tonemap.ToneConfig(log_output=True)).first())
