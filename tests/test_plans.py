"""Export planning cases and the shape of physical plans."""

import pytest
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.functions import curves, text
from rawlake.operators import catalog, jobs, timeline
from rawlake.plans import export, steps
from rawlake.queries import base, mosaic
from rawlake.session import attach, small_table


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "label, encoder, want",
    [
        ("Lossless", "libx265", "-crf 16"),
        ("Lossless", "hevc_nvenc", "-cq 16"),
        ("Lossless", "hevc_videotoolbox", "-quality lossless"),
        ("Master 400M", "hevc_nvenc", "-b:v 400M -maxrate 400M -rc:v vbr"),
        ("Standard", "libvpx-vp9", "-crf 24 -b:v 0"),
        ("High Quality", "libaom-av1", "-crf 20 -b:v 0"),
        ("Custom: [18]", "libx265", "-crf 18"),
        ("Custom: [1e3]", "libx265", "-crf 1e3"),
        ("Custom: [50M]", "libx265", "-b:v 50M -maxrate 50M"),
        ("Custom: [50k]", "libx265", "-b:v 50k -maxrate 50k"),
        ("Custom: [-x]", "libx265", "-x"),
        ("Custom: []", "libx265", ""),
        ("no such label", "libx265", "-crf 16"),
    ],
)
def test_rate_args(spark, label, encoder, want):
    l = F.lit(label)
    args = export.rate_args(text.rate_mode(l), text.rate_value(l), F.lit(encoder))
    assert " ".join(one(spark, args)) == want


def test_fallback_encoder_is_never_hardware(spark):
    rows = export.best_encoders(small_table(spark, [("h", "nothing"), ("i", "libsvtav1 prores_videotoolbox")], "host string, encoders string"))
    got = {(r.host, r.family): (r.encoder, r.is_hw) for r in rows.collect()}
    assert got["h", "ProRes"] == ("prores_ks", False)
    assert got["i", "ProRes"] == ("prores_videotoolbox", True)
    assert got["i", "AV1"] == ("libsvtav1", False)


def test_codec_plan_is_complete(spark):
    dim = export.dim_codec_plan(spark)
    assert dim.groupBy("family", "encoder", "profile", "wide").count().where("count > 1").count() == 0
    profiles = dim.select("family", "profile").distinct().count()
    assert profiles == len(vocab.CODEC_PROFILE)


def test_suffix_with_a_dotted_stem(spark):
    plain = export.slot_path(F.lit("/o/my.clip_A_B"), F.lit(2), F.lit("mp4"))
    cut = export.slot_path(F.lit("/o/my.clip_A_B"), F.lit(2), F.lit("mp4"), cut_at_dot=True)
    first = export.slot_path(F.lit("/o/my.clip_A_B"), F.lit(0), F.lit("mp4"), cut_at_dot=True)
    assert one(spark, F.array(plain, cut, first)) == ["/o/my.clip_A_B_2.mp4", "/o/my.mp4", "/o/my.clip_A_B.mp4"]


def test_merging_imports_twice_changes_nothing(spark):
    pool = small_table(spark, [("a", 1)], "path string, seq int")
    new = small_table(spark, [("a", 2), ("b", 3), ("b", 4)], "path string, seq int")
    once = catalog.merged_pool(pool, new)
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, catalog.merged_pool(once, new).collect())) == [("a", 1), ("b", 3)]


def test_cancelled_run_waits_again(spark):
    queue = small_table(spark, [(1, "Rendering", 0.0), (2, "Rendering", 0.0), (3, "Waiting", 0.0)], "job_id int, status string, progress double")
    events = small_table(
        spark, [(1, 1, "error", None, True, "x"), (2, 1, "error", None, False, "disk"), (2, 0, "start", None, False, None)],
        "job_id int, seq int, kind string, percent double, cancelled boolean, error string",
    )
    got = {r.job_id: (r.status, r.progress, r.error) for r in jobs.queue_state(queue, events).collect()}
    assert got == {1: ("Waiting", 100.0, None), 2: ("Failed", 100.0, "disk"), 3: ("Waiting", 0.0, None)}


def test_own_step(spark):
    px = small_table(spark, [(1, 0, 0, 0.5, 0.5, 0.5)], "clip_id int, y int, x int, r double, g double, b double")
    steps.register_step("curve", "half", lambda p, _: p.withColumn("r", F.col("r") / 2))
    assert steps.run_steps(px, px, [("curve", "half"), ("curve", "Linear")]).first().r == 0.25
    with pytest.raises(ValueError):
        steps.register_step("other", "x", lambda p, _: p)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_timeline_reads_two_columns_and_shuffles_once(spark, sf):
    p = plan(timeline.clip_timeline(base.frame_index(spark, sf)))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in p
    assert p.count("Exchange") == 1 and p.count("HashAggregate") == 2


def test_curve_job_does_not_shuffle(spark, sf):
    p = plan(curves.encode_table(base.pixels(spark, sf), "S-Log3"))
    assert "Exchange" not in p and "Python" not in p


def test_filter_reaches_the_scan(spark, sf):
    p = plan(base.queue(spark, sf).where(F.col("job_id") == 5))
    assert "EqualTo(o_orderkey,5)" in p


def test_large_side_is_not_broadcast(spark, sf):
    left, right = base.queue(spark, sf), base.queue(spark, sf).select("job_id", F.lit(1).alias("one"))
    small = plan(attach(left, right, ["job_id"], spread=["owner"]))
    assert "BroadcastExchange" in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan(attach(left, right, ["job_id"], spread=["owner"], limit=1))
        assert "BroadcastExchange" not in large
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert large.count("Exchange hashpartitioning") == 2


def test_develop_pixels_never_move(spark, sf):
    from rawlake.operators import develop
    from rawlake.queries import mosaic

    tiled = spark.read.schema("clip_id int, frame_id bigint, pattern string, frame_w int, frame_h int, tile_y int, tile_x int, y0 int, x0 int, "
                              "h int, w int, oy int, ox int, oh int, ow int, px array<int>").parquet(sf + "/embeddings.parquet")  # fmt: skip
    p = plan(develop.develop(tiled, mosaic.frame_params(spark, sf), "S-Log3"))
    above_join = p[: p.index("Join")]
    assert "Exchange" not in above_join and "Sort" not in p


def test_no_nested_loops(spark, sf):
    from rawlake.queries import catalog, colour, mosaic, planning, stats  # noqa: F401

    for name in ("p17_tonemap", "o5_phase_order", "j7_preset_batch", "e1_codec_args", "p8_display_colour", "j1_enriched_clips"):
        p = plan(base.QUERIES[name](spark, sf))
        assert "NestedLoop" not in p and "Cartesian" not in p, name


def test_develop_holds_two_python_processes_a_task(spark):
    folder = "/root/testdata/sf0.001"
    plan = str(mosaic.p11_lens(spark, folder)._jdf.queryExecution().optimizedPlan().toString())
    # one cuts tiles, one corrects, develops and lays out pixels
    assert plan.count("MapInArrow") == 2
