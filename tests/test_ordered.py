"""Ordered scans give what one plain window gives, also for a hot group."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rawlake.operators import ordered, timeline
from rawlake.plans import export
from rawlake.session import attach, hot_keys, small_table

TASKS = [None, 1, 7]


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows in one group, many equal order values, a null group."""
    r = random.Random(3)
    data = [(0 if i % 3 == 0 else r.choice([1, 2, 3, None]), r.randrange(40), i, r.randrange(5)) for i in range(3000)]
    return small_table(spark, data, "g int, k int, id int, v int").repartition(5)


def same(a, b):
    return sorted(repr(tuple(r)) for r in a.collect()) == sorted(repr(tuple(r)) for r in b.collect())


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def forward():
    return W.partitionBy("g").orderBy("k", "id").rowsBetween(W.unboundedPreceding, 0)


def later():
    return W.partitionBy("g").orderBy("k", "id").rowsBetween(1, W.unboundedFollowing)


@pytest.mark.parametrize("tasks", TASKS)
def test_running_total(rows, tasks, short_batches):
    got = ordered.running_total(rows, ["g"], ["k", "id"], F.col("v"), "t", tasks)
    assert got.columns == ["g", "k", "id", "v", "t"]
    assert same(got, rows.withColumn("t", F.sum("v").over(forward())))


@pytest.mark.parametrize("tasks", TASKS)
def test_next_matching(rows, tasks, short_batches):
    for cond in (F.col("v") == 4, F.col("id") == 1500, F.lit(False)):
        got = ordered.next_matching(rows, ["g"], ["k", "id"], F.col("id"), cond, "nxt", tasks)
        assert same(got, rows.withColumn("nxt", F.first(F.when(cond, F.col("id")), ignorenulls=True).over(later())))


def test_ordinal_is_dense(rows):
    out = ordered.ordinal(rows, ["g"], ["k", "id"], "n", 7)
    per = out.groupBy("g").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.countDistinct("n").alias("d"))
    assert all(r.c == r.m == r.d for r in per.collect())


def test_groups_of_all_kinds(spark):
    """Several columns, NaN, a text and a date; null values count as 0."""
    data = [(float("nan") if i % 3 else None, f"t{i % 2}" if i % 5 else None, i, None if i % 4 == 0 else i) for i in range(400)]
    df = spark.createDataFrame(data, "x double, s string, id int, v bigint").withColumn("d", F.date_add(F.lit("2024-01-01"), (F.col("id") / 200).cast("int")))
    window = W.partitionBy("x", "s", "d").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumn("t", F.sum(F.coalesce("v", F.lit(0))).over(window))
    assert same(ordered.running_total(df, ["x", "s", "d"], ["id"], F.col("v"), "t", 9), want)


def test_no_group_and_no_rows(rows):
    whole = ordered.ordinal(rows, [], ["id"], "n", 5)
    assert whole.where(F.col("n") != F.col("id") + 1).count() == 0 and whole.count() == 3000
    for tasks in TASKS:
        none = rows.where("id < 0")
        assert ordered.ordinal(none, ["g"], ["id"], "n", tasks).collect() == []
        assert ordered.next_matching(none, ["g"], ["id"], F.col("v"), F.lit(True), "n", tasks).collect() == []


def test_one_range_exchange_and_no_window(rows, monkeypatch):
    """The rows move once, by range; a hot group lies over several tasks; what tasks hand over is two rows each."""
    plans, folded = [], []
    real = ordered.written

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        folded.append(real(df))
        return folded[-1]

    monkeypatch.setattr(ordered, "written", spy)
    src = real(rows)
    out = ordered.ordinal(src, ["g"], ["k", "id"], "n", 7)
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0] and "Window" not in plans[0]
    after = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in after and "hashpartitioning" not in after and "rangepartitioning" not in after
    sizes = [r["count"] for r in folded[0].where("g = 0").groupBy(ordered.TASK).count().collect()]
    assert len(sizes) >= 2 and max(sizes) < 800
    assert folded[0].where(F.col(ordered.EDGE) > 0).count() <= 14


@pytest.mark.parametrize("keep", [0.9, 0.0, 1.0, 0.5])
def test_smoothing_matches_the_recurrence(spark, keep, short_batches):
    r = random.Random(1)
    data = [(c, s, r.randrange(1, 90)) for c, n in ((1, 700), (2, 3), (3, 132)) for s in range(n)]
    want = {}
    for c, s, n in data:
        before = want.get((c, s - 1))
        want[c, s] = float(n) if before is None else before * keep + n * (1 - keep)
    df = small_table(spark, data, "clip_id int, second int, n int")
    for tasks in TASKS:
        got = timeline.smoothed_rate(df, keep=keep, tasks=tasks).collect()
        assert len(got) == len(data)
        for row in got:
            assert row.rate == pytest.approx(want[row.clip_id, row.second], rel=1e-12)


@pytest.mark.parametrize("tasks", TASKS)
def test_free_slots(spark, tasks):
    r = random.Random(5)
    jobs = [(i, r.choice("aab")) for i in range(60)]
    taken = [("a", s) for s in (0, 1, 3, 4, 9, 30)] + [("b", 2), ("c", 0)]
    used = {(b, s) for b, s in taken}
    want = {}
    for i, base in jobs:
        slot = next(s for s in range(1000) if (base, s) not in used)
        used.add((base, slot))
        want[i] = slot
    out = export.free_slots(
        small_table(spark, jobs, "id int, base string"), small_table(spark, taken, "base string, slot bigint"), "base", ["id"], tasks=tasks
    )
    assert {row.id: row.slot for row in out.collect()} == want


def test_salted_join_equals_plain(spark, rows):
    right = small_table(spark, [(i, f"n{i}") for i in range(3)], "g int, name string")
    for how in ("inner", "left"):
        assert same(attach(rows, right, ["g"], how, spread=["id"], limit=0), rows.join(right, "g", how))


def test_salts_follow_the_count_and_take_any_key(spark):
    import datetime

    day = datetime.date(2024, 1, 1)
    left = spark.createDataFrame([(day if i % 3 else None, i) for i in range(600)] + [(datetime.date(2024, 1, 2), 7)], "d date, id int").repartition(3)
    right = spark.createDataFrame([(day, "a"), (datetime.date(2024, 1, 2), "b")], "d date, name string")
    hot = dict(hot_keys(left.where("d is not null"), ["d"]))
    assert list(hot) == [(day,)] and hot[(day,)] > 4
    for how in ("inner", "left"):
        assert same(attach(left, right, ["d"], how, spread=["id"], limit=0), left.join(right, "d", how))
