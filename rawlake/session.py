"""Session settings, the shared work folder and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side that may be broadcast, checked against the plan's size estimate.
BROADCAST_LIMIT = 64 * 1024 * 1024

# HotSpot does not compile methods above this size, so larger generated stages
# run interpreted; below it Spark splits them into small compiled methods.
HUGE_METHOD = "8000"


def build_session(app: str = "rawlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # no call site per expression: wide plans have thousands of them
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.codegen.hugeMethodLimit": HUGE_METHOD,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Runtime settings for wide per-pixel stages, on a session built elsewhere."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores, for heavy per-row work on an input of few splits.

    Large inputs have more splits than cores and are left as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    setting = spark.conf.get("spark.sql.files.maxPartitionBytes")
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(setting)
    return df if plan_bytes(df) >= split * cores else df.repartition(cores, *keys)


# Bytes that one reading task should get.
TASK_BYTES = 128 * 1024 * 1024


def tasks_for(rows: DataFrame, size: Column) -> int:
    """Tasks for reads of so many bytes each: by bytes, and no fewer than cores or rows."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(found["n"], cores), -(-(found["b"] or 0) // TASK_BYTES))


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows over exactly so many tasks: descriptors are tiny, and a repartition without number would be merged again."""
    return rows.repartition(tasks)


def work_folder(spark: SparkSession) -> str:
    """A new path below the cluster's shared folder (``spark.checkpoint.dir``).

    On one machine, as in tests, a temporary folder is made and set where none is named;
    on a cluster that is an error, as its machines would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="rawlake-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table below the shared folder, read again; it stays there for the owner of the folder to clear."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of one range of an ordered scan, by what its plan reads.
RANGE_BYTES = 256 * 1024 * 1024


def range_tasks(df: DataFrame) -> int | None:
    """Ranges for a sort of the rows, by the bytes of the tables read, where the session's shuffle partitions are too few."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    wanted = min(-(-sizes // RANGE_BYTES), 1_000_000)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for a plan (an upper bound for scans)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_literal(v) for v in value)})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def small_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """Fixed rows as a local relation, whose size the optimizer knows.

    Rows made from Python objects would count as unbounded in every estimate.
    """
    fields = [part.split(" ", 1) for part in ddl.split(", ")]
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    if not rows:
        empty = ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in fields)
        return spark.sql(f"SELECT {empty} FROM range(1) WHERE false")
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def hot_keys(df: DataFrame, on: list[str]) -> list[tuple[tuple, int]]:
    """Keys that alone fill more than half of an average shuffle partition, and over how many tasks to divide each.

    There are at most twice as many as shuffle partitions, whatever the data. Rows are
    counted per key on the map side first, in one pass.
    """
    pieces = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    seen = Observation()
    top = counted.observe(seen, F.sum("_n").alias("total")).orderBy(F.col("_n").desc()).limit(pieces).collect()
    floor = max(2, (seen.get["total"] or 0) // pieces)
    return [(tuple(row[k] for k in on), -(-row["_n"] // floor)) for row in top if row["_n"] >= floor]


def attach(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[str] | None = None,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Join ``right``, unique on ``on``, to a ``left`` that may be skewed on ``on``.

    Small right sides are broadcast, so the left side never moves. Past the
    limit both sides are shuffled; rows of hot keys are then divided over as many
    tasks as their count asks for, by a hash of the ``spread`` columns, and only the
    right rows of those keys are repeated. Rows with a null key match nothing and
    are not shuffled.
    """
    if plan_bytes(right) <= limit:
        return left.join(F.broadcast(right), on, how)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    keyed = left.where(~missing)
    hot = hot_keys(keyed, on) if spread else []
    if hot:
        schema = T.StructType([*[left.schema[k] for k in on], T.StructField("_salts", T.IntegerType())])
        # bounded by the number of shuffle partitions
        marks = F.broadcast(left.sparkSession.createDataFrame([(*key, n) for key, n in hot], schema))
        salts = F.coalesce("_salts", F.lit(1))
        salted = keyed.join(marks, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
        copies = F.explode(F.sequence(F.lit(0), salts - 1))
        repeated = right.join(marks, on, "left").withColumn("_salt", copies).drop("_salts")
        joined = salted.join(repeated, [*on, "_salt"], how).drop("_salt")
    else:
        joined = keyed.join(right, on, how)
    if how == "inner":
        return joined
    added = {c: F.lit(None).cast(right.schema[c].dataType) for c in right.columns if c not in on}
    return joined.unionByName(left.where(missing).withColumns(added))
