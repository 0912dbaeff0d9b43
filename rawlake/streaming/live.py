"""Streaming jobs (R3, R4, R5); the import stream R1 is in ``imports``.

Each reuses the batch operator's expressions, so a finished stream and the batch
job give the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rawlake.operators.jobs import outcome
from rawlake.operators.stats import phase_snapshot
from rawlake.session import work_folder


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_states(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Latest event of each job, and its outcome; the state is one row per job.

    For ``update`` output: a row for every job that an input batch has events of. The state
    itself is the table of all jobs, see :func:`job_table`.
    """
    latest = events.groupBy(key).agg(
        F.max("seq").alias("seq"),
        F.max_by(F.struct("kind", "percent", "cancelled", "error"), "seq").alias("e"),
    ).select(key, "seq", "e.*")
    return latest.withColumn("outcome", F.when(F.col("kind").isin("ok", "error"), outcome(F.col("kind"), F.col("cancelled"))))


def run_keyed(stream: DataFrame, folder: str, mode: str = "update", sink: str | None = None) -> str:
    """Run a stream over everything available with its state in RocksDB; gives the checkpoint's folder.

    Output goes to Parquet files below ``sink``, or nowhere where the state is what is wanted.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    checkpoint = f"{folder}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").start(sink) if sink else writer.format("noop").start()
    query.awaitTermination()
    return checkpoint


def job_table(spark: SparkSession, checkpoint: str, key: str = "job_id") -> DataFrame:
    """Every job's latest event, read from the state of a :func:`job_states` stream.

    One row per job, however many batches there were.
    """
    state = spark.read.format("statestore").load(checkpoint)
    buffer = [f.name for f in state.schema["value"].dataType.fields]
    seq, event = (F.col(f"value.`{name}`") for name in (buffer[0], buffer[1]))
    rows = state.select(F.col(f"key.{key}").alias(key), seq.alias("seq"), event.alias("e")).select(key, "seq", "e.*")
    return rows.withColumn("outcome", F.when(F.col("kind").isin("ok", "error"), outcome(F.col("kind"), F.col("cancelled"))))


def live_phases(events: DataFrame, keys=("run_id", "phase")) -> DataFrame:
    """Phase snapshot so far, for ``update`` or ``complete`` output."""
    return phase_snapshot(events, keys)


def second_counts(frames: DataFrame, key: str = "clip_id", at: str = "at", late: str = "10 seconds") -> DataFrame:
    """R4, first half: frames per clip and second, final once the watermark has passed.

    Seconds of the last ``late`` of a stream stay open until later frames arrive; a stream
    that ends is closed by a batch run of :func:`timeline.per_second` over what is left.
    """
    counted = frames.withWatermark(at, late).groupBy(key, F.window(at, "1 second")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("window"), "n")


class ClipRates(StatefulProcessor):
    """One row of state per clip: its open seconds with their frames, the last closed second and the rate there.

    A timer at the end of the earliest open second closes all seconds that the watermark has
    passed, in order, and is set again for the next one.
    """

    STATE = "seconds array<bigint>, counts array<bigint>, last bigint, rate double"

    def __init__(self, key: str, keep: float):
        self.key, self.keep = key, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.clip = handle.getValueState("clip", self.STATE)

    def _held(self) -> tuple[dict[int, int], int | None, float | None]:
        if not self.clip.exists():
            return {}, None, None
        seconds, counts, last, rate = self.clip.get()
        return dict(zip(seconds, counts, strict=True)), last, rate

    def _keep(self, open_: dict[int, int], last: int | None, rate: float | None) -> None:
        seconds = sorted(open_)
        self.clip.update((seconds, [open_[s] for s in seconds], last, rate))

    def _rows(self, key, rows: list[tuple[int, int, float]]) -> pd.DataFrame:
        second, n, rate = zip(*rows, strict=True) if rows else ((), (), ())
        frame = {self.key: [key[0]] * len(rows), "second": second, "n": n, "rate": rate}
        return pd.DataFrame(frame).astype({"second": "int64", "n": "int64", "rate": "float64"})

    def handleInputRows(self, key, rows, timerValues):
        open_, last, rate = self._held()
        before = min(open_, default=None)
        for batch in rows:
            for second, n in batch["second"].value_counts().items():
                open_[int(second)] = open_.get(int(second), 0) + int(n)
        first = min(open_, default=None)
        if first is not None and first != before:
            if before is not None:
                self.handle.deleteTimer((before + 1) * 1000)
            self.handle.registerTimer((first + 1) * 1000)
        self._keep(open_, last, rate)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        open_, last, rate = self._held()
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        for second in sorted(open_):
            if (second + 1) * 1000 > mark:
                self.handle.registerTimer((second + 1) * 1000)
                break
            n = open_.pop(second)
            rate = float(n) if rate is None else rate * self.keep + n * (1 - self.keep)
            last = second
            out.append((second, n, rate))
        self._keep(open_, last, rate)
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def _rate_ddl(frames: DataFrame, key: str) -> str:
    return f"{key} {dict(frames.dtypes)[key]}, second bigint, n bigint, rate double"


def rate_stream(frames: DataFrame, key: str = "clip_id", at: str = "at", late: str = "10 seconds", keep: float = 0.9) -> DataFrame:
    """Frames per clip and second with their smoothed rate, each once, when the watermark has passed the second.

    Open seconds and the carried rate are one row of keyed state per clip; nothing is
    rewritten per batch. Frames more than ``late`` behind the newest are dropped, as the
    second they belong to has been told.
    """
    seen = frames.withWatermark(at, late).select(key, at, F.unix_seconds(at).alias("second"))
    return seen.groupBy(key).transformWithStateInPandas(ClipRates(key, keep), _rate_ddl(frames, key), "Append", "EventTime")


def open_rates(spark: SparkSession, checkpoint: str, key: str = "clip_id", keep: float = 0.9) -> DataFrame:
    """The seconds that a stopped :func:`rate_stream` still holds open, with their smoothed rate.

    Read from the state, and folded on from the rate that it carries for each clip.
    """
    state = spark.read.format("statestore").option("stateVarName", "clip").load(checkpoint).select(f"key.{key}", "value.*")
    none = F.array().cast("array<struct<second:bigint,n:bigint,rate:double>>")

    def closed(so_far: Column, z: Column) -> Column:
        n = z["counts"].cast("double")
        rate = F.coalesce(so_far["rate"] * F.lit(keep) + n * F.lit(1 - keep), n)
        row = F.struct(z["seconds"].alias("second"), z["counts"].alias("n"), rate.alias("rate"))
        return F.struct(rate.alias("rate"), F.concat(so_far["rows"], F.array(row)).alias("rows"))

    # a clip has no more open seconds than lie between its newest frame and the watermark
    folded = F.aggregate(F.arrays_zip("seconds", "counts"), F.struct(F.col("rate"), none.alias("rows")), closed)
    return state.select(key, F.inline(folded["rows"]))


def rates_to_end(frames: DataFrame, folder: str, key: str = "clip_id", at: str = "at", late: str = "10 seconds", keep: float = 0.9) -> DataFrame:
    """All seconds of what is available: those that the stream has told, and those that it holds open."""
    spark = frames.sparkSession
    out = f"{folder}/out"
    checkpoint = run_keyed(rate_stream(frames, key, at, late, keep), folder, "append", out)
    told = spark.read.schema(_rate_ddl(frames, key)).parquet(out)
    return told.unionByName(open_rates(spark, checkpoint, key, keep))


def run_to_end(stream: DataFrame, mode: str, folder: str | None = None) -> str:
    """Run a stream over everything available and give the folder of its output.

    In ``update`` mode rows carry the batch that wrote them; see :func:`latest`.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    out = f"{folder}/out"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def latest(spark: SparkSession, out: str, schema, keys: list[str]) -> DataFrame:
    """Last version of every key of an ``update`` output."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    rows = spark.read.schema(f"{fields}, batch int").parquet(f"{out}/part=*")
    rest = [f.name for f in schema.fields if f.name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
