"""An import stream that opens its clips and says why one failed.

A path is a key with state: once imported it is known, so a later drop of it is a duplicate
and its file is not opened again. Clips are opened by the tasks that hold their keys. What
became of every path is appended to one table, whose commits are those of the stream: a batch
that is repeated after a failure tells nothing twice, and pool, counts and failures are views
of that table, so they never disagree.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from rawlake import vocab
from rawlake.operators.timeline import _rate
from rawlake.sources import containers
from rawlake.streaming.live import run_keyed

RAW = [f.name for f in containers.RAW_SCHEMA.fields if f.name != "path"]
TOLD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("seq", T.LongType()),
        *[T.StructField(n, T.LongType()) for n in ("imported", "failed", "duplicate")],
        *[f for f in containers.RAW_SCHEMA.fields if f.name != "path"],
        T.StructField("last_ts", T.LongType()),
    ]
)


def opened(path: str) -> dict:
    """Bounded reads of one clip: head, tail, first metadata, and the first and last entry of its index."""
    row = containers.read_clip(path) | {"last_ts": None}
    if row["error"] is None and row["index_offset"] is not None:
        at = row["index_offset"]
        with containers.open_clip(path) as handle:
            for name, entry in (("first_ts", 0), ("last_ts", row["index_count"] - 1)):
                (row[name],) = struct.unpack("<q", containers._exact(handle, at + 16 * entry + 8, 8))
    return row


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per path and verdict of a batch, so that a path dropped a million times is not shuffled a million times."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).group_by(["path", "ok"]).aggregate([("seq", "min"), ([], "count_all")])
        rows = rows.rename_columns(["path", "ok", "seq", "n"]).combine_chunks()
        yield from rows.to_batches()


class ImportedPaths(StatefulProcessor):
    """State of a path: whether it has been imported. Paths that failed have none, so they may be tried again."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("imported", "seq bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.update((initialState["seq"],))

    def handleInputRows(self, key, rows, timerValues):
        good = bad = asked = 0
        first = {}
        for row in rows:
            verdict, seq, n = row["ok"], row["seq"], row["n"]
            good, bad, asked = good + n * (verdict is True), bad + n * (verdict is False), asked + n * (verdict is None)
            first[verdict] = min(first.get(verdict, seq), seq)
        told = dict.fromkeys(TOLD.names) | {"path": key[0]}
        known = self.known.exists()
        if asked and known:
            good += asked
        elif asked:
            found = opened(key[0])
            told |= found
            good, bad = (good + asked, bad) if found["error"] is None else (good, bad + asked)
        new = not known and good > 0
        seq = min(v for k, v in first.items() if not new or k is True or (k is None and told["error"] is None))
        if new:
            self.known.update((seq,))
        told |= {"seq": seq, "imported": int(new), "failed": bad, "duplicate": good - new}
        yield Row(**told)

    def close(self) -> None:
        pass


def import_stream(paths: DataFrame, pool: DataFrame | None = None, path: str = "path", order: str = "seq", ok: str | None = None) -> DataFrame:
    """Per batch, what became of each dropped path.

    ``paths`` is a stream of dropped paths with the order they came in; those of other files
    than clips, and null, are passed over. Each new path is opened; with ``ok``, a column that
    tells readable from unreadable, none is. ``pool`` (``path, seq``) has what was imported
    before the stream.

    Rows have the path, the first ``seq`` of the drop that decided, the numbers of drops that
    imported it (0 or 1), failed and were duplicates, the reason of a failure in ``error``, and
    what was read of an imported clip. A path that fails is tried again when it is dropped
    again; a known one is not opened, whatever has become of its file.
    """
    verdict = F.lit(None).cast("boolean") if ok is None else F.coalesce(F.col(ok), F.lit(False))
    dropped = paths.select(F.col(path).alias("path"), F.col(order).cast("bigint").alias("seq"), verdict.alias("ok"))
    clips = dropped.where(F.lower("path").endswith(vocab.CLIP_SUFFIX))
    few = clips.mapInArrow(_combined, "path string, ok boolean, seq bigint, n bigint")
    before = None if pool is None else pool.select("path", F.col("seq").cast("bigint").alias("seq")).groupBy("path")
    return few.groupBy("path").transformWithState(ImportedPaths(), TOLD, "Append", "None", initialState=before)


def run_import(paths: DataFrame, folder: str, **kw) -> DataFrame:
    """Import everything available; gives all that the stream of this folder has told so far.

    Run again with the same folder, it goes on after the last finished batch.
    """
    run_keyed(import_stream(paths, **kw), folder, "append", f"{folder}/told")
    return told(paths.sparkSession, folder)


def told(spark: SparkSession, folder: str) -> DataFrame:
    """What committed batches have told."""
    return spark.read.schema(TOLD).parquet(f"{folder}/told")


def pool_of(rows: DataFrame) -> DataFrame:
    """Imported paths, one row each."""
    return rows.where(F.col("imported") == 1).select("path", "seq")


def counts_of(rows: DataFrame) -> DataFrame:
    """A7 for the stream: drops that imported a clip, failed and were duplicates."""
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("imported", "failed", "duplicate")])


def failures_of(rows: DataFrame) -> DataFrame:
    """Paths that could not be read, with the reason, once per batch that tried them."""
    return rows.where(F.col("error").isNotNull()).select("path", "seq", "failed", "error")


def clips_of(rows: DataFrame) -> DataFrame:
    """Imported clips of both generations with their timelines (A2), from what the import read; no file is opened."""
    raw = rows.where(F.col("imported") == 1)
    n = F.col("index_count")
    rate = _rate(n, F.col("last_ts") - F.col("first_ts"), F.lit(0.0))
    timeline = raw.where(F.col("last_ts").isNotNull()).select(F.col("path").alias("clip_id"), n.alias("frame_count"), "first_ts", rate.alias("fps"))
    return containers.clips(raw.select("path", *RAW), timeline)
