"""Uncompressed 16-bit frame dumps (S7, K1) and audio streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake.session import dealt, tasks_for
from rawlake.sources.containers import frame_id, open_clip

EDGE = 9


def _folder(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_raw16(
    spark: SparkSession, files: DataFrame, strip_rows: int = 256, halo: int = EDGE, tasks: int | None = None
) -> DataFrame:
    """Tiles of dumped frames.

    ``files`` has ``clip_id, path, length, frame_w, frame_h`` per dump; further
    columns are kept. Every
    frame is cut into full-width strips, whose bytes with their halo rows are
    one range of the file. Strips are spread before anything is read. A dump that
    does not end with a whole frame is an error; :func:`broken_dumps` names them.
    """
    frame_bytes = F.col("frame_w").cast("bigint") * F.col("frame_h") * 2
    frames = F.call_function("div", F.col("length"), frame_bytes)
    said = F.concat(F.lit("dump ends within a frame: "), F.col("path"))
    checked = F.when(F.col("length") % frame_bytes != 0, F.raise_error(said).cast("bigint")).otherwise(frames)
    f = files.withColumn("_n", checked).where(F.col("_n") > 0)
    f = f.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("ordinal"))
    f = f.select("*", F.explode(F.sequence(F.lit(0), F.col("frame_h") - 1, F.lit(strip_rows))).alias("y0"))
    f = f.withColumns(
        {
            "h": F.least(F.lit(strip_rows), F.col("frame_h") - F.col("y0")),
            "oy": F.greatest(F.col("y0") - halo, F.lit(0)),
        }
    )
    f = f.withColumn("oh", F.least(F.col("y0") + F.col("h") + halo, F.col("frame_h")) - F.col("oy"))
    known = ["clip_id", "path", "ordinal", "frame_w", "frame_h", "y0", "h", "oy", "oh"]
    extra = [c for c in files.columns if c not in (*known, "length")]
    cols = [*known, *extra]
    f = f.select(*cols)
    f = dealt(f, tasks or tasks_for(f, F.col("oh").cast("bigint") * F.col("frame_w") * 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = []
            for r in batch.to_pylist():
                start = (r["ordinal"] * r["frame_h"] + r["oy"]) * r["frame_w"] * 2
                with open_clip(r["path"]) as handle:
                    data = handle.read_at(r["oh"] * r["frame_w"] * 2, start)
                planes.append(np.frombuffer(data, dtype="<u2").astype(np.int32))
            sizes = np.cumsum([0] + [len(p) for p in planes]).astype(np.int32)
            values = np.concatenate(planes) if planes else np.empty(0, np.int32)
            px = pa.ListArray.from_arrays(pa.array(sizes), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, px], names=[*batch.schema.names, "px"])

    types = {x.name: x.dataType.simpleString() for x in f.schema.fields}
    read = f.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in cols) + ", px array<int>")
    return read.select(
        frame_id(), "clip_id", "ordinal", *extra, F.call_function("div", F.col("y0"), F.lit(strip_rows)).cast("int").alias("tile_y"),
        F.lit(0).alias("tile_x"), "frame_w", "frame_h", "y0", F.lit(0).alias("x0"), "h",
        F.col("frame_w").alias("w"), "oy", F.lit(0).alias("ox"), "oh", F.col("frame_w").alias("ow"), "px",
    )


def broken_dumps(files: DataFrame) -> DataFrame:
    """Dumps that end within a frame, with their whole ``frames`` and the ``bytes_over``."""
    frame_bytes = F.col("frame_w").cast("bigint") * F.col("frame_h") * 2
    over = files.where(F.col("length") % frame_bytes != 0)
    return over.withColumns({"frames": F.call_function("div", F.col("length"), frame_bytes), "bytes_over": F.col("length") % frame_bytes})


def write_raw16(frames: DataFrame, folder: str, name: str = "clip_id", order: str = "ordinal") -> DataFrame:
    """K1: dump whole frames of ``px`` as little-endian 16-bit words.

    A dump is one file per clip when a clip is small, but a clip may hold a
    third of all frames. So the frames are range-partitioned by clip and order
    and every task writes its run of a clip as one part, named so that parts
    sort in frame order. Parts are written under a temporary name per attempt and
    renamed, so a lost task can be repeated. The frames are written by this call;
    it gives the manifest, one row per part, which is committed last, below
    ``folder/_parts``. A folder that has one is not written again.
    """
    ordered = frames.select(F.col(name).cast("string").alias("_clip"), F.col(order).cast("bigint").alias("_at"), "px")
    ordered = ordered.repartitionByRange("_clip", "_at").sortWithinPartitions("_clip", "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = _folder(folder)
        current, stream, info, temp = None, None, None, None
        done = []

        def close():
            stream.close()
            final = f"{root}/clip={current}/part-{info['first']:012d}.raw"
            system.move(temp, final)
            done.append({"clip": current, "first": info["first"], "frames": info["frames"], "path": final})

        for batch in batches:
            clips_, ats, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, (clip, at) in enumerate(zip(clips_, ats)):
                if clip != current:
                    if stream is not None:
                        close()
                    system.create_dir(f"{root}/clip={clip}", recursive=True)
                    temp = f"{root}/clip={clip}/.{uuid.uuid4().hex}"
                    current, stream, info = clip, system.open_output_stream(temp), {"first": at, "frames": 0}
                words = lists[i].values.to_numpy(zero_copy_only=False)
                stream.write(np.clip(words, 0, 65535).astype("<u2").tobytes())
                info["frames"] += 1
        if stream is not None:
            close()
        schema = pa.schema([("clip", pa.string()), ("first", pa.int64()), ("frames", pa.int64()), ("path", pa.string())])
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    manifest = f"{folder}/_parts"
    ordered.mapInArrow(run, "clip string, first bigint, frames bigint, path string").write.parquet(manifest)
    return frames.sparkSession.read.schema("clip string, first bigint, frames bigint, path string").parquet(manifest)


def samples(chunks: DataFrame, keys=("clip_id",)) -> DataFrame:
    """Audio samples as rows, addressed by chunk and position in it.

    Sorting by (clip, chunk, position) gives the stream; nothing is gathered.
    """
    return chunks.select(*keys, "chunk_no", F.posexplode("samples").alias("pos", "sample"))


def sample_offsets(chunks: DataFrame, key: str = "clip_id", **kw) -> DataFrame:
    """K7: position of each chunk in its clip's stream, in samples."""
    from rawlake.operators.ordered import running_total

    sized = chunks.withColumn("n", F.size("samples").cast("bigint"))
    total = running_total(sized, [key], ["chunk_no"], F.col("n"), "_end", **kw)
    return total.withColumn("start", F.col("_end") - F.col("n")).drop("_end")


def stream_bytes(chunks: DataFrame, key: str = "clip_id", **kw) -> DataFrame:
    """K7: each chunk as little-endian bytes with its byte offset in the stream."""
    placed = sample_offsets(chunks, key, **kw).select(key, "chunk_no", (F.col("start") * 2).alias("offset"), F.col("samples").cast("array<smallint>").alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [s.values.to_numpy(zero_copy_only=False).astype("<i2").tobytes() for s in batch.column("samples")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.binary())], names=[*batch.schema.names[:3], "bytes"])

    types = dict(placed.dtypes)
    return placed.mapInArrow(run, f"{key} {types[key]}, chunk_no {types['chunk_no']}, offset bigint, bytes binary")
