"""Clip containers: headers, frame index and frame metadata.

``rawclips`` is a Python data source with one row per clip. It reads the head,
the tail and the first frame's metadata of each file and nothing else. The
frame tables start from the clips: one row per index chunk or frame is spread
over the cluster first, so a clip with a huge index is read by many tasks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rawlake import vocab
from rawlake.functions import numeric
from rawlake.operators.params import illuminant_code
from rawlake.session import TASK_BYTES, dealt, tasks_for

M9 = T.ArrayType(T.DoubleType())

RAW_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("header", T.StringType()),
        T.StructField("index_count", T.LongType()),
        T.StructField("index_offset", T.LongType()),
        T.StructField("first_ts", T.LongType()),
        T.StructField("first_meta", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

# Bytes to count for the reads of one clip: its header and first metadata, and the opening.
CLIP_READ = 1 << 20

# Legacy tag -> (name, kind of value)
LEGACY_TAGS = {
    0x01: ("sensor_make", "text"),
    0x02: ("sensor_model", "text"),
    0x03: ("camera_model", "text"),
    0x04: ("lens_model", "text"),
    0x05: ("focal_length", "d"),
    0x06: ("aperture", "d"),
    0x07: ("iso", "I"),
    0x08: ("exposure_time", "d"),
    0x09: ("white_balance", "d"),
    0x0A: ("capture_date", "text"),
    0x0B: (None, "9d"),
    0x0C: (None, "text"),
    0x10: ("frame_offsets", "list"),
    0x11: ("audio_offset", "audio"),
    0x12: ("audio_length", "audio"),
    0x13: ("sensor_width", "H"),
    0x14: ("sensor_height", "H"),
    0x15: ("active_offset_x", "H"),
    0x16: ("active_offset_y", "H"),
    0x17: ("active_width", "H"),
    0x18: ("active_height", "H"),
}


def _system(path: str):
    """File system of a path or address, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def found_below(system, root: str, recursive: bool) -> Iterator[pafs.FileInfo]:
    """Files of a folder in order of their names, one folder's listing at a time."""
    left = [root]
    while left:
        infos = sorted(system.get_file_info(pafs.FileSelector(left.pop())), key=lambda i: i.path)
        yield from (i for i in infos if i.is_file)
        if recursive:
            left += [i.path for i in infos if i.type == pafs.FileType.Directory]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many: clips are many and most are short."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class BadClip(ValueError):
    """A file that is not a readable clip."""


def open_clip(path: str):
    """Random access to a file on any file system Arrow knows."""
    system, inner = _system(path)
    return system.open_input_file(inner)


def _exact(handle, offset: int, length: int) -> bytes:
    data = handle.read_at(length, offset)
    if len(data) < length:
        raise BadClip("file ends early")
    return data


def item_json(handle, offset: int) -> str | None:
    """Metadata text of the frame item at an offset: a pixel item, then a JSON item."""
    try:
        kind, size = struct.unpack("<II", _exact(handle, offset, 8))
        if kind != 2:
            return None
        kind, length = struct.unpack("<II", _exact(handle, offset + 8 + size, 8))
        if kind != 3:
            return None
        return _exact(handle, offset + 16 + size, length).decode("utf-8")
    except (BadClip, UnicodeDecodeError):
        return None


def _legacy_header(head: bytes, block: bytes) -> dict:
    version, frames, width, height, fps, audio = struct.unpack(">IIHHdB", head[5:26])
    rate, channels, depth, pattern = struct.unpack(">IHHB", head[26:35])
    out = {
        "frame_count": frames, "width": width, "height": height, "fps": fps, "has_audio": bool(audio),
        "audio_sample_rate": rate if audio else 0, "audio_channels": channels, "bit_depth": depth,
        "bayer_code": pattern, "version": version,
    }
    pos = 0
    while pos < len(block):
        name, kind = LEGACY_TAGS.get(block[pos], (None, "skip"))
        pos += 1
        left = len(block) - pos
        if kind == "skip":
            pos += 1
        elif kind in ("text", "list"):
            if left < 4:
                continue
            (n,) = struct.unpack_from(">I", block, pos)
            pos += 4
            if kind == "list":
                n = min(n, (len(block) - pos) // 8)
                out[name] = list(struct.unpack_from(f">{n}Q", block, pos))
                pos += 8 * n
            elif n <= len(block) - pos:
                try:
                    value = block[pos : pos + n].decode("utf-8")
                except UnicodeDecodeError:
                    continue
                pos += n
                if name:
                    out[name] = value
        elif kind == "9d":
            pos += 8 * min(9, left // 8)
        else:
            code = "Q" if kind == "audio" else kind
            wide = struct.calcsize(f">{code}")
            if left >= wide and (kind != "audio" or audio):
                (out[name],) = struct.unpack_from(f">{code}", block, pos)
                pos += wide
    return out


def _kind(magic: bytes) -> str | None:
    if magic.startswith(vocab.HEADED_MAGIC):
        return "headed"
    return "legacy" if magic.startswith(vocab.LEGACY_MAGIC) else None


def index_place(handle) -> tuple[int, int]:
    """Number of frames and offset of the index of a headed clip; 0 frames where it has no readable one."""
    size = handle.size()
    if _kind(_exact(handle, 0, 16)) != "headed" or size < 24:
        return 0, 0
    mark, count, offset = struct.unpack("<IIq", _exact(handle, size - 16, 16))
    return (count, offset) if mark == vocab.INDEX_MAGIC and offset >= 0 and offset + 16 * count <= size else (0, 0)


def read_clip(path: str, kinds: set[str] | None = None) -> dict:
    """The bounded reads of one clip; a bad or missing file gives a row with an error.

    Where only some ``kinds`` are wanted, no more than the first bytes of others are read, and
    their row has no kind. Any other failure to read fails the task, so that Spark repeats it.
    """
    row = dict.fromkeys(f.name for f in RAW_SCHEMA.fields)
    row["path"] = path
    try:
        with open_clip(path) as handle:
            row["size"] = size = handle.size()
            magic = _exact(handle, 0, 16)
            kind = _kind(magic)
            if kind is not None and kinds is not None and kind not in kinds:
                return row
            if kind == "headed":
                _headed(handle, magic, size, row)
            elif kind == "legacy":
                head = magic + _exact(handle, 16, 20)
                block = b""
                if size > 36:
                    (length,) = struct.unpack(">I", _exact(handle, 36, 4))
                    block = _exact(handle, 40, length)
                header = _legacy_header(head, block)
                row.update(kind="legacy", version=header["version"], header=json.dumps(header))
            else:
                raise BadClip("unknown magic")
    except (BadClip, FileNotFoundError, UnicodeDecodeError, json.JSONDecodeError, struct.error) as problem:
        row["error"] = f"{type(problem).__name__}: {problem}"
    return row


def _headed(handle, magic: bytes, size: int, row: dict) -> None:
    (length,) = struct.unpack("<I", magic[12:16])
    header = _exact(handle, 16, length).decode("utf-8")
    if not isinstance(json.loads(header), dict):
        raise BadClip("header is not an object")
    row.update(kind="headed", version=magic[7], header=header)
    if size < 24:
        return
    tail = _exact(handle, size - 24, 24)
    mark, count, offset = struct.unpack("<IIq", tail[8:])
    if mark != vocab.INDEX_MAGIC:
        return
    row["index_count"] = count
    if count == 0 or offset < 0 or offset + 16 * count > size:
        return
    row["index_offset"] = offset
    (first,) = struct.unpack("<q", _exact(handle, offset, 8))
    if first > 0:
        row["first_meta"] = item_json(handle, first)


INDEX_DDL = "clip_id string, path string, ordinal bigint, offset bigint, ts_ns bigint"
TABLES = {"clips": RAW_SCHEMA, "frame_index": INDEX_DDL, "frame_meta": f"{INDEX_DDL}, meta string"}

# Bytes of a file whose frames are one task's share; an index entry stands for a frame of a megabyte or more.
SHARE_BYTES = 64 << 30
# Frames of one batch.
FRAME_BATCH = 65_536


@dataclass
class ClipShares(InputPartition):
    """Files with the share of their frames to read: path, share, number of shares."""

    files: list[tuple[str, int, int]]


class ClipReader(DataSourceReader):
    """Reads a folder of clips. ``pathGlobFilter`` chooses files by name before any is opened;
    ``kind`` ends the reading of other files after their first bytes; ``firstFrame`` and
    ``lastFrame`` cut the index before it is read.

    Conditions come as options: with filters pushed by Spark 4.1.2, a union of two filtered forms
    of one relation lost rows.
    """

    def __init__(self, options: dict):
        self.options = options
        self.table = options.get("table", "clips")
        self.named = options.get("pathglobfilter", "*")
        self.kinds = set(options["kind"].split(",")) if "kind" in options else None
        self.first, self.last = int(options.get("firstframe", 0)), int(options.get("lastframe", 1 << 62))

    def partitions(self):
        root = self.options["path"]
        system, inner = _system(root)
        recursive = self.options.get("recursivefilelookup", "false") == "true"
        share = int(self.options.get("sharebytes", SHARE_BYTES))
        groups, held = [], 0
        for info in found_below(system, inner, recursive):
            named = info.path.lower().endswith(vocab.CLIP_SUFFIX)
            if not named or not fnmatchcase(info.base_name, self.named):
                continue
            # opening a file counts as CLIP_READ, whatever its size; a large index is divided
            shares = 1 if self.table == "clips" else max(1, -(-info.size // share))
            cost = CLIP_READ if self.table == "clips" else max(CLIP_READ, info.size // shares * (TASK_BYTES / share))
            for k in range(shares):
                if not groups or held + cost > TASK_BYTES // 2:
                    groups.append(ClipShares([]))
                    held = 0
                groups[-1].files.append((info.path, k, shares))
                held += cost
        return groups or [ClipShares([])]

    def read(self, partition) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if self.table != "clips":
            yield from gathered(b for path, k, shares in partition.files for b in self._frames(path, k, shares))
            return
        for path, _, _ in partition.files:
            row = read_clip(path, self.kinds)
            if self.kinds is None or row["kind"] in self.kinds:
                yield tuple(row[f.name] for f in RAW_SCHEMA.fields)

    def _frames(self, path: str, k: int, shares: int) -> Iterator[pa.RecordBatch]:
        """One share of a clip's frames; a file that is no clip with an index has none, its reason is in ``clips``."""
        try:
            with open_clip(path) as handle:
                count, offset = index_place(handle)
                first, last = max(self.first, count * k // shares), min(self.last + 1, count * (k + 1) // shares)
                for start in range(first, last, FRAME_BATCH):
                    n = min(FRAME_BATCH, last - start)
                    pairs = np.frombuffer(_exact(handle, offset + 16 * start, 16 * n), dtype="<i8").reshape(n, 2)
                    columns = [pa.array([path] * n), pa.array([path] * n), pa.array(np.arange(start, start + n, dtype=np.int64))]
                    columns += [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]
                    names = ["clip_id", "path", "ordinal", "offset", "ts_ns"]
                    if self.table == "frame_meta":
                        columns.append(pa.array([item_json(handle, at) for at in pairs[:, 0].tolist()], pa.string()))
                        names.append("meta")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        except (BadClip, FileNotFoundError):
            return


class RawClips(DataSource):
    """``spark.read.format("rawclips").load(folder)``: what lies in the raw clips of a folder.

    ``table`` is ``clips`` (the default: one row per file, with the reason where it cannot be
    read), ``frame_index`` (one row per frame) or ``frame_meta`` (the same with the metadata
    text, see :func:`typed_frames`). Options of :class:`ClipReader` make it open and read less. The folder is listed on the driver; for very many files
    use :func:`clip_paths` and :func:`scan_paths`.
    """

    @classmethod
    def name(cls) -> str:
        return "rawclips"

    def schema(self) -> T.StructType | str:
        table = self.options.get("table", "clips")
        if table not in TABLES:
            raise ValueError(f"table must be one of {', '.join(TABLES)}, not {table}")
        return TABLES[table]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ClipReader(dict(self.options))


def typed_frames(rows: DataFrame) -> DataFrame:
    """Table ``frame_meta`` with typed fields in place of the text."""
    return rows.select(frame_id(), "clip_id", "ordinal", "offset", "ts_ns", *[e.alias(n) for n, e in frame_fields(F.col("meta")).items()])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawClips)


def scan_paths(paths: DataFrame, path: str = "path", tasks: int | None = None) -> DataFrame:
    """The same rows for a table of paths, for any number of them."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("kind", pa.string()), ("version", pa.int32()),
                        ("header", pa.string()), ("index_count", pa.int64()), ("index_offset", pa.int64()),
                        ("first_ts", pa.int64()), ("first_meta", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([read_clip(p) for p in batch.column(0).to_pylist()], schema=schema)

    src = paths.select(F.col(path).alias("path"))
    return dealt(src, tasks or tasks_for(src, F.lit(CLIP_READ))).mapInArrow(run, RAW_SCHEMA)


def clip_paths(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Clip files of a folder. Only file metadata is read.

    One task lists the folder, and other tasks the folders in it, so that no listing passes
    through the driver; names that start with a dot or underscore are hidden, as in Spark.
    """
    local = "://" not in folder or folder.startswith("file:")
    head = "file:" if local else folder.split("://")[0] + "://"
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.int64()), ("is_dir", pa.bool_())])

    def rows(infos: list[pafs.FileInfo], known: list[tuple] = ()) -> pa.RecordBatch:
        found = [(i.path, i.size, (i.mtime_ns or 0) // 1_000_000 * 1000, not i.is_file) for i in infos if not hidden(i.base_name)]
        found = [r for r in [*known, *found] if r[3] or r[0].lower().endswith(vocab.CLIP_SUFFIX)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(schema)], schema=schema)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, inner = _system(folder)
            yield rows(system.get_file_info(pafs.FileSelector(inner)))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _system(folder)
        for batch in batches:
            known = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield rows([], [r for r in known if not r[3]])
            left = [r[0] for r in known if r[3]]
            while left:
                infos = system.get_file_info(pafs.FileSelector(left.pop()))
                left += [i.path for i in infos if not i.is_file and not hidden(i.base_name)]
                yield rows([i for i in infos if i.is_file])

    form = "path string, length bigint, modificationTime bigint, is_dir boolean"
    found = spark.range(0, 1, 1, 1).mapInArrow(top, form)
    if recursive:
        found = dealt(found, spark.sparkContext.defaultParallelism).mapInArrow(below, form)
    path = F.concat(F.lit(head), "path").alias("path")
    return found.where(~F.col("is_dir")).select(path, "length", F.timestamp_micros("modificationTime").alias("modificationTime"))


HEADER_SCHEMA = T.StructType(
    [
        T.StructField("sensorArrangment", T.StringType()),
        T.StructField("sensorOrientation", T.LongType()),
        *[
            T.StructField(n, M9)
            for n in (
                "forwardMatrix1", "forwardMatrix2", "colorMatrix1", "colorMatrix2",
                "calibrationMatrix1", "calibrationMatrix2",
            )
        ],
        T.StructField("whiteLevel", T.DoubleType()),
        T.StructField("blackLevel", M9),
        T.StructField("baselineExposure", T.DoubleType()),
        T.StructField("apertures", M9),
        T.StructField("focalLengths", M9),
        T.StructField("uniqueCameraModel", T.StringType()),
        T.StructField("numSegments", T.LongType()),
        T.StructField(
            "extraData",
            T.StructType(
                [
                    T.StructField("recordingType", T.StringType()),
                    T.StructField("audioSampleRate", T.LongType()),
                    T.StructField("audioChannels", T.LongType()),
                    T.StructField("useAccurateTimestamp", T.BooleanType()),
                    T.StructField(
                        "metadata",
                        T.StructType(
                            [
                                T.StructField(n, T.StringType())
                                for n in ("build.model", "build.manufacturer", "version.major", "version.build")
                            ]
                        ),
                    ),
                ]
            ),
        ),
        T.StructField(
            "deviceSpecificProfile",
            T.StructType([T.StructField("cameraId", T.StringType()), T.StructField("deviceModel", T.StringType())]),
        ),
        T.StructField("colorIlluminant1", T.StringType()),
        T.StructField("colorIlluminant2", T.StringType()),
        T.StructField("lensShadingMap", T.ArrayType(M9)),
        T.StructField("lensShadingMapWidth", T.LongType()),
        T.StructField("lensShadingMapHeight", T.LongType()),
    ]
)

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("asShotNeutral", M9),
        T.StructField("exposureTime", T.DoubleType()),
        T.StructField("iso", T.DoubleType()),
        T.StructField("focalLength", T.DoubleType()),
        T.StructField("aperture", T.DoubleType()),
        T.StructField("dynamicBlackLevel", M9),
        T.StructField("dynamicWhiteLevel", T.DoubleType()),
        T.StructField("lensShadingMap", T.ArrayType(M9)),
        T.StructField("lensShadingMapWidth", T.LongType()),
        T.StructField("lensShadingMapHeight", T.LongType()),
    ]
)

LEGACY_DDL = (
    "frame_count bigint, width int, height int, fps double, has_audio boolean, audio_sample_rate bigint, "
    "audio_channels int, bit_depth int, bayer_code int, sensor_make string, sensor_model string, "
    "camera_model string, lens_model string, focal_length double, aperture double, iso bigint, "
    "exposure_time double, white_balance double, capture_date string, frame_offsets array<bigint>, "
    "audio_offset bigint, audio_length bigint, sensor_width int, sensor_height int, active_offset_x int, "
    "active_offset_y int, active_width int, active_height int"
)

CLIP_DDL = (
    "clip_id string, path string, size bigint, version int, frame_count bigint, width int, height int, fps double, "
    "has_audio boolean, audio_sample_rate bigint, audio_channels int, bit_depth int, pattern string, "
    "sensor_make string, sensor_model string, camera_model string, lens_model string, focal_length double, "
    "aperture double, iso bigint, exposure_time double, white_balance double, capture_date string, "
    "color_matrix array<double>, color_matrix2 array<double>, forward_matrix1 array<double>, "
    "forward_matrix2 array<double>, calibration_matrix1 array<double>, calibration_matrix2 array<double>, "
    "illuminant1 int, illuminant2 int, wb_gains array<double>, frame_offsets array<bigint>, audio_offset bigint, "
    "audio_length bigint, sensor_width int, sensor_height int, active_offset_x int, active_offset_y int, "
    "active_width int, active_height int, white_level double, black_level double, black_levels array<double>, "
    "black_level_count int, lens_grid array<array<double>>, grid_w int, grid_h int, dynamic_black array<double>, "
    "dynamic_white double, first_ts bigint, index_count bigint, index_offset bigint, first_neutral array<double>"
)


def ddl_fields(ddl: str) -> dict[str, str]:
    """Names and types of a flat column list."""
    return dict(part.split(" ", 1) for part in ddl.split(", "))


def nine(values: Column) -> Column:
    """A matrix must have nine entries, else it is null."""
    return F.when(F.size(values) == 9, values)


def not_empty(value: Column) -> Column:
    return F.when(value != "", value)


def _shaped(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """All clip columns in order; what a generation lacks is null."""
    return df.select(
        *[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ddl_fields(CLIP_DDL).items()]
    )


def frame_fields(text: Column) -> dict[str, Column]:
    """Typed fields of one frame's metadata text, with their defaults."""
    j = F.from_json(text, FRAME_SCHEMA)
    neutral = F.array(*[F.coalesce(F.get(j["asShotNeutral"], i), F.lit(1.0)) for i in range(3)])
    black = j["dynamicBlackLevel"]
    four = F.array(*[F.get(black, i) for i in range(4)])
    complete = (F.size(black) >= 4) & ~F.exists(four, lambda v: v.isNull())
    grid = F.slice(j["lensShadingMap"], 1, 4)
    nodes = j["lensShadingMapWidth"] * j["lensShadingMapHeight"]
    grid_ok = (F.size(j["lensShadingMap"]) >= 4) & ~F.exists(grid, lambda c: F.size(c) < nodes)
    return {
        "width": F.coalesce(j["width"], F.lit(0)).cast("int"),
        "height": F.coalesce(j["height"], F.lit(0)).cast("int"),
        "neutral": neutral,
        "exposure_time": F.coalesce(j["exposureTime"], F.lit(0.0)),
        "iso": F.coalesce(j["iso"], F.lit(0.0)),
        "focal_length": F.coalesce(j["focalLength"], F.lit(0.0)),
        "aperture": F.coalesce(j["aperture"], F.lit(0.0)),
        "dynamic_black": F.when(complete, four),
        "dynamic_white": j["dynamicWhiteLevel"],
        "lens_grid": F.when(grid_ok, grid),
        "grid_w": F.when(grid_ok, j["lensShadingMapWidth"].cast("int")),
        "grid_h": F.when(grid_ok, j["lensShadingMapHeight"].cast("int")),
    }


def headed_clips(raw: DataFrame) -> DataFrame:
    """Clips with a JSON header, first-frame size and gains included."""
    src = raw.where((F.col("kind") == "headed") & F.col("error").isNull())
    src = src.withColumns({"h": F.from_json("header", HEADER_SCHEMA), "f": F.from_json("first_meta", FRAME_SCHEMA)})
    h, f = F.col("h"), F.col("f")
    build = h["extraData"]["metadata"]
    mean, count, padded = numeric.level_stats(h["blackLevel"])
    good_first = (f["width"] > 0) & (f["height"] > 0)
    grid_ok = (F.size(h["lensShadingMap"]) >= 4) & h["lensShadingMapWidth"].isNotNull() & h["lensShadingMapHeight"].isNotNull()
    channels = F.coalesce(h["extraData"]["audioChannels"], F.lit(0))
    zero = F.lit(0)
    values = {
        "clip_id": F.col("path"),
        "path": F.col("path"),
        "size": F.col("size"),
        "version": F.col("version"),
        "frame_count": F.coalesce("index_count", zero),
        "width": F.coalesce(F.when(good_first, f["width"]), zero),
        "height": F.coalesce(F.when(good_first, f["height"]), zero),
        "fps": F.lit(0.0),
        "has_audio": channels > 0,
        "audio_sample_rate": F.coalesce(h["extraData"]["audioSampleRate"], zero),
        "audio_channels": channels,
        "bit_depth": F.when(h["whiteLevel"].isNull(), 12).otherwise(numeric.bit_depth(h["whiteLevel"])),
        "pattern": vocab.lookup(h["sensorArrangment"], vocab.ARRANGEMENT, "RGGB"),
        "sensor_make": not_empty(build.getField("build.manufacturer")),
        "camera_model": F.coalesce(
            not_empty(h["deviceSpecificProfile"]["deviceModel"]),
            not_empty(h["uniqueCameraModel"]),
            not_empty(build.getField("build.model")),
        ),
        "focal_length": F.try_element_at(h["focalLengths"], F.lit(-1)),
        "aperture": F.try_element_at(h["apertures"], F.lit(-1)),
        "color_matrix": nine(F.coalesce(h["colorMatrix1"], h["forwardMatrix1"])),
        "color_matrix2": nine(h["colorMatrix2"]),
        "forward_matrix1": nine(h["forwardMatrix1"]),
        "forward_matrix2": nine(h["forwardMatrix2"]),
        "calibration_matrix1": nine(h["calibrationMatrix1"]),
        "calibration_matrix2": nine(h["calibrationMatrix2"]),
        "illuminant1": illuminant_code(h["colorIlluminant1"]),
        "illuminant2": illuminant_code(h["colorIlluminant2"]),
        "wb_gains": F.when(good_first & (F.size(f["asShotNeutral"]) >= 3), numeric.wb_gains(f["asShotNeutral"])),
        "sensor_width": zero, "sensor_height": zero, "active_offset_x": zero, "active_offset_y": zero,
        "active_width": zero, "active_height": zero,
        "white_level": F.coalesce(h["whiteLevel"], F.lit(16383.0)),
        "black_level": mean,
        "black_levels": padded,
        "black_level_count": count,
        "lens_grid": F.when(grid_ok, F.slice(h["lensShadingMap"], 1, 4)),
        "grid_w": F.when(grid_ok, h["lensShadingMapWidth"]),
        "grid_h": F.when(grid_ok, h["lensShadingMapHeight"]),
        "index_count": F.col("index_count"),
        "index_offset": F.col("index_offset"),
        "first_neutral": f["asShotNeutral"],
    }
    return _shaped(src, values)


def legacy_clips(raw: DataFrame) -> DataFrame:
    """Clips with a tagged binary header. Its matrix tags are skipped."""
    src = raw.where((F.col("kind") == "legacy") & F.col("error").isNull())
    src = src.withColumn("h", F.from_json("header", LEGACY_DDL))
    values = {name: F.col("h")[name] for name in ddl_fields(LEGACY_DDL)}
    for name in ("sensor_width", "sensor_height", "active_offset_x", "active_offset_y", "active_width", "active_height"):
        values[name] = F.coalesce(values[name], F.lit(0))
    values.update(
        clip_id=F.col("path"),
        path=F.col("path"),
        size=F.col("size"),
        version=F.col("version"),
        pattern=numeric.bayer_name(values["bayer_code"]),
        white_level=F.lit(16383.0),
        black_level=F.lit(0.0),
        black_levels=F.array(*[F.lit(0.0)] * 4),
        black_level_count=F.lit(0),
    )
    return _shaped(src, values)


def clips(raw: DataFrame, timeline: DataFrame | None = None) -> DataFrame:
    """U4: both generations in one catalog; with a timeline (A1) also rate and start."""
    both = headed_clips(raw).unionByName(legacy_clips(raw))
    if timeline is None:
        return both
    t = timeline.select("clip_id", F.col("first_ts").alias("_first"), F.col("fps").alias("_fps"))
    j = both.join(t, "clip_id", "left")
    j = j.withColumns(
        {"first_ts": F.coalesce("_first", "first_ts"), "fps": F.when(F.col("_fps") > 0, F.col("_fps")).otherwise(F.col("fps"))}
    )
    return j.select(*both.columns)


def failures(raw: DataFrame) -> DataFrame:
    """Files that could not be read, with the reason."""
    return raw.where(F.col("error").isNotNull()).select("path", "error")


def frame_index(clips: DataFrame, entries_per_task: int = 262_144, tasks: int | None = None) -> DataFrame:
    """S3: one row per frame: position in the file, offset and timestamp.

    The index of every clip is cut into chunks before reading, so chunks of one
    huge clip are read in parallel.
    """
    known = clips.where(F.col("index_offset").isNotNull() & (F.col("index_count") > 0))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("index_count") - 1, F.lit(entries_per_task).cast("bigint"))
    chunks = known.select("clip_id", "path", "index_offset", "index_count", F.explode(starts).alias("start"))
    size = F.least(F.lit(entries_per_task).cast("bigint"), F.col("index_count") - F.col("start")) * 16
    chunks = dealt(chunks, tasks or tasks_for(chunks, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(entries(batches))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = min(entries_per_task, row["index_count"] - row["start"])
                with open_clip(row["path"]) as handle:
                    data = _exact(handle, row["index_offset"] + 16 * row["start"], 16 * n)
                pairs = np.frombuffer(data, dtype="<i8").reshape(n, 2)
                ordinals = np.arange(row["start"], row["start"] + n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["clip_id"]] * n, pa.string()),
                        pa.array([row["path"]] * n, pa.string()),
                        pa.array(ordinals),
                        pa.array(np.ascontiguousarray(pairs[:, 0])),
                        pa.array(np.ascontiguousarray(pairs[:, 1])),
                    ],
                    names=["clip_id", "path", "ordinal", "offset", "ts_ns"],
                )

    return chunks.mapInArrow(run, "clip_id string, path string, ordinal bigint, offset bigint, ts_ns bigint")


def frame_id() -> Column:
    """Name of a frame across all tables: its clip and its position in the file."""
    return F.concat_ws("#", F.col("clip_id"), F.col("ordinal").cast("string")).alias("frame_id")


def frame_meta(index: DataFrame) -> DataFrame:
    """One row per frame with its typed metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            texts, last, handle = [], None, None
            for path, offset in zip(rows["path"], rows["offset"]):
                if path != last:
                    if handle is not None:
                        handle.close()
                    handle, last = open_clip(path), path
                texts.append(item_json(handle, offset))
            if handle is not None:
                handle.close()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "meta"]
            )

    return typed_frames(index.select("clip_id", "path", "ordinal", "offset", "ts_ns").mapInArrow(run, TABLES["frame_meta"]))
