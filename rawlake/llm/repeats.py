"""Windows of units (words or bytes) that also start in a document with a smaller id.

Every window of ``width`` units has an anchor: the run of ``gram`` units inside it whose hash
is smallest. Neighbouring windows share anchors, so a text has one *stretch* of windows per
anchor, some ten times fewer than windows. Equal windows have equal anchors, hence

* a stretch whose anchor no smaller document has is kept;
* a stretch that a smaller document has as a whole is removed;
* only the rest, where repeats begin and end, is looked at window by window.

Before that, texts may be cut into chunks of windows at places that depend on the units
alone, and chunks that a smaller document has as a whole are removed. What they hold is also
in the smallest document that has the chunk, so they need not be looked at again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import ClassVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawlake.llm.common import stage

FACTOR = np.uint64(0x5851F42D4C957F2D)
# Units handled at once, as their arrays then stay in a processor's cache; longer texts are cut
# into overlapping parts.
PART = 1 << 17
PLACE_BITS = np.uint64(24)
# The hash of a byte.
BYTES = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
    out = []
    for f in (FACTOR, inverse):
        p = np.full(n, f, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of runs of any length over one array of unit hashes."""

    _held: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, units: np.ndarray):
        if units.dtype == np.uint8:
            units = BYTES[units]
        if Rolling._held is None or len(Rolling._held[0]) <= len(units):
            Rolling._held = _powers(max(PART + 1024, len(units) + 1))
        up, self.down = Rolling._held
        self.sums = np.zeros(len(units) + 1, dtype=np.uint64)
        np.cumsum(units * up[: len(units)], dtype=np.uint64, out=self.sums[1:])

    def every(self, n: int) -> np.ndarray:
        """Of the runs of ``n`` units at every place."""
        return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]

    def at(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + n] - self.sums[start]) * self.down[start]


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` neighbours, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Stretches:
    """The stretches of several texts laid end to end in ``units``, which end at ``ends``."""

    def __init__(self, units: np.ndarray, ends: np.ndarray, width: int, gram: int, chunk: int = 0):
        self.rolling = Rolling(units)
        self.units, self.width, self.gram, self.ends = units, width, gram, ends
        self.grams = mixed(self.rolling.every(gram)) if len(units) >= width else np.zeros(0, dtype=np.uint64)
        inside = np.ones(max(0, len(units) - width + 1), dtype=bool)
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            inside[max(begin, end - width + 1) : end] = False
        self.starts = np.flatnonzero(inside)
        if chunk:
            new = (np.diff(self.starts, prepend=-2) != 1) | (self.grams[self.starts] % np.uint64(chunk) == 0)
            self.chunk_at = np.flatnonzero(new)
            self.chunk_count = np.diff(self.chunk_at, append=len(self.starts))

    def in_text(self, keys: list[tuple], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, row, place in its whole text) of some starts."""
        text = np.searchsorted(self.ends, first, side="right")
        doc, row, offset = (np.array([key[c] for key in keys], dtype=np.int64)[text] for c in range(3))
        return doc, row, first - (self.ends - np.diff(self.ends, prepend=0))[text] + offset

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, windows, hash, second hash) of the chunks.

        Texts of some patterns have equal rolling hashes if they are long, and a chunk has no
        longest length. The second hash is of another kind, so that only equal chunks agree
        in both.
        """
        first, n = self.starts[self.chunk_at], self.chunk_count
        raw, size = memoryview(np.ascontiguousarray(self.units)).cast("B"), self.units.itemsize
        bounds = zip((first * size).tolist(), ((first + n + self.width - 1) * size).tolist(), strict=True)
        second = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in bounds), dtype=np.uint64, count=len(first))
        return first, n, mixed(self.rolling.at(first, n + self.width - 1) + n.astype(np.uint64)), second

    def find(self, chosen: np.ndarray | None = None) -> Stretches:
        """Set the stretches, of the chosen chunks only."""
        starts = self.starts if chosen is None else self.starts[np.repeat(chosen, self.chunk_count)]
        width, ends = self.width, self.ends
        places = np.arange(len(self.grams), dtype=np.uint64)
        at = ((self.grams >> PLACE_BITS) << PLACE_BITS) | places
        at = least_of(at, width - self.gram + 1)[starts] & np.uint64((1 << 24) - 1) if len(starts) else places[:0]
        at, grams = at.astype(np.int64), self.grams
        cut = np.flatnonzero(np.diff(at, prepend=-1) | (np.diff(starts, prepend=-2) != 1))
        self.first = starts[cut]
        self.count = np.diff(cut, append=len(starts))
        self.text = np.searchsorted(ends, self.first, side="right")
        self.anchor = grams[at[cut]]
        self.whole = mixed(self.rolling.at(self.first, self.count + width - 1) + self.count.astype(np.uint64))
        return self


def parts(texts: Iterator[tuple[tuple, np.ndarray]], width: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Texts laid end to end in bounded parts: (key and offset of each, units, ends).

    A longer text is cut so that each of its windows is in exactly one part.
    """
    keys, held, size = [], [], 0
    for key, units in texts:
        for start in range(0, max(1, len(units) - width + 1), PART - width + 1):
            piece = units[start : start + PART]
            if size and size + len(piece) > PART:
                yield keys, np.concatenate(held), np.cumsum([len(h) for h in held])
                keys, held, size = [], [], 0
            keys.append((*key, start))
            held.append(piece)
            size += len(piece)
    if keys:
        yield keys, np.concatenate(held), np.cumsum([len(h) for h in held])


# --- count-min prefilter ------------------------------------------------------


def cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(anchors ^ mixed(np.full(1, row + 1, dtype=np.uint64))) >> np.uint64(64 - bits)


def _pieces(row: int, once: np.ndarray, more: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Cells by slices; a place in a slice takes two bytes."""
    slices = np.unique(np.concatenate([once, more]) // SLICE)
    for s in slices:
        a, b = (x[slice(*np.searchsorted(x, [s * SLICE, (s + 1) * SLICE]))] % SLICE for x in (once, more))
        yield row, int(s), a.astype("<u2").tobytes(), b.astype("<u2").tobytes()


def opened(s: Stretches, keys: list[tuple], wanted: Bits | None) -> Stretches:
    """The stretches of the chunks still open, or all."""
    if wanted is None:
        return s.find()
    return s.find(wanted(np.stack([x.view(np.uint64) for x in s.in_text(keys, s.starts[s.chunk_at])])))


def sketch(
    docs: DataFrame, units: Callable, width: int, gram: int, depth: int, bits: int, chunk: int = 0, wanted: Bits | None = None
) -> DataFrame:
    """(row, slice, bitmap) of the cells that two or more documents may share.

    A count-min sketch with ``depth`` rows of ``2 ** bits`` counters that stop at two. Every
    task counts each anchor once a document and sends the cells it touched; the pieces are
    added slice by slice, first in groups of 64 tasks. A counter never falls below the number
    of documents with a window that has the anchor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() // 64
        waiting, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            anchors = np.concatenate(waiting)
            for row in range(depth):
                found, n = np.unique(cells(anchors, row, bits), return_counts=True)
                found = found.astype(np.int64)
                rows = list(_pieces(row, found[n == 1], found[n > 1]))
                for at in range(0, len(rows), 512):
                    yield _batch([(r, s, task, a, b) for r, s, a, b in rows[at : at + 512]], CELLS)

        for keys, laid, ends in parts(units(batches), width):
            s = opened(Stretches(laid, ends, width, gram, chunk), keys, wanted)
            waiting.append(_distinct(s.text, s.anchor))
            size += len(waiting[-1])
            if size > 1 << 21:
                yield from flush()
                waiting, size = [], 0
        if size:
            yield from flush()

    def add(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, counts = None, np.zeros(SLICE, dtype=np.uint8)

            def done():
                row, s, task = now
                if last:
                    return _batch([(row, s, np.packbits(counts >= 2).tobytes())], MERGED)
                once, more = (np.flatnonzero(counts == k).astype("<u2").tobytes() for k in (1, 2))
                return _batch([(row, s, task, once, more)], CELLS)

            for batch in batches:
                for r in batch.to_pylist():
                    key = (r["row"], r["slice"], 0 if last else r["task"])
                    if key != now:
                        if now is not None:
                            yield done()
                        now = key
                        counts[:] = 0
                    once = np.frombuffer(r["once"], "<u2")
                    counts[once] = np.minimum(counts[once] + 1, 2)
                    counts[np.frombuffer(r["more"], "<u2")] = 2
            if now is not None:
                yield done()

        return run

    flat = "row int, slice int, task int, once binary, more binary"
    got = docs.mapInArrow(count, flat)
    got = got.repartition("row", "slice", "task").sortWithinPartitions("row", "slice", "task").mapInArrow(add(False), flat)
    return got.repartition("row", "slice").sortWithinPartitions("row", "slice").mapInArrow(add(True), "row int, slice int, bitmap binary")


CELLS = pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("task", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
MERGED = pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("bitmap", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _distinct(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The anchors, each once a text."""
    order = np.lexsort((anchor, text))
    t, a = text[order], anchor[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1])
    return a[new]


class Shared:
    """A table of bits that all tasks read, sent compressed; a worker unpacks it once."""

    _open: ClassVar[dict[str, np.ndarray]] = {}

    def __init__(self, spark: SparkSession, table: np.ndarray):
        self.key, self.shape = uuid.uuid4().hex, table.shape
        self.held = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))

    def table(self) -> np.ndarray:
        if self.key not in Shared._open:
            while len(Shared._open) > 1:  # a stage reads two at most
                Shared._open.pop(next(iter(Shared._open)))
            Shared._open[self.key] = np.frombuffer(zlib.decompress(self.held.value), dtype=np.uint8).reshape(self.shape)
        return Shared._open[self.key]


# Below 2 ** 31, so that no product passes 63 bits.
BIT_FACTORS = (0x1E3779B1, 0x65EBCA6B)


class Bits:
    """A set of keys as bits of their hashes, of fixed size: it may hold others, and misses none."""

    BITS = 27

    def __init__(self, rows: DataFrame, *columns: str):
        # bitmaps count from 1
        cell = F.pmod(_hash_of(*columns), F.lit(1 << Bits.BITS)) + 1
        table = np.zeros((1 << Bits.BITS) // 8, dtype=np.uint8)
        held = rows.groupBy(F.bitmap_bucket_number(cell).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("m"))
        for r in held.toLocalIterator():
            part = np.frombuffer(r["m"], np.uint8)
            at = (r["b"] - 1) * len(part)
            table[at : at + len(part)] = part[: len(table) - at]
        self.held = Shared(rows.sparkSession, table)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """For an array with a row for each column of the keys."""
        cell = np.zeros(keys.shape[1], dtype=np.uint64)
        for k in keys:
            for part, factor in zip((k & np.uint64(0xFFFFFFFF), k >> np.uint64(32)), BIT_FACTORS, strict=True):
                cell = (cell ^ part) * np.uint64(factor) % np.uint64((1 << 31) - 1)
        cell = (cell % np.uint64(1 << Bits.BITS)).astype(np.int64)
        return (self.held.table()[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _hash_of(*columns: str):
    """The same arithmetic on columns."""
    cell = F.lit(0).cast("bigint")
    for c in columns:
        low, high = F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(c).cast("bigint"), 32)
        for part, factor in zip((low, high), BIT_FACTORS, strict=True):
            cell = F.pmod(cell.bitwiseXOR(part) * F.lit(factor), F.lit((1 << 31) - 1))
    return cell


class Estimate:
    """Whether an anchor may be in two documents, by the merged sketch. At most depth * 2 ** bits / 8 bytes."""

    def __init__(self, spark: SparkSession, merged: DataFrame, depth: int, bits: int):
        table = np.zeros((depth, (1 << bits) // 8), dtype=np.uint8)
        for r in merged.toLocalIterator():
            table[r["row"], r["slice"] * (SLICE // 8) : (r["slice"] + 1) * (SLICE // 8)] = np.frombuffer(r["bitmap"], np.uint8)
        self.bits = bits
        self.depth = depth
        self.held = Shared(spark, table)

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), dtype=bool)
        for row in range(self.depth):
            c = cells(anchors, row, self.bits)
            byte = self.held.table()[row][(c >> np.uint64(3)).astype(np.int64)]
            out &= (byte >> (np.uint64(7) - (c & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return out


# --- exact passes -------------------------------------------------------------

KEY = ["doc", "row"]


def chunks(docs: DataFrame, units: Callable, width: int, gram: int, chunk: int) -> DataFrame:
    """(doc, row, first, n, whole, second) of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, laid, ends in parts(units(batches), width):
            s = Stretches(laid, ends, width, gram, chunk)
            first, n, whole, second = s.chunks()
            columns = [*s.in_text(keys, first), n.astype(np.int64), whole.view(np.int64), second.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "row", "first", "n", "whole", "second"])

    return docs.mapInArrow(run, "doc bigint, row bigint, first bigint, n bigint, whole bigint, second bigint")


def stretches(
    docs: DataFrame, units: Callable, width: int, gram: int, likely: Estimate, chunk: int = 0, wanted: Bits | None = None
) -> DataFrame:
    """(doc, row, first, n, anchor, whole) of the stretches whose anchor may be in two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, laid, ends in parts(units(batches), width):
            s = opened(Stretches(laid, ends, width, gram, chunk), keys, wanted)
            k = np.flatnonzero(likely(s.anchor))
            if not len(k):
                continue
            columns = [*s.in_text(keys, s.first[k]), s.count[k].astype(np.int32), s.anchor[k].view(np.int64), s.whole[k].view(np.int64)]
            for at in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["doc", "row", "first", "n", "anchor", "whole"])

    return docs.mapInArrow(run, "doc bigint, row bigint, first bigint, n int, anchor bigint, whole bigint")


def judged(found: DataFrame) -> DataFrame:
    """Stretches that are removed as a whole (``gone``) and those to look into (not ``gone``).

    Both kinds only of anchors that two documents have. Everything is an aggregate followed
    by a join, so that a very common anchor is spread.
    """
    whole = found.groupBy("anchor", "whole").agg(F.min("doc").alias("least"))
    anchor = whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    known = whole.join(anchor, "anchor").select("anchor", "whole", "least", "kinds")
    both = found.join(known, ["anchor", "whole"])
    gone = F.col("doc") > F.col("least")
    return both.where(gone | (F.col("kinds") > 1)).select(*KEY, "first", "n", "anchor", "kinds", gone.alias("gone"))


def ranges(*tables: DataFrame) -> DataFrame:
    """(doc, row, firsts, ns): per text, the window starts of the tables as ranges."""
    rows = reduce(DataFrame.unionByName, [t.select(*KEY, "first", "n") for t in tables])
    held = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", F.col("n").cast("bigint").alias("n")))).alias("held"))
    return held.select(*KEY, F.col("held.first").alias("firsts"), F.col("held.n").alias("ns"))


def covered(length: int, firsts: np.ndarray, ns: np.ndarray, width: int) -> np.ndarray:
    """Which of ``length`` units lie in a window of the ranges."""
    steps = np.zeros(length + 1, dtype=np.int64)
    np.add.at(steps, firsts, 1)
    np.add.at(steps, firsts + ns + width - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def among(batches: Iterator[pa.RecordBatch], keys: Bits, inside: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose (doc, row) may be among the keys, or those that are not; nothing moves."""
    for batch in batches:
        k = np.stack([np.asarray(batch.column(c)).astype(np.int64).view(np.uint64) for c in KEY])
        chosen = batch.filter(pa.array(keys(k) == inside))
        if chosen.num_rows:
            yield chosen


def later(windows: DataFrame) -> DataFrame:
    """Windows (doc, row, first, h) whose hash a smaller document has, as ranges of one."""
    least = windows.groupBy("h").agg(F.min("doc").alias("least"))
    hit = windows.join(least, "h").where(F.col("doc") > F.col("least"))
    return hit.select(*KEY, "first", F.lit(1).alias("n"))


def staged_stretches(docs: DataFrame, units: Callable, width: int, gram: int, depth: int, bits: int, chunk: int = 0) -> DataFrame:
    """Stretches and chunks to remove (``gone``), and stretches to look into.

    ``chunk`` is the mean number of windows in a chunk; 0 leaves this step out.
    """
    wanted = removed = None
    if chunk:
        cut = stage(chunks(docs, units, width, gram, chunk))
        least = cut.groupBy("whole", "second").agg(F.min("doc").alias("least"))
        told = stage(cut.join(least, ["whole", "second"]).select(*KEY, "first", "n", (F.col("doc") > F.col("least")).alias("gone")))
        wanted = Bits(told.where(~F.col("gone")), *KEY, "first")
        removed = told.where("gone")
    merged = stage(sketch(docs, units, width, gram, depth, bits, chunk, wanted))
    likely = Estimate(docs.sparkSession, merged, depth, bits)
    found = stage(judged(stage(stretches(docs, units, width, gram, likely, chunk, wanted))))
    if removed is None:
        return found
    none = {"anchor": F.lit(0).cast("bigint"), "kinds": F.lit(0).cast("bigint"), "n": F.col("n").cast("int")}
    return found.unionByName(removed.withColumns(none))
