"""Sharding: minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rawlake.llm.common import stage, text_of

# Rows that one numbering task holds on average.
CHUNK_ROWS = 50_000
# The first summary has 2 ** FIRST_BITS ranges of the key; each refined range has 2 ** STEP_BITS.
FIRST_BITS, STEP_BITS = 16, 8


@dataclass(frozen=True)
class Range:
    """Consecutive keys ``prefix << shift .. ((prefix + 1) << shift) - 1``, their bytes and groups."""

    prefix: int
    shift: int
    size: int
    groups: int

    @property
    def first(self) -> int:
        return self.prefix << self.shift


def summary(groups: DataFrame, shift: int, within: list[Range] | None = None) -> list[Range]:
    """Sizes of key ranges, of all keys or only within the given ones.

    At most 2 ** FIRST_BITS rows come to the driver, or 2 ** STEP_BITS for each range refined.
    """
    if within is not None:
        inside = F.lit(False)
        for r in within:
            inside |= F.col("key").between(r.first, r.first + (1 << r.shift) - 1)
        groups = groups.where(inside)
    by = groups.groupBy(F.expr(f"shiftright(key, {shift})").alias("p"))
    rows = by.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((Range(r["p"], shift, r["size"], r["n"]) for r in rows), key=lambda r: r.first)


def fill(ends: list[int], ranges: list[Range], capacity: int, shards: int, whole: bool) -> list[int] | None:
    """Greedy check: offsets where shards of this capacity end, or None if there are too many.

    Ranges of several groups count as indivisible if ``whole``, else as divisible.
    """
    cuts, start, total = [], 0, ends[-1]
    while start + capacity < total:
        i = bisect_right(ends, start + capacity)
        before = ends[i - 1] if i else 0
        cut = before if whole or ranges[i].groups == 1 else start + capacity
        if cut <= start or len(cuts) + 1 >= shards:
            return None
        cuts.append(cut)
        start = cut
    return cuts


def smallest(ends: list[int], ranges: list[Range], shards: int, whole: bool) -> int:
    """Binary search of the smallest feasible capacity."""
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if fill(ends, ranges, middle, shards, whole) is None:
            low = middle + 1
        else:
            high = middle
    return low


def level(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts for a feasible capacity, each as near to an even share as the capacity allows."""
    total = ends[-1]
    latest_start, at = [], total
    for _ in range(shards):  # filling from the right: where the last 1, 2, ... shards may start
        i = bisect_left(ends, at - capacity)
        at = 0 if at <= capacity else ends[i]
        latest_start.append(at)
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        low, high = max(start, latest_start[left - 1]), start + capacity
        ideal = min(max(start + (total - start) / (left + 1), low), high)
        i = bisect_left(ends, ideal)
        near = [e for e in (ends[i - 1] if i else 0, ends[min(i, len(ends) - 1)], low) if low <= e <= high]
        start = min(near, key=lambda e: abs(e - ideal))
        cuts.append(start)
    return cuts


def boundaries(groups: DataFrame, shards: int) -> list[int]:
    """Keys at which the second, third, ... shard starts.

    A search over sums of key ranges gives a lower bound (ranges divisible) and an upper
    bound (ranges whole) of the capacity; the few ranges in which they differ are summed
    more finely, until both agree. No more than those sums reaches the driver.
    """
    ranges = summary(groups, 64 - FIRST_BITS)
    if not ranges:
        return []
    while True:
        ends, at = [], 0
        for r in ranges:
            at += r.size
            ends.append(at)
        capacity = smallest(ends, ranges, shards, whole=False)
        if fill(ends, ranges, capacity, shards, whole=True) is not None:
            break
        upper = smallest(ends, ranges, shards, whole=True)
        tries = [fill(ends, ranges, capacity, shards, whole=False), fill(ends, ranges, upper, shards, whole=False)]
        at = {min(bisect_right(ends, cut), len(ends) - 1) for cuts in tries for cut in cuts or []}
        split = [ranges[i] for i in sorted(at) if ranges[i].groups > 1]
        if not split:
            capacity = upper
            break
        finer = [x for shift in {r.shift for r in split} for x in summary(groups, max(0, shift - STEP_BITS), [r for r in split if r.shift == shift])]
        ranges = sorted([r for r in ranges if r not in set(split)] + finer, key=lambda r: r.first)
    starts = [0, *ends]
    keys = []
    for cut in level(ends, capacity, shards):
        i = bisect_left(starts, cut)
        keys.append(ranges[i].first if i < len(ranges) else (1 << 63) - 1)
    return keys


def shard_column(key: Column, starts: list[int]) -> Column:
    """The number of shard starts at or below the key."""
    shard = F.lit(0)
    for start in starts:
        shard += (key >= F.lit(start)).cast("int")
    return shard.cast("int")


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("text",)
) -> DataFrame:
    """Documents in shards whose largest size in bytes is as small as whole groups of equal texts allow.

    Groups are ordered by a 64-bit hash of their text (texts that share a hash stay
    together) and cut contiguously. A document's size is its UTF-8 bytes plus 8; a null
    text counts as an empty one. Null or repeated ids are kept as rows of their own; an
    empty table gives no rows. Returns the id, ``size``, ``shard`` from 0 and ``slot``,
    gapless from 0 in each shard, and the columns ``carry``, which must have other names;
    no other column is read.
    """
    text = text_of(text_col)
    sized = docs.select(
        F.col(id_col), *carry, (F.octet_length(text) + 8).cast("bigint").alias("size"), F.xxhash64(text).alias("key")
    )
    groups = stage(sized.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    rows = groups.agg(F.sum("rows").alias("n")).first()["n"] or 0
    starts = boundaries(groups, shards)
    chunks = max(8, -(-rows // (shards * CHUNK_ROWS)))
    placed = sized.withColumn("shard", shard_column(F.col("key"), starts)).withColumn("row", F.monotonically_increasing_id())
    # chunks of a shard are dealt by row, so that many copies of one text do not meet in one
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    placed = stage(placed.drop("key"))
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("row")) - 1
    numbered = placed.withColumn("number", number).join(offsets, ["shard", "chunk"])
    return numbered.select(id_col, *carry, "size", "shard", (F.col("number") + F.col("before")).cast("bigint").alias("slot"))
