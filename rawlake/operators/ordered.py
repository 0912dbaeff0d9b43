"""Running totals, look-ahead and smoothing within groups of any size.

A plain window puts a whole group into one task. Here rows are partitioned by range of
(group, order), so a hot group lies over as many tasks as its rows need, and each task folds
its own sorted rows once. As the ranges follow each other, only the last group of a task goes
on in the next one: two edge rows per task tell what each task hands over, and what it is
handed is applied to the rows of its first group.

The folded rows are written below ``spark.checkpoint.dir`` before they are read again, as
ranges come from a sample and another execution could cut them elsewhere. The table stays
there; whoever owns that folder clears it.

Rows with equal order values are in any order among themselves, and all in one task. Group
columns are of atomic types; null is a group of its own, and so is NaN.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rawlake.session import range_tasks, written

VALUE, LOCAL, FACTOR, TASK, EDGE, CARRY = (f"_scan_{n}" for n in ("value", "local", "factor", "task", "edge", "carry"))
FIRST_ROW, LAST_ROW = 1, 2


@dataclass(frozen=True)
class Sum:
    """Inclusive sum of whole numbers; a null counts as 0."""

    def kinds(self, value: T.DataType) -> tuple[T.DataType, T.DataType]:
        return T.LongType(), T.LongType()

    def begin(self):
        return 0

    def step(self, values: pa.Array, new: np.ndarray, first: np.ndarray, held):
        v = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(v)
        start = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
        local = total - np.where(start < 0, -held, (total - v)[start])
        return pa.array(local), pa.array(first.astype(np.int64)), int(local[-1])

    def opening(self, value):
        return 0

    def closing(self, value, local, factor, carry):
        return local + factor * carry

    def result(self) -> Column:
        return F.col(LOCAL) + F.col(FACTOR) * F.col(CARRY)


@dataclass(frozen=True)
class Smooth:
    """``keep`` of the result before and the rest of the value, from the first value on.

    Each row is the map y -> factor * y + local of the result before its group's first row in
    the task; maps are composed, so blocks chain exactly, for any ``keep`` from 0 to 1.
    """

    keep: float

    def kinds(self, value: T.DataType) -> tuple[T.DataType, T.DataType]:
        return T.DoubleType(), T.DoubleType()

    def begin(self):
        return 1.0, 0.0

    def step(self, values: pa.Array, new: np.ndarray, first: np.ndarray, held):
        v = values.to_numpy(zero_copy_only=False)
        factor = np.where(new, 0.0, self.keep)
        term = np.where(new, v, (1.0 - self.keep) * v)
        term[0] += factor[0] * held[1]
        factor[0] *= held[0]
        reach = 1
        while reach < len(v) and factor[reach:].any():
            term[reach:] = term[reach:] + factor[reach:] * term[:-reach]
            factor[reach:] = factor[reach:] * factor[:-reach]
            reach *= 2
        return pa.array(term), pa.array(factor), (float(factor[-1]), float(term[-1]))

    def opening(self, value):
        return value

    def closing(self, value, local, factor, carry):
        return local + factor * carry

    def result(self) -> Column:
        return F.col(LOCAL) + F.col(FACTOR) * F.col(CARRY)


@dataclass(frozen=True)
class Seen:
    """Latest value that is not null, of the rows before."""

    def kinds(self, value: T.DataType) -> tuple[T.DataType, T.DataType]:
        return value, T.LongType()

    def begin(self):
        return None

    def step(self, values: pa.Array, new: np.ndarray, first: np.ndarray, held):
        n = len(values)
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -1))
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        latest = np.maximum.accumulate(np.where(valid, at, -1))
        before = np.concatenate([[-1], latest[:-1]])
        # place 0 is what the batch before hands over
        pool = pa.concat_arrays([pa.array([held], values.type), values])
        none = before < np.maximum(start, 0)
        local = pool.take(pa.array(np.where(none, 0, before + 1), mask=none & (start >= 0)))
        end = values[n - 1] if valid[-1] else local[n - 1]
        return local, pa.array(first.astype(np.int64)), end.as_py()

    def opening(self, value):
        return None

    def closing(self, value, local, factor, carry):
        known = local if value is None else value
        return carry if known is None and factor else known

    def result(self) -> Column:
        return F.coalesce(F.col(LOCAL), F.when(F.col(FACTOR) == 1, F.col(CARRY)))


def _differ(a: pa.Array, b: pa.Array) -> pa.Array:
    """Where two arrays differ, null and NaN being values like others."""
    out = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        out = pc.and_not(out, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return out


def _starts(keys: list[pa.Array], last: list[pa.Array] | None) -> np.ndarray:
    """Rows whose group is not that of the row before; the first row of a task is none."""
    new = np.zeros(len(keys[0]) if keys else 0, dtype=bool)
    for i, key in enumerate(keys):
        before = pa.concat_arrays([key[:1] if last is None else last[i], key[:-1]])
        new |= _differ(key, before).to_numpy(zero_copy_only=False)
    return new


def _folded(group: list[str], fold):
    """Fold the sorted rows of one task; its first and last row are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        state, last, opening, ready = fold.begin(), None, True, None

        def out(batch, local, factor, edge):
            n = batch.num_rows
            columns = [*batch.columns, local, factor, pa.array(np.full(n, task, np.int32)), pa.array(edge)]
            return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, LOCAL, FACTOR, TASK, EDGE])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = [batch.column(g) for g in group]
            new = _starts(keys, last) if keys else np.zeros(batch.num_rows, dtype=bool)
            first = opening & ~np.logical_or.accumulate(new)
            local, factor, state = fold.step(batch.column(VALUE), new, first, state)
            edge = np.zeros(batch.num_rows, np.int32)
            if ready is None:
                edge[0] = FIRST_ROW
            else:
                yield out(*ready)
            ready = batch, local, factor, edge
            last, opening = [k[-1:] for k in keys], bool(first[-1])
        if ready is not None:
            ready[3][-1] += LAST_ROW
            yield out(*ready)

    return run


def _handed(group: list[str], fold, kind: pa.DataType):
    """From the edge rows of all tasks, in order, to what each task is handed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, after = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = [batch.column(g) for g in group]
            new = _starts(keys, last) if keys else np.zeros(batch.num_rows, dtype=bool)
            tasks, carries = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in (TASK, EDGE, VALUE, LOCAL, FACTOR)), new, strict=True)
            for at, (task, edge, value, local, factor, other) in enumerate(rows):
                if edge & FIRST_ROW:
                    begins = other or (last is None and at == 0)
                    carry = fold.opening(value) if begins else after
                    tasks.append(task)
                    carries.append(carry)
                if edge & LAST_ROW:
                    after = fold.closing(value, local, factor, carry)
            last = [k[-1:] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array(carries, kind)], names=[TASK, CARRY])

    return run


def scan(df: DataFrame, group: list[str], order: list[Column], value: Column, fold, out: str, tasks: int | None = None) -> DataFrame:
    """One fold over the rows of each group in order: one range exchange, whatever the sizes of groups.

    ``tasks`` is the number of ranges; without it, it follows the bytes that the plan reads,
    and is the session's number of shuffle partitions, merged where small, at least.
    """
    keys = [*[F.col(g).asc() for g in group], *order]
    src = df.withColumn(VALUE, value)
    local, factor = fold.kinds(src.schema[VALUE].dataType)
    tasks = tasks or range_tasks(df)
    cut = src.repartitionByRange(tasks, *keys) if tasks else src.repartitionByRange(*keys)
    marks = [T.StructField(LOCAL, local), T.StructField(FACTOR, factor), T.StructField(TASK, T.IntegerType()), T.StructField(EDGE, T.IntegerType())]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in src.schema], *marks])
    folded = written(cut.sortWithinPartitions(*keys).mapInArrow(_folded(group, fold), schema))
    # at most two rows per task
    edges = folded.where(F.col(EDGE) > 0).select(*group, TASK, EDGE, VALUE, LOCAL, FACTOR)
    edges = edges.repartition(1).sortWithinPartitions(TASK, EDGE)
    kind = pa_type(local)
    handed = edges.mapInArrow(_handed(group, fold, kind), T.StructType([T.StructField(TASK, T.IntegerType()), T.StructField(CARRY, local)]))
    # one row per task
    done = folded.join(F.broadcast(handed), TASK)
    return done.select(*[F.col(f"`{c}`") for c in df.columns], fold.result().alias(out))


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, tasks: int | None = None) -> DataFrame:
    """Inclusive running sum of a whole-number value in order within each group; a null counts as 0."""
    return scan(df, group, [F.col(c).asc() for c in order], value.cast("bigint"), Sum(), out, tasks)


def ordinal(df: DataFrame, group: list[str], order: list[str], out: str, tasks: int | None = None) -> DataFrame:
    """1-based position in order within each group."""
    return running_total(df, group, order, F.lit(1), out, tasks)


def next_matching(
    df: DataFrame, group: list[str], order: list[str], value: Column, cond: Column, out: str, tasks: int | None = None
) -> DataFrame:
    """``value`` of the first later row of the group that meets ``cond``, and whose value is not null.

    Folds the reversed order, so that what is later has been seen.
    """
    return scan(df, group, [F.col(c).desc() for c in order], F.when(cond, value), Seen(), out, tasks)


def smoothed(df: DataFrame, group: list[str], order: list[str], value: Column, keep: float, out: str, tasks: int | None = None) -> DataFrame:
    """Exponential smoothing in order within each group, starting at the first value. Values are not null."""
    return scan(df, group, [F.col(c).asc() for c in order], value.cast("double"), Smooth(keep), out, tasks)
