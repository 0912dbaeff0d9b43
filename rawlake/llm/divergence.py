"""Audit of how the words of sources differ, from sorted pointers to the starts of words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rawlake.llm.common import stage, text_of
from rawlake.session import attach

# Bytes of text in one shard. A longer text is counted in slices of this size.
SHARD_BYTES = 12 << 20
# Slices of at most so many pointers are sorted by their next word of eight bytes at once.
SMALL = 1 << 14
# Slices of at most so many pointers are sorted together, as each costs a few array calls.
TINY = 2048
# Sources whose distances are computed together, and about how many counts with them.
SOURCES, CELLS = 256, 1 << 14
SCALE, PRIOR = 1_000_000_000, 5
COUNT = "lang string, source string, term string, n bigint, df bigint"
COUNT_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

# Letters are A-Z, a-z and all that is not ASCII, whose bytes all lie above 127.
_BYTES = np.arange(256)
IS_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
IS_LETTER = IS_UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWERED = np.where(IS_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
# The first k of eight bytes.
HEADS = np.array([0, *((0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF for k in range(1, 9))], dtype=np.uint64)


def _runs(cut: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of equal keys, and whether several words go on behind it."""
    at = np.append(0, np.flatnonzero(cut) + 1)
    ends = np.append(at[1:], len(key))
    return at, ends, (key[at] & np.uint64(0xFF) != 0) & (ends - at > 1)


class Pointers:
    """Pointers to the words of several texts that lie end to end in one buffer, and their sort."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, group: np.ndarray):
        """``group`` is a small number per text, in which pointers of equal words will ascend."""
        letter = IS_LETTER[raw]
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[ends] = True
        first[0] = True
        before = np.zeros(len(raw), dtype=bool)
        before[1:] = letter[:-1]
        starts = np.flatnonzero(letter & (first[:-1] | ~before))
        after = np.zeros(len(raw), dtype=bool)
        after[:-1] = letter[1:]
        stops = np.flatnonzero(letter & (first[1:] | ~after)) + 1
        text = np.searchsorted(ends, starts, side="right")
        order = np.argsort(group[text], kind="stable")
        self.start, self.size, self.text = starts[order], (stops - starts)[order], text[order]
        self.group = group[self.text]
        self.buffer = np.concatenate([LOWERED[raw], np.zeros(16, dtype=np.uint8)])
        # eight bytes from any place on, the first as the highest
        self.words = np.ndarray((len(raw) + 8,), dtype=">u8", buffer=self.buffer, strides=(1,))

    def _next(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes of each word from ``depth`` on; zeros follow its end."""
        left = np.minimum(np.maximum(self.size[at] - depth, 0), 8)
        return self.words[np.minimum(self.start[at] + depth, len(self.words) - 1)].astype(np.uint64) & HEADS[left]

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Pointers in the order of their words, and where each run of equal words begins.

        Multikey quicksort: a slice is split by its next eight bytes into less, equal and
        greater; the equal part goes on behind these bytes unless the words end there.
        """
        n = len(self.start)
        order = np.arange(n)
        begins = np.zeros(n, dtype=bool)
        todo = [(0, n, 0)] if n else []
        tiny: dict[int, list[np.ndarray]] = {}
        while todo:
            low, high, depth = todo.pop()
            begins[low] = True
            if high - low <= TINY:
                if high - low > 1:
                    tiny.setdefault(depth, []).append(np.array([[low, high]]))
                continue
            part = order[low:high]
            key = self._next(part, depth)
            if high - low <= SMALL:
                by = np.argsort(key, kind="stable")
                order[low:high], key = part[by], key[by]
                at, ends, goes_on = _runs(key[1:] != key[:-1], key)
                begins[low + at] = True
                few = goes_on & (ends - at <= TINY)
                if few.any():
                    tiny.setdefault(depth + 8, []).append(low + np.stack([at[few], ends[few]], axis=1))
                many = np.flatnonzero(goes_on & ~few)
                todo += [(low + int(at[k]), low + int(ends[k]), depth + 8) for k in many]
                continue
            some = np.sort(key[:: max(1, len(key) // 63)])
            pivot = some[len(some) // 2]
            less, more = key < pivot, key > pivot
            a, c = part[less], part[more]
            b = part[~(less | more)]
            order[low:high] = np.concatenate([a, b, c])
            first, second = low + len(a), low + len(a) + len(b)
            if len(a):
                todo.append((low, first, depth))
            if len(c):
                todo.append((second, high, depth))
            begins[first] = True
            if int(pivot) & 0xFF and len(b) > 1:
                todo.append((first, second, depth + 8))
        # slices of a few pointers, all of one depth at once
        while tiny:
            depth = min(tiny)
            bounds = np.concatenate(tiny.pop(depth))
            sizes = bounds[:, 1] - bounds[:, 0]
            of = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(of)) + np.repeat(bounds[:, 0] - np.append(0, np.cumsum(sizes)[:-1]), sizes)
            part = order[place]
            key = self._next(part, depth)
            by = np.lexsort((key, of))
            order[place], key = part[by], key[by]
            at, ends, goes_on = _runs((key[1:] != key[:-1]) | (of[1:] != of[:-1]), key)
            begins[place[at]] = True
            if goes_on.any():
                tiny[depth + 8] = [*tiny.get(depth + 8, []), np.stack([place[at[goes_on]], place[at[goes_on]] + (ends - at)[goes_on]], axis=1)]
        return order, begins

    def counts(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(word, group, occurrences, texts that hold it), for every word and group."""
        order, begins = self.sort()
        group, text = self.group[order], self.text[order]
        runs = begins | np.append(True, group[1:] != group[:-1])[: len(order)]
        at = np.flatnonzero(runs)
        fresh = runs | np.append(True, text[1:] != text[:-1])[: len(order)]
        texts = np.add.reduceat(fresh.astype(np.int64), at) if len(at) else at
        first = order[at]
        size = self.size[first]
        ends = np.append(0, np.cumsum(size))
        place = np.arange(ends[-1]) + np.repeat(self.start[first] - ends[:-1], size)
        words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.buffer[place])])
        return words, group[at], np.diff(at, append=len(order)), texts


def _emit(groups: list[tuple[str, str]], counted: tuple) -> pa.RecordBatch:
    words, group, n, df = counted
    codes = pa.array(group.astype(np.int32))
    lang, source = (pa.DictionaryArray.from_arrays(codes, pa.array([g[k] for g in groups], pa.string())).cast(pa.string()) for k in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, words, pa.array(n), pa.array(df)], schema=COUNT_ARROW)


def _slices(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text cut at places without a letter, or at a word that fills a slice on its own."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + SHARD_BYTES)
        while end < len(raw) and IS_LETTER[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def shard_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of shards of whole texts, from (lang, source, text)."""

    def rows() -> Iterator[tuple[tuple[str, str], np.ndarray]]:
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                yield (lang, source), np.frombuffer(text.as_buffer(), dtype=np.uint8)

    def flush(held: list[tuple[tuple[str, str], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        groups = sorted({g for g, _ in held})
        number = {g: k for k, g in enumerate(groups)}
        ends = np.cumsum([len(t) for _, t in held])
        group = np.array([number[g] for g, _ in held], dtype=np.uint16 if len(groups) < 1 << 16 else np.int64)
        counted = Pointers(np.concatenate([t for _, t in held]), ends, group).counts()
        if len(counted[0]):
            yield _emit(groups, counted)

    def long(group: tuple[str, str], raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        # slices of one text: their words are one document's
        total: Counter[str] = Counter()
        for piece in _slices(raw):
            words, _, n, _ = Pointers(piece, np.array([len(piece)]), np.zeros(1, dtype=np.uint16)).counts()
            total.update(dict(zip(words.to_pylist(), n.tolist(), strict=True)))
        if total:
            words = list(total)
            yield _emit([group], (pa.array(words), np.zeros(len(words), dtype=np.int32), np.array([total[w] for w in words]), np.ones(len(words), dtype=np.int64)))

    held, size = [], 0
    for group, raw in rows():
        if len(raw) > SHARD_BYTES:
            yield from long(group, raw)
        elif len(raw):
            if size + len(raw) > SHARD_BYTES:
                yield from flush(held)
                held, size = [], 0
            held.append((group, raw))
            size += len(raw)
    if held:
        yield from flush(held)


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and documents that hold the term. Each row is a document."""
    texts = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    shards = texts.mapInArrow(shard_counts, COUNT)
    return shards.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def smoothed(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms))``, exactly."""
    top = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    low = (total + PRIOR * terms).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", top, low)


PAIR = "lang string, source string, item string, value bigint, gap bigint, terms bigint"
PAIR_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("gap", pa.int64()), ("terms", pa.int64())])


def _distances(table: pa.Table) -> pa.Table:
    """Between the sources of two blocks, what a bucket's terms add to their distance.

    Rows without a term name all sources of the blocks, with the share ``p`` that a term has
    there which they lack. ``value`` is the sum over the bucket's terms less as many times
    ``gap``, the difference for a term that both lack; so ``terms * gap`` may be added once.
    """
    columns = {c: table.column(c) for c in ("block", "source", "term", "p", "terms")}
    named = table.filter(columns["term"].is_null())
    held = table.filter(columns["term"].is_valid())
    names = named.column("source").to_pylist()
    number = {x: k for k, x in enumerate(names)}
    absent, block = (np.asarray(named.column(c)) for c in ("p", "block"))
    low, high = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    codes = held.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    of = np.array([number[x] for x in held.column("source").to_pylist()], dtype=np.int64)
    share = np.asarray(held.column("p"))
    order = np.argsort(codes, kind="stable")
    codes, of, share = codes[order], of[order], share[order]
    n = int(codes[-1]) + 1 if len(codes) else 0
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for start in range(0, n, 4096):
        some = slice(*np.searchsorted(codes, [start, start + 4096]))
        dense = np.repeat(absent[:, None], min(4096, n - start), axis=1)
        dense[of[some], codes[some] - start] = share[some]
        others = dense[right]
        for k, x in enumerate(left):
            total[k] += np.abs(others - dense[x]).sum(axis=1)
    gap = np.abs(absent[left][:, None] - absent[right][None, :])
    total -= n * gap
    a, b = (left[:, None] < right[None, :]).nonzero() if low == high else np.ones_like(gap, dtype=bool).nonzero()
    columns = [[names[left[x]] for x in a], [names[right[x]] for x in b], total[a, b], gap[a, b], np.full(len(a), table.column("terms")[0].as_py())]
    lang = pa.array([table.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.Table.from_arrays([lang, *[pa.array(c, f.type) for c, f in zip(columns, list(PAIR_ARROW)[1:], strict=True)]], schema=PAIR_ARROW)


def distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): sum over all kept terms of the difference of two sources, both ways.

    Terms are dealt to buckets of about ``CELLS`` counts and sources to blocks of ``SOURCES``,
    so that a task holds two blocks and one bucket, however many there are of each.
    """
    block = F.expr(f"place div {SOURCES}").cast("int")
    blocks = F.expr(f"(sources + {SOURCES - 1}) div {SOURCES}").cast("int")
    absent = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), "absent", "terms", "place", "sources", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket"))
    held = shares.select("lang", "source", "term", "p", "terms", "place", "sources", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"))
    cells = held.unionByName(absent.withColumnRenamed("absent", "p")).withColumns({"block": block, "blocks": blocks})
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    cells = cells.select("lang", "bucket", "block", "source", "term", "p", "terms", F.inline(others))
    parts = cells.groupBy("lang", "bucket", "i", "j").applyInArrow(_distances, PAIR)
    summed = parts.groupBy("lang", "source", "item").agg((F.sum("value") + F.max("terms") * F.max("gap")).alias("value"))
    ways = F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("source", "item"), ("item", "source"))])
    return summed.select("lang", F.inline(ways), "value")


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = 30,
    top: int = 50,
) -> DataFrame:
    """How far the sources of each language lie apart in their words, and which words mark each.

    Words are runs of letters (A-Z, a-z, all beyond ASCII), A-Z in lower case. A language
    keeps the terms that at least ``least_docs`` of its documents hold; every row is a
    document. The share of a term in a group is ``1 + floor(10^9 (n + 5) / (N + 5 V))``, from
    its occurrences ``n``, those of all kept terms ``N`` and the number ``V`` of kept terms.

    Returns (lang, source, ``part``, ``item``, ``value``, ``rank``). Part ``pair``: every other
    source of the language, with the sum over all its kept terms of the difference of shares
    (0 where none is kept). Part ``term``: the ``top`` kept terms of the source whose share
    lies above that of the language, with the difference. Ranks fall with the value, ties
    ascend by the item's bytes. Null texts, languages and sources count as empty ones; a
    source without terms has pairs; an empty table has no rows. Texts of any length are
    counted whole, in slices of bounded size. Other columns are not read.

    Words are counted through sorted pointers to their starts (:class:`Pointers`), shard by
    shard; only counts are shuffled.
    """
    counts = stage(term_counts(docs, text_col, lang_col, source_col))
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("all_n")).where(F.col("df") >= least_docs)
    kept = stage(kept.drop("df"))
    rows = stage(attach(counts.drop("df"), kept, ["lang", "term"], "inner"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_total"))
    used = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))

    lang, source = text_of(lang_col).alias("lang"), text_of(source_col).alias("source")
    groups = docs.select(lang, source).distinct().join(used, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.na.fill(0, ["total", "cells", "terms", "all_total"])
    of_lang = W.partitionBy("lang")
    groups = groups.withColumns(
        {
            "place": F.row_number().over(of_lang.orderBy("source")) - 1,
            "sources": F.count(F.lit(1)).over(of_lang),
            "buckets": F.expr(f"1 + sum(cells) over (partition by lang) div greatest({CELLS}, 4 * count(*) over (partition by lang))"),
            "absent": F.when(F.col("terms") > 0, smoothed(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0)),
        }
    )
    groups = stage(groups)
    shares = attach(rows, groups.drop("cells", "absent"), ["lang", "source"], "inner", spread=["term"])
    shares = shares.withColumns({"p": smoothed(F.col("n"), F.col("total"), F.col("terms")), "q": smoothed(F.col("all_n"), F.col("all_total"), F.col("terms"))})
    shares = stage(shares)

    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(shares, groups).withColumn("rank", F.row_number().over(ranked))
    marks = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    out = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", pairs), ("term", marks))]
    return out[0].unionByName(out[1])
