"""Suffix-array dedup over bytes: induced sorting of shards and permuted common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawlake.llm import repeats
from rawlake.llm.common import hash_pair, stage, text_of
from rawlake.llm.substrings import FIRST

# Bytes of stretches in one suffix array, and stretches of one anchor that stay together.
SHARD_BYTES = 400_000
TOGETHER = 10_000
# Above this many names the reduced text is sorted by doubling, as buckets would be nearly empty.
BUCKETS = 1024


def types_of(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), from right to left over equal letters."""
    step = np.sign(np.diff(s.astype(np.int64), append=s[-1] + 1))
    places = np.where(step != 0, np.arange(len(s)), len(s))
    return step[np.minimum.accumulate(places[::-1])[::-1]] > 0


def _deal(sa: np.ndarray, letters: np.ndarray, entries: np.ndarray, at: np.ndarray, step: int) -> None:
    """Append entries, in order, to the free ends of their letters' buckets."""
    # sixteen bits are sorted by counting
    order = np.argsort(letters.astype(np.uint16), kind="stable")
    sorted_letters = letters[order]
    heads = np.flatnonzero(np.diff(sorted_letters, prepend=-1))
    counts = np.diff(heads, append=len(order))
    rank = np.arange(len(order)) - np.repeat(heads, counts)
    sa[at[sorted_letters] + step * rank] = entries[order]
    at[sorted_letters[heads]] += step * counts


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, buckets: int) -> np.ndarray:
    """All suffixes from the order of the leftmost smaller ones: larger types left to right, smaller ones back.

    A bucket is taken in as many steps as its letter repeats in a row, each over whole arrays.
    """
    n = len(s)
    sizes = np.bincount(s, minlength=buckets)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(n, -1, dtype=np.int64)
    own = np.bincount(s[lms], minlength=buckets)
    _deal(sa, s[lms], lms, ends - own, 1)

    free = heads.copy()

    def larger(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[~small[before]]
        if len(before):
            _deal(sa, s[before], before, free, 1)

    used = np.flatnonzero(sizes)
    for c in used:
        at = heads[c]
        while at < free[c]:
            now, at = sa[at : free[c]], free[c]
            larger(now)
        if own[c]:
            larger(sa[ends[c] - own[c] : ends[c]])

    last = ends - 1

    def smaller(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[small[before]]
        if len(before):
            _deal(sa, s[before], before, last, -1)

    # the end mark is the smallest suffix and has no letter before it to wait for
    sa[0] = n - 1
    last[s[n - 1]] -= 1
    for c in used[::-1]:
        at = ends[c] - 1
        while at > last[c]:
            now, at = sa[last[c] + 1 : at + 1][::-1], last[c]
            smaller(now)
        smaller(sa[heads[c] : free[c]][::-1])
    return sa


def doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text of names, by pairs of ranks of twice the length each round."""
    rank, step = names.astype(np.int64), 1
    while True:
        second = np.zeros(len(rank), dtype=np.int64)
        second[:-step] = rank[step:] + 1
        key = rank * (len(rank) + 2) + second
        order = np.argsort(key)
        fresh = np.cumsum(np.diff(key[order], prepend=-1) != 0) - 1
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] + 1 == len(rank) or step >= len(rank):
            return order


def suffix_array(s: np.ndarray, buckets: int) -> np.ndarray:
    """Suffix array of a text that ends with its only 0, by induced sorting."""
    if len(s) == 1:
        return np.zeros(1, dtype=np.int64)
    small = types_of(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return induce(s, small, lms, buckets)
    first = induce(s, small, lms, buckets)
    is_lms = np.zeros(len(s), dtype=bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    # names of the substrings between leftmost smaller suffixes, equal if length and hash are
    length = np.zeros(len(s), dtype=np.int64)
    length[lms] = np.diff(lms, append=len(s) - 1) + 1
    h = repeats.Rolling(repeats.mixed(s.astype(np.uint64) + np.uint64(1))).at(order, length[order])
    new = np.ones(len(order), dtype=bool)
    new[1:] = (length[order][1:] != length[order][:-1]) | (h[1:] != h[:-1])
    name = np.zeros(len(s), dtype=np.int64)
    name[order] = np.cumsum(new) - 1
    reduced = name[lms]
    names = int(new.sum())
    if names < len(lms):
        ranked = suffix_array(reduced, names) if names <= BUCKETS else doubled(reduced)
        order = lms[ranked]
    return induce(s, small, order, buckets)


def permuted_prefixes(rolling: repeats.Rolling, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in text order: place, and common prefix with the one before it in ``order``, at most ``most``.

    Each suffix has at least ``most`` bytes. Lengths are found by halving over hashes of prefixes.
    """
    before = np.full(int(order.max(initial=-1)) + 1, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    places = np.sort(order[1:])
    low, high = np.zeros(len(places), dtype=np.int64), np.full(len(places), most, dtype=np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = rolling.at(places, middle) == rolling.at(before[places], middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return places, low


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """The UTF-8 bytes of each text, from (doc, row, text)."""
    for batch in batches:
        for doc, row, text in zip(*(batch.column(c) for c in ("doc", "row", "text")), strict=True):
            yield (doc.as_py(), row.as_py()), np.frombuffer(text.as_buffer(), dtype=np.uint8)


def _cut(width: int):
    """The bytes of the listed stretches of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("held")
            held = lists.flatten()
            first, n = (np.asarray(held.field(c)).astype(np.int64) for c in ("first", "n"))
            sizes = np.asarray(lists.value_lengths())
            pieces, at = [], 0
            for text, size in zip(batch.column("text"), sizes, strict=True):
                raw = text.as_buffer().to_pybytes()
                pieces += [raw[a : a + k + width - 1] for a, k in zip(first[at : at + size].tolist(), n[at : at + size].tolist(), strict=True)]
                at += size
            repeated = [pa.array(np.repeat(np.asarray(batch.column(c)), sizes)) for c in ("doc", "row")]
            columns = [*repeated, pa.array(first), held.field("anchor"), held.field("kinds"), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "first", "anchor", "kinds", "bytes"])

    return run


def _shard(width: int, together: int):
    """Sort a shard's stretches and give the windows that a smaller document has here, as ranges.

    Windows of anchors that are spread over shards come back one by one with their hash, for
    the last comparison, if no smaller document in this shard has them.
    """
    out = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("gone", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        doc, row, first, kinds = (np.asarray(table.column(c)) for c in ("doc", "row", "first", "kinds"))
        pieces = table.column("bytes").to_pylist()
        ends = np.cumsum([len(p) for p in pieces])
        lengths = np.diff(ends, prepend=0)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sa = suffix_array(np.append(raw.astype(np.int64) + 1, 0), 257)[1:]
        of = np.repeat(np.arange(len(pieces)), lengths)
        rolling = repeats.Rolling(raw)
        whole = sa[(ends[of] - np.arange(len(raw)))[sa] >= width]
        places, common = permuted_prefixes(rolling, whole, width)
        prefix = np.zeros(len(raw), dtype=np.int64)
        prefix[places] = common
        # strings that are equal stand side by side
        starts = np.flatnonzero(prefix[whole] < width)
        least = np.repeat(np.minimum.reduceat(doc[of[whole]], starts), np.diff(starts, append=len(whole)))
        gone = np.zeros(len(raw) + 1, dtype=np.int8)
        gone[whole[doc[of[whole]] > least]] = 1
        # pieces end without a window, so a range stays inside one
        begin, end = np.flatnonzero(np.diff(gone, prepend=0) == 1), np.flatnonzero(np.diff(gone, prepend=0) == -1)
        open_ = whole[(gone[whole] == 0) & (kinds[of[whole]] >= together)]
        at = np.concatenate([begin, open_])
        piece = of[at]
        n = np.concatenate([end - begin, np.ones(len(open_), dtype=np.int64)])
        h = np.concatenate([np.zeros(len(begin), dtype=np.int64), repeats.mixed(rolling.at(open_, width)).view(np.int64)])
        columns = [doc[piece], row[piece], first[piece] + at - (ends - lengths)[piece], n, h, np.arange(len(at)) < len(begin)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=out)

    return run


KEPT = "id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
KEPT_ARROW = pa.schema([("id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that lose nothing."""
    for batch in batches:
        kept = batch.column("text").cast(pa.binary())
        none = pa.array(np.zeros(batch.num_rows, dtype=np.int64))
        sizes = pc.binary_length(kept).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), kept, sizes, none, none], schema=KEPT_ARROW)


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, text, firsts, ns in zip(*batch.columns, strict=True):
                raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                if not firsts.is_valid:
                    rows.append((ident.as_py(), raw.tobytes(), len(raw), 0, 0))
                    continue
                first, n = (x.values.to_numpy() for x in (firsts, ns))
                mask = repeats.covered(len(raw), first, n, width)
                spans = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
                rows.append((ident.as_py(), raw[~mask].tobytes(), len(raw), int(mask.sum()), spans))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), KEPT_ARROW, strict=True)], schema=KEPT_ARROW)

    return run


def dedup_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 50,
    gram: int = 20,
    depth: int = 1,
    bits: int = 29,
    chunk: int = 256,
) -> DataFrame:
    """Texts without the bytes that lie in a ``width``-byte string of a document with a smaller id.

    Chunks of about ``chunk`` windows that a smaller document has go first. A prefilter finds the stretches of text around anchors that two documents share; those
    that a smaller document has as a whole go at once. The others, at the ends of repeats,
    are cut out and dealt to shards of bounded size. Each shard's suffix array is built by
    induced sorting, and permuted common prefixes of ``width`` bytes give the equal strings.

    Strings are judged on the input. Returns (id, ``kept`` bytes, ``n_bytes``, ``n_removed``,
    ``n_spans``). A null text is empty. Rows with equal ids do not remove each other's bytes;
    a null id is below every other. Other columns are not carried.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    texts = texts.withColumns({"doc": F.coalesce("id", F.lit(FIRST)), "row": hash_pair(F.col("text"))[0]})
    units = texts.where(F.octet_length("text") >= width).select("doc", "row", "text")
    found = repeats.staged_stretches(units, _units, width, gram, depth, bits, chunk)

    look = found.where(~F.col("gone"))
    size = look.agg(F.sum(F.col("n") + width - 1).alias("b")).first()["b"] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    held = look.groupBy(*repeats.KEY).agg(F.collect_list(F.struct("first", "n", "anchor", "kinds")).alias("held"))
    cut = texts.join(held, repeats.KEY).dropDuplicates(repeats.KEY).select("doc", "row", "text", "held")
    cut = cut.mapInArrow(_cut(width), "doc bigint, row bigint, first bigint, anchor bigint, kinds bigint, bytes binary")
    # an anchor with very many different stretches is dealt over several shards
    salt = F.pmod(F.xxhash64("doc", "first"), F.floor(F.col("kinds") / TOGETHER) + 1)
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("anchor", salt), F.lit(shards)))
    sorted_ = cut.groupBy("shard").applyInArrow(_shard(width, TOGETHER), "doc bigint, row bigint, first bigint, n bigint, h bigint, gone boolean")
    sorted_ = stage(sorted_)
    spread = repeats.later(sorted_.where(~F.col("gone")).select(*repeats.KEY, "first", "h"))
    drop = repeats.ranges(sorted_.where("gone"), spread, found.where("gone"))
    drop = stage(drop)
    # only texts that may lose something are shuffled
    touched = repeats.Bits(drop, *repeats.KEY)
    some = texts.mapInArrow(lambda b: repeats.among(b, touched, True), texts.schema)
    some = some.join(drop, repeats.KEY, "left").select("id", "text", "firsts", "ns").mapInArrow(_kept(width), KEPT)
    out = some.unionByName(texts.mapInArrow(lambda b: _whole(repeats.among(b, touched, False)), KEPT))
    return out.withColumnRenamed("id", id_col)
