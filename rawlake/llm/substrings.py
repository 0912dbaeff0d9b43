"""Substring dedup over words: a count-min prefilter, then exact grouping of windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawlake.llm import repeats
from rawlake.llm.common import SPACE, hash_pair, stage, text_of, words_of

# A document without an id is before every other.
FIRST = -(1 << 63)
BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def split(text: str) -> list[str]:
    bare = text.strip(SPACE)
    return BLANKS.split(bare) if bare else []


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Word hashes of each text, from (doc, row, hashes)."""
    for batch in batches:
        lists = batch.column("hashes")
        values = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
        ends = np.cumsum(np.asarray(lists.value_lengths()))
        starts = ends - np.asarray(lists.value_lengths())
        for doc, row, a, b in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), starts, ends, strict=True):
            yield (doc, row), values[a:b]


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc, row, first, h) of the listed windows of each text."""
    for batch in batches:
        for (key, units), firsts, ns in zip(_units([batch]), batch.column("firsts").to_pylist(), batch.column("ns").to_pylist(), strict=True):
            n = np.array(ns, dtype=np.int64)
            start = np.repeat(np.array(firsts, dtype=np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for at in range(0, len(units), repeats.PART):
                some = start[(start >= at) & (start < at + repeats.PART)]
                if not len(some):
                    continue
                h = repeats.mixed(repeats.Rolling(units[at : at + repeats.PART + width]).at(some - at, width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), key[0])), pa.array(np.full(len(some), key[1])), pa.array(some), pa.array(h.view(np.int64))],
                    names=["doc", "row", "first", "h"],
                )


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, text, firsts, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split(text)
                mask = repeats.covered(len(words), np.array(firsts or [], dtype=np.int64), np.array(ns or [], dtype=np.int64), width)
                kept = [w for w, m in zip(words, mask, strict=True) if not m] if firsts else words
                rows.append((ident, " ".join(kept), len(words), len(words) - len(kept)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "kept", "n_words", "n_removed"])

    return run


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 25, depth: int = 3, bits: int = 25
) -> DataFrame:
    """Texts without the words that lie in a ``width``-word window of a document with a smaller id.

    First pass: every task counts anchors of windows in a count-min sketch of ``depth`` rows
    of ``2 ** bits`` counters; the merged sketch overestimates how many documents have a
    window. Its size is fixed, so a fuller sketch lets more through, but never drops a
    repeated window. Second pass: only windows estimated repeated are grouped, exactly: by
    128-bit hashes of stretches, and where these differ, window by window.

    Windows are judged on the input. Returns (id, ``text`` of the kept words joined by one
    blank, ``n_words``, ``n_removed``). A null text has no words. Rows with equal ids do not
    remove each other's words; a null id is below every other. Other columns are not carried.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    texts = texts.withColumns({"doc": F.coalesce("id", F.lit(FIRST)), "row": hash_pair(F.col("text"))[0]})
    hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")
    units = texts.select("doc", "row", hashes).where(F.size("hashes") >= width)
    found = repeats.staged_stretches(units, _units, width, gram, depth, bits)

    look = repeats.ranges(found.where(~F.col("gone")))
    again = texts.join(look, repeats.KEY).select("doc", "row", hashes, "firsts", "ns")
    windows = stage(again.mapInArrow(lambda b: _windows(b, width), "doc bigint, row bigint, first bigint, h bigint"))
    drop = repeats.ranges(repeats.later(windows), found.where("gone"))
    out = texts.join(drop, repeats.KEY, "left").select("id", "text", "firsts", "ns")
    out = out.mapInArrow(_kept(width), "id bigint, kept string, n_words bigint, n_removed bigint")
    return out.select(F.col("id").alias(id_col), F.col("kept").alias("text"), "n_words", "n_removed")
