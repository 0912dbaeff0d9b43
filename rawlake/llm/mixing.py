"""LM scoring: online logistic mixing of hashed-context bit predictors, over running text.

A text is its words in lower case, each followed by a blank, and one end mark. It is coded word
by word: the decisions of a prefix code of the most frequent words, the end and an escape are
predicted from the counts of all words, the class of the text (as its language), the word before
and the two words before, mixed by gated weights. Each learner goes through its training texts in
their order, codes a batch and then learns from it; their counts are added up. An escaped word is
coded by its own count and its spelling, letter by letter, by a second mixer of the same kind.
Counts of single words grow with the corpus and are exchanged per block of documents, so that a
frequent word moves once a block; the tables of both mixers are of fixed size.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawlake.llm import repeats
from rawlake.llm.common import UPPER, stage, text_of
from rawlake.llm.repeats import mixed

# Letters before the predicted one that a predictor sees, inside the word.
ORDERS = (1, 2, 3, 5)
SLOT_BITS = 19
PLACES = 4
GATES = 8 * PLACES
STEPS = 24
BATCH_WORDS = 4096
RATE = 0.3
BLOCK_ROWS = 1000
# Documents for one slice of the vocabulary: bounds what a learner holds.
SLICE_DOCS = 8_000
END = b"\n"
RATIOS = 200
# Powers of two of a word's count, whose ratios are kept apart.
LEVELS = 48
# Classes of texts and the rounds that fit them at most.
CLASSES, CLASS_ROUNDS = 8, 8
# Words of the prefix code at most, slots (bits) of each context of running text, tokens coded at a
# time, gates of the weights, parts of a table that are added up apart, documents of a learner.
TOP_WORDS, TEXT_BITS, TEXT_BATCH, TEXT_GATES, TEXT_PARTS, LEARNER_DOCS = (1 << 16) - 2, 21, 16384, 24, 8, 50_000
# Bits of a table for the class and for each hashed context.
TABLES = (16 + (CLASSES - 1).bit_length(), TEXT_BITS, TEXT_BITS)
# Letters of a text that may start a class at least, and groups that such texts are compared in.
SEED_LETTERS, SEED_GROUPS = 100, 64
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[[ord(c) for c in UPPER]] += 32


class Code:
    """A prefix code of letters: the decisions on the way to each, most frequent letters nearest."""

    def __init__(self, counts: np.ndarray):
        heap = [(float(c), k, k) for k, c in enumerate(np.asarray(counts) + 0.01)]
        heapq.heapify(heap)
        tree: list[tuple[int, int]] = []
        while len(heap) > 1:
            (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            tree.append((a, b))
            heapq.heappush(heap, (x + y, 256 + len(tree), 256 + len(tree) - 1))
        paths: dict[int, list[tuple[int, int]]] = {256 + len(tree) - 1: []}
        for k in range(len(tree) - 1, -1, -1):
            for bit, child in enumerate(tree[k]):
                paths[child] = [*paths[256 + k], (k, bit)]
        self.length = np.array([len(paths[k]) for k in range(256)])
        self.nodes = np.zeros((256, self.length.max()), dtype=np.int64)
        self.bits = np.zeros((256, self.length.max()), dtype=bool)
        for k in range(256):
            self.nodes[k, : self.length[k]], self.bits[k, : self.length[k]] = zip(*paths[k], strict=True)


@dataclass
class Events:
    """The decisions of some spellings: slots of every predictor, gate, node, bit and word."""

    slots: list[np.ndarray]
    gate: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    word: np.ndarray


def events(raw: np.ndarray, lengths: np.ndarray, code: Code) -> Events:
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(raw)) - (ends - lengths)[word]
    rolling = repeats.Rolling(raw)
    n = code.length[raw]
    letter = np.repeat(np.arange(len(raw)), n)
    step = np.arange(len(letter)) - np.repeat(np.cumsum(n) - n, n)
    node, bit = code.nodes[raw[letter], step], code.bits[raw[letter], step]
    spread = (node * 0x9E3779B1 >> 7) & ((1 << SLOT_BITS) - 1)
    slots = []
    for k, order in enumerate(ORDERS):
        seen = np.minimum(place, order)
        context = mixed(mixed(rolling.at(np.arange(len(raw)) - seen, seen) + np.uint64(k + 1)) + seen.astype(np.uint64))
        base = (context >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        slots.append(base[letter] ^ spread)
    gate = np.minimum(step, 7) + 8 * np.minimum(place, PLACES - 1)[letter]
    return Events(slots, gate, node, bit, word[letter])


class Model:
    """Counts of every predictor's slots, gated mixing weights and the counts of the refining stage."""

    def __init__(self) -> None:
        self.counts = np.zeros((len(ORDERS), 1 << SLOT_BITS, 2), dtype=np.float32)
        self.weights = np.full((GATES, len(ORDERS)), 0.4, dtype=np.float32)
        self.refined = np.zeros((256 * STEPS, 2), dtype=np.float32)

    def stretch(self, k: int) -> np.ndarray:
        """What predictor ``k`` says at every slot: the log odds of a one."""
        return np.log((self.counts[k, :, 1] + np.float32(0.4)) / (self.counts[k, :, 0] + np.float32(0.4)))

    def stretched(self, e: Events) -> list[np.ndarray]:
        out = []
        for k, s in enumerate(e.slots):
            n = self.counts[k].take(s, axis=0) + np.float32(0.4)
            out.append(np.log(n[:, 1] / n[:, 0]))
        return out

    def mix(self, stretch: list[np.ndarray], e: Events) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mixed, refined cell, final probability of a one)."""
        dot = sum(x * self.weights[:, k].take(e.gate) for k, x in enumerate(stretch))
        dot = np.clip(dot, -12, 12)
        p = 1 / (1 + np.exp(-dot))
        cell = e.node * STEPS + np.clip((dot + 6) * 2, 0, STEPS - 1).astype(np.int64)
        n = self.refined.take(cell, axis=0)
        refined = (n[:, 1] + 16 * p) / (n[:, 0] + n[:, 1] + 16)
        return p, cell, np.clip((p + refined) / 2, 1e-5, 1 - 1e-5)

    def learn(self, e: Events) -> np.ndarray:
        """Code the decisions, then learn from them; log10 probability of each as it was coded."""
        stretch = self.stretched(e)
        p, cell, final = self.mix(stretch, e)
        coded = np.log10(np.where(e.bit, final, 1 - final))
        error = e.bit - p
        n = np.maximum(np.bincount(e.gate, minlength=GATES), 1)
        for k, x in enumerate(stretch):
            self.weights[:, k] += RATE * np.bincount(e.gate, weights=error * x, minlength=GATES) / n
            self.counts[k] += np.bincount(2 * e.slots[k] + e.bit, minlength=2 << SLOT_BITS).reshape(-1, 2)
        self.refined += np.bincount(2 * cell + e.bit, minlength=2 * 256 * STEPS).reshape(-1, 2)
        return coded


def batches_of(raw: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Words in their order, in batches of bounded bytes."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at] - lengths[at]
        to = max(at + 1, min(at + BATCH_WORDS, int(np.searchsorted(ends, base + 64 * BATCH_WORDS))))
        yield slice(at, to), raw[base : ends[to - 1]], lengths[at:to]
        at = to


# --- words of a block ---------------------------------------------------------


def words_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes, start, length, text) of all words."""
    laid = LOWER[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    blank = SPACES[laid]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return laid, start, stop - start, text


def hashes_of(laid: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(start, base + repeats.PART)))
        part = repeats.Rolling(laid[base : start[to - 1] + length[to - 1]])
        out[at:to] = mixed(part.at(start[at:to] - base, length[at:to]) + length[at:to].astype(np.uint64))
        at = to
    return out


END_HASH = mixed(np.full(1, 10, dtype=np.uint64))[0]


def gather(laid: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of some words, end to end."""
    n = np.cumsum(length)
    return laid[np.repeat(start - (n - length), length) + np.arange(n[-1] if len(n) else 0)]


def slice_starts(hashes: np.ndarray, slices: int) -> np.ndarray:
    """Where each slice of the hash space starts in sorted hashes."""
    number = (hashes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    return np.searchsorted(number, np.arange(slices + 1).astype(np.uint64))


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(block, texts, training flags) from rows in block order."""
    now, texts, flags = None, [], []
    for batch in batches:
        for block, text, train in zip(*(batch.column(c) for c in ("block", "text", "train")), strict=True):
            block = block.as_py()
            if block != now and texts:
                yield now, texts, np.array(flags)
                texts, flags = [], []
            now = block
            texts.append(text.as_buffer().to_pybytes())
            flags.append(train.as_py())
    if texts:
        yield now, texts, np.array(flags)


# --- classes of texts ---------------------------------------------------------


def histograms(texts: list[bytes]) -> np.ndarray:
    """Counts of the bytes of each text in lower case, but for white space."""
    out = np.zeros((len(texts), 256))
    for k, t in enumerate(texts):
        out[k] = np.bincount(LOWER[np.frombuffer(t, dtype=np.uint8)], minlength=256)
    out[:, SPACES] = 0
    return out


def letters_of(rows: DataFrame) -> DataFrame:
    """The byte counts of all training texts (256 little-endian 32-bit numbers each), written once, as each round reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                h = histograms([t.as_buffer().to_pybytes() for t in batch.column(0).slice(at, 1000)]).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in h], pa.binary())], names=["h"])

    return stage(rows.where("train").select("text").mapInArrow(run, "h binary"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The byte counts of a thousand texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield np.frombuffer(b"".join(batch.column(0).slice(at, 1000).to_pylist()), "<u4").reshape(-1, 256).astype(float)


def class_sums(rows: DataFrame, logs: np.ndarray) -> np.ndarray:
    """Byte counts of all training texts, from :func:`letters_of`, by the class that fits each best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(logs.shape, dtype=np.int64)
        for h in _counted(batches):
            best = (h @ logs.T).argmax(axis=1)
            for k in np.unique(best):
                sums[k] += h[best == k].sum(axis=0).astype(np.int64)
        of, byte = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(byte, pa.int32()), pa.array(sums[of, byte])], names=["class", "byte", "n"])

    got = rows.mapInArrow(run, "class int, byte int, n bigint")
    out = np.zeros(logs.shape)
    for r in got.groupBy("class", "byte").agg(F.sum("n").alias("n")).collect():
        out[r["class"], r["byte"]] = r["n"]
    return out


def farthest(h: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Texts that lie far from the mean and each other, the farthest first."""
    share = h / h.sum(axis=1, keepdims=True)
    far, picks = ((share - mean) ** 2).sum(axis=1), []
    while len(picks) < min(CLASSES - 1, len(h)) and far.max() > 0:
        picks.append(int(far.argmax()))
        far = np.minimum(far, ((share - share[picks[-1]]) ** 2).sum(axis=1))
    return h[picks]


def seeds(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Texts that lie far from the mean and each other: of each task, then of groups of tasks, then of all."""
    schema = pa.schema([("part", pa.int32()), ("h", pa.binary())])

    def packed(part: int, h: np.ndarray) -> list[pa.Array]:
        return [pa.array([part] * len(h), pa.int32()), pa.array([x.astype("<f8").tobytes() for x in h], pa.binary())]

    def unpacked(column: pa.ChunkedArray) -> np.ndarray:
        return np.array(sorted(np.frombuffer(x, "<f8").tolist() for x in column.to_pylist())).reshape(-1, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 256))
        for h in _counted(batches):
            h = np.concatenate([kept, h[h.sum(axis=1) >= SEED_LETTERS]])
            kept = farthest(h, mean) if len(h) else kept
        yield pa.RecordBatch.from_arrays(packed(TaskContext.get().partitionId() % SEED_GROUPS, kept), schema=schema)

    def again(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        return pa.Table.from_arrays(packed(part, farthest(unpacked(table.column("h")), mean)), schema=schema)

    form = "part int, h binary"
    got = rows.mapInArrow(run, form).groupBy("part").applyInArrow(again, form).toArrow()
    h = unpacked(got.column("h"))
    return farthest(h, mean) if len(h) else h


def fit_classes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Byte distributions (log) of the classes, and byte counts, from all training texts.

    Hard expectation maximisation, started from the mean and texts that lie far from each
    other. A round reads the byte counts of all training texts; the counts by class and byte reach the driver.
    """
    rows = letters_of(rows)
    letters = class_sums(rows, np.zeros((1, 256)))[0]
    if not letters.sum():
        return np.full((1, 256), -np.log(256)), letters
    mean = letters / letters.sum()
    h = seeds(rows, mean)
    centres = np.concatenate([mean[None], h / h.sum(axis=1, keepdims=True)])
    logs, before = np.log(centres * 0.98 + 0.02 / 256), -np.inf
    for _ in range(CLASS_ROUNDS if len(h) else 0):
        sums = class_sums(rows, logs)
        fit = (sums * logs).sum()
        # a round that gains less than a thousandth is the last
        if fit - before < 1e-3 * abs(fit):
            break
        before, sums = fit, sums + 1.0
        logs = np.log(sums / sums.sum(axis=1, keepdims=True))
    letters[32] = letters.sum() / 6  # a blank ends every word
    return logs, letters


def count_words(slices: int, classes: np.ndarray):
    """The distinct words of each block with their training counts, in pieces by slice of their hash."""
    schema = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("at", pa.binary()), ("of", pa.binary()), ("counts", pa.binary()), ("lengths", pa.binary()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts, train in by_block(batches):
            laid, start, length, text = words_in(texts)
            every = np.append(hashes_of(laid, start, length), END_HASH)
            h, first, back = np.unique(every, return_index=True, return_inverse=True)
            # the end mark stands behind the words, as often as there are texts
            of = (histograms(texts) @ classes.T).argmax(axis=1)
            g = len(classes)
            n = np.bincount(back[:-1] * g + of[text], weights=train[text], minlength=len(h) * g).astype("<u4").reshape(-1, g)
            n[back[-1]] += np.bincount(of, weights=train, minlength=g).astype(n.dtype)
            # most words are in one class: (word, class, count) where there is a count
            word, of_class = np.nonzero(n)
            n, of_class = n[word, of_class], of_class.astype(np.uint8)
            start, length = np.append(start, len(laid)), np.append(length, 0)
            laid = np.append(laid, np.frombuffer(b" " + END, dtype=np.uint8))
            lengths = (length[first] + 1).astype(np.uint32)
            raw = gather(laid, start[first], length[first] + 1)
            # behind a word stands some white space, which becomes a blank
            ends = np.cumsum(lengths.astype(np.int64))
            raw[ends - 1] = 32
            raw[ends[back[-1]] - 1] = END[0]
            at = slice_starts(h, slices)
            cut, pair = np.append(0, ends)[at], np.searchsorted(word, at)
            rows = []
            for s in np.flatnonzero(np.diff(at)):
                a, b, p, q, x, y = at[s], at[s + 1], pair[s], pair[s + 1], cut[s], cut[s + 1]
                counted = [(word[p:q] - a).astype("<u4").tobytes(), of_class[p:q].tobytes(), n[p:q].tobytes()]
                rows.append((s, block, h[a:b].tobytes(), *counted, lengths[a:b].tobytes(), raw[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run, "slice int, block bigint, hashes binary, at binary, of binary, counts binary, lengths binary, raw binary"


# --- one slice of the vocabulary ----------------------------------------------

VOCABULARY = (
    "slice int, tokens bigint, words bigint, by_class array<double>, counts binary, lengths binary, raw binary, "
    "blocks array<struct<block: bigint, index: binary>>, tables array<binary>, weights array<double>, ratios array<bigint>, top_hashes array<bigint>, top_counts array<bigint>"
)


def _u(column: pa.ChunkedArray, order: np.ndarray, kind: str) -> np.ndarray:
    """The values of all rows of a binary column, in an order of the rows."""
    return np.concatenate([np.frombuffer(column[int(k)].as_buffer(), dtype=kind) for k in order])


def learn_slice(table: pa.Table, code: Code, classes: int) -> pa.Table:
    """A slice's words with their counts over all blocks, and an online learner's model of their spellings.

    Each training word is coded with what was learned from the words before it, then learned.
    The ratios of that probability to the word's share of all tokens are kept as a histogram by
    the size of its count. These spellings are for words outside the prefix code of running text;
    :func:`learn_text` learns the texts themselves.
    """
    order = np.argsort(np.asarray(table.column("block")), kind="stable")
    hashes = _u(table.column("hashes"), order, "<u8")
    h, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    back = back.astype(np.uint32)
    del hashes
    sizes = [len(table.column("hashes")[int(k)].as_buffer()) // 8 for k in order]
    cuts = np.cumsum([0, *sizes])
    pairs = np.repeat(cuts[:-1], [len(table.column("of")[int(k)].as_buffer()) for k in order])
    word = back[pairs + _u(table.column("at"), order, "<u4")].astype(np.int64)
    cell = word * classes + _u(table.column("of"), order, "u1")
    by_class = np.bincount(cell, weights=_u(table.column("counts"), order, "<u4"), minlength=len(h) * classes).reshape(-1, classes)
    del pairs, word, cell
    counts = by_class.sum(axis=1).astype(np.int64)
    length = _u(table.column("lengths"), order, "<u4").astype(np.int64)
    starts = (np.cumsum(length) - length)[first]
    lengths = length[first]
    raw = gather(_u(table.column("raw"), order, "u1"), starts, lengths)
    model, known = Model(), counts > 0
    spelt = gather(raw, np.cumsum(lengths)[known] - lengths[known], lengths[known])
    logs = np.zeros(int(known.sum()))
    for at, some, n in batches_of(spelt, lengths[known]):
        e = events(some, n, code)
        logs[at] = np.bincount(e.word, weights=model.learn(e), minlength=len(n))
    # a word met once has no share but by the spelling; others have that of their other tokens
    share = np.where(counts[known] > 1, np.log10(np.maximum(counts[known] - 1, 1)), -9)
    ratio = np.clip(np.round((share - logs) * 8) + RATIOS // 4, 0, RATIOS - 1).astype(np.int64)
    level = np.minimum(np.log2(np.maximum(counts[known], 1)).astype(np.int64), LEVELS - 1)
    ratios = np.bincount(level * RATIOS + ratio, weights=counts[known], minlength=LEVELS * RATIOS).astype(np.int64)
    top = np.flatnonzero(counts > 1)
    top = top[np.argsort(-counts[top], kind="stable")[:TOP_WORDS]]
    numbers = table.column("block").to_pylist()
    blocks = [
        {"block": numbers[k], "index": back[x:y].astype("<u4").tobytes()}
        for k, x, y in zip(order, cuts, cuts[1:], strict=False)
    ]
    tables = [zlib.compress(t.astype("<u4").tobytes(), 1) for t in (*model.counts, model.refined)]
    row = {
        "slice": table.column("slice")[0].as_py(),
        "tokens": int(counts.sum()),
        "words": int(known.sum()),
        "by_class": by_class.sum(axis=0).tolist(),
        "counts": counts.astype("<i8").tobytes(),
        "lengths": lengths.astype("<u4").tobytes(),
        "raw": raw.tobytes(),
        "blocks": blocks,
        "tables": tables,
        "weights": model.weights.ravel().astype(float).tolist(),
        "ratios": ratios.tolist(),
        "top_hashes": h[top].astype("<u8").view("<i8").tolist(),
        "top_counts": counts[top].tolist(),
    }
    kinds = {
        "slice": pa.int32(),
        "tokens": pa.int64(),
        "words": pa.int64(),
        "blocks": pa.list_(pa.struct([("block", pa.int64()), ("index", pa.binary())])),
        "tables": pa.list_(pa.binary()),
        "weights": pa.list_(pa.float64()),
        "by_class": pa.list_(pa.float64()),
        "ratios": pa.list_(pa.int64()),
        "top_hashes": pa.list_(pa.int64()),
        "top_counts": pa.list_(pa.int64()),
    }
    return pa.Table.from_pylist([row], schema=pa.schema([(k, kinds.get(k, pa.binary())) for k in row]))


def add_tables(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """Sums of counts by table, from rows in order of (part, pos)."""
    now, total = None, None

    def done():
        return pa.RecordBatch.from_pylist(
            [{"part": now[0], "pos": now[1], "t": zlib.compress(total.tobytes(), 1)}], schema=pa.schema([("part", pa.int32()), ("pos", pa.int32()), ("t", pa.binary())])
        )

    for batch in batches:
        for part, pos, t in zip(*(batch.column(c).to_pylist() for c in ("part", "pos", "t")), strict=True):
            if (part, pos) != now:
                if now is not None:
                    yield done()
                now, total = (part, pos), 0
            total = total + np.frombuffer(zlib.decompress(t), dtype=np.uint32 if first else np.uint64).astype(np.uint64)
    if now is not None:
        yield done()


def merged(vocabulary: DataFrame) -> Model:
    """One model of all slices': counts added up, weights averaged. Its size is fixed."""
    tables = vocabulary.select(F.floor(F.col("slice") / 64).cast("int").alias("part"), F.posexplode("tables").alias("pos", "t"))
    form = "part int, pos int, t binary"
    for last in (False, True):
        tables = tables.withColumn("part", F.lit(0)) if last else tables
        tables = tables.repartition("part", "pos").sortWithinPartitions("part", "pos").mapInArrow(lambda b, first=not last: add_tables(b, first), form)
    model = Model()
    for r in tables.collect():
        t = np.frombuffer(zlib.decompress(r["t"]), dtype=np.uint64).reshape(-1, 2)
        if r["pos"] < len(ORDERS):
            model.counts[r["pos"]] = t
        else:
            model.refined[:] = t
    weights = vocabulary.where(F.col("words") > 0).select("words", F.posexplode("weights").alias("pos", "w"))
    for r in weights.groupBy("pos").agg((F.sum(F.col("w") * F.col("words")) / F.sum("words")).alias("w")).collect():
        model.weights.ravel()[r["pos"]] = r["w"]
    return model


def word_share(vocabulary: DataFrame, least: int, rest: int) -> float:
    """The weight of counts against spellings that fits the escaped training words best (expectation maximisation).

    ``least`` is the count of the rarest word of the prefix code, ``rest`` the number of escaped tokens.
    """
    rows = vocabulary.select(F.posexplode("ratios").alias("k", "n")).where(F.col("k") < RATIOS * max(least - 1, 1).bit_length())
    n = np.zeros(RATIOS)
    for r in rows.groupBy((F.col("k") % RATIOS).alias("k")).agg(F.sum("n").alias("n")).collect():
        n[r["k"]] = r["n"]
    ratio = 10 ** np.clip((np.arange(RATIOS) - RATIOS // 4) / 8 - np.log10(max(rest, 2)), -30, 30)
    share = 0.9
    for _ in range(200):
        mine = share * ratio / (share * ratio + 1 - share)
        share = float(np.clip((n * mine).sum() / max(n.sum(), 1), 0.01, 0.999))
    return share


# --- running text -------------------------------------------------------------


class WordCode:
    """A prefix code of some words, known by their hashes, and an escape for all others, which is number 0."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        weights = [rest + 0.5, *(counts[order] + 0.5).tolist()]
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        leaves = len(weights)
        parent, side, inner = np.zeros(2 * leaves - 1, dtype=np.int64), np.zeros(2 * leaves - 1, dtype=bool), []
        while len(heap) > 1:
            (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
            new = leaves + len(inner)
            parent[[a, b]], side[b] = new, True
            inner.append(np.log(y / x))
            heapq.heappush(heap, (x + y, new))
        root = 2 * leaves - 2
        # what the counts of words say at each node: the log odds of a one
        self.odds = np.array(inner, dtype=np.float32)
        at, steps = np.arange(leaves), []
        while (at != root).any():
            steps.append((np.where(at != root, parent[at] - leaves, -1), side[at]))
            at = np.where(at != root, parent[at], root)
        # by step from the root: the node and the bit of each leaf
        self.length = sum(n >= 0 for n, _ in steps)
        self.nodes, self.bits = np.zeros((len(steps), leaves), dtype=np.int32), np.zeros((len(steps), leaves), dtype=bool)
        leaf = np.arange(leaves)
        for k, (node, bit) in enumerate(steps):
            on = node >= 0
            self.nodes[(self.length - 1 - k)[on], leaf[on]], self.bits[(self.length - 1 - k)[on], leaf[on]] = node[on], bit[on]
        self.spread = (mixed(np.arange(len(inner)).astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)


def word_code(vocabulary: DataFrame, tokens: int) -> tuple[WordCode, int, int]:
    """The prefix code of the most frequent words and the end; the least count of its words, and the tokens it escapes.

    Counts are cut between two sixteenths of a power of two, so that equal counts stay together.
    """
    pairs = vocabulary.select(F.inline(F.arrays_zip("top_hashes", "top_counts")))
    pairs = pairs.withColumn("size", F.floor(16 * F.log2("top_counts")))
    total, cut = 0, None
    sizes = sorted(((r["size"], r["count"]) for r in pairs.groupBy("size").count().collect()), reverse=True)
    for size, n in sizes:
        if total + n > TOP_WORDS:
            break
        total, cut = total + n, size
    rows = pairs.where(F.col("size") >= F.lit(cut).cast("bigint")).select("top_hashes", "top_counts").toArrow()
    hashes = np.asarray(rows.column("top_hashes")).astype(np.int64).view(np.uint64)
    counts = np.asarray(rows.column("top_counts")).astype(np.int64)
    rest = int(tokens - counts.sum())
    least = int(counts.min()) if len(counts) else (1 << LEVELS if sizes else 2)
    if not (hashes == END_HASH).any():
        hashes, counts = np.append(hashes, END_HASH), np.append(counts, 1)
    return WordCode(hashes, counts, rest), least, rest


@dataclass
class Running:
    """Tokens of some texts in their order: number in the prefix code, class and hashes of the other contexts, text, and place among the block's words."""

    number: np.ndarray
    contexts: list[np.ndarray]
    text: np.ndarray
    back: np.ndarray


def running(h: np.ndarray, back: np.ndarray, text: np.ndarray, of: np.ndarray, code: WordCode) -> Running:
    """From a block's distinct words ``h``, the place of each word (and, last, of the end) in it, texts and their classes."""
    n = len(of)
    size = np.bincount(text, minlength=n) + 1
    ends = np.cumsum(size) - 1
    token = np.full(len(text) + n, back[-1])
    token[np.arange(len(text)) + text] = back[:-1]
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(token)) - (ends - size + 1)[owner]
    hashes = h[token]

    def earlier(k: int) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.uint64)
        out[k:] = hashes[: len(hashes) - k]
        out[place < k] = 0
        return out

    one = mixed(earlier(1) + np.uint64(2))
    two = mixed(one * np.uint64(0x9E3779B97F4A7C15) + earlier(2) + np.uint64(3))
    hashed = [(c >> np.uint64(32)).astype(np.uint32) for c in (one, two)]
    return Running(code.number(h)[token], [of[owner], *hashed], owner, token)


class TextModel:
    """Counts of every context's slots and gated mixing weights; ``odds`` instead of counts where nothing more is learned."""

    def __init__(self, code: WordCode, odds: list[np.ndarray] | None = None, weights: np.ndarray | None = None):
        self.code, self.odds = code, odds
        self.counts = [np.zeros(2 << bits, dtype=np.float32) for bits in (TABLES if odds is None else ())]
        self.weights = np.tile(np.array([0.3, 0.5, 0.2, 0.1], dtype=np.float32), (TEXT_GATES, 1)) if weights is None else weights
        self.events = 0

    def code_tokens(self, number: np.ndarray, contexts: list[np.ndarray], learn: bool) -> np.ndarray:
        """log10 probability of each token, or 0 where the decisions are learned: those of a step once all of them were predicted."""
        code, out = self.code, np.zeros(len(number))
        # longest codes first, so that each step is for the first ones; no two steps share a node
        order = np.argsort(-code.length[number], kind="stable")
        number, contexts = number[order], [c[order] for c in contexts]
        shorter = -code.length[number]
        for step in range(-shorter[0] if len(shorter) else 0):
            m = int(np.searchsorted(shorter, -step))
            node, bit = code.nodes[step].take(number[:m]), code.bits[step].take(number[:m])
            spread = code.spread.take(node)
            slots = [(contexts[0][:m] << 16) + node, *[((c[:m] ^ spread) >> np.uint32(32 - TEXT_BITS)).astype(np.int64) for c in contexts[1:]]]
            inputs = [code.odds.take(node)]
            for k, slot in enumerate(slots):
                if self.odds is None:
                    # both counts of a slot are read as one number
                    pair = self.counts[k].view(np.int64).take(slot).view(np.float32).reshape(-1, 2) + np.float32(0.4)
                    inputs.append(np.log(pair[:, 1] / pair[:, 0]))
                else:
                    inputs.append(self.odds[k].take(slot).astype(np.float32))
            weights = self.weights[min(step, TEXT_GATES - 1)]
            dot = np.clip(sum(x * w for x, w in zip(inputs, weights, strict=True)), -12, 12)
            if not learn:
                out[:m] -= np.log(1 + np.exp(np.where(bit, -dot, dot)))
                continue
            p = 1 / (1 + np.exp(-dot))
            error = bit - p
            weights += RATE / max(m, 64) * np.array([x @ error for x in inputs], dtype=np.float32)
            ones = np.ones(m, dtype=np.float32)
            for k, slot in enumerate(slots):
                np.add.at(self.counts[k], 2 * slot + bit, ones)
            self.events += m
        back = np.empty(len(out))
        back[order] = out / np.log(10)
        return back

    def code_text(self, r: Running, learn: bool = False) -> np.ndarray:
        """log10 probability of each token of running text, a batch after the other."""
        out = np.zeros(len(r.number))
        for at in range(0, len(out), TEXT_BATCH):
            some = slice(at, at + TEXT_BATCH)
            out[some] = self.code_tokens(r.number[some], [c[some] for c in r.contexts], learn)
        return out


LEARNED = "part int, pos int, t binary, events bigint, weights array<double>"


def learn_text(code, classes: np.ndarray):
    """An online learner of running text: each batch of a task's texts is coded with what came before it, then learned."""
    schema = pa.schema([("part", pa.int32()), ("pos", pa.int32()), ("t", pa.binary()), ("events", pa.int64()), ("weights", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = TextModel(code.value)
        for _, texts, _ in by_block(batches):
            laid, start, length, text = words_in(texts)
            h, back = np.unique(np.append(hashes_of(laid, start, length), END_HASH), return_inverse=True)
            of = (histograms(texts) @ classes.T).argmax(axis=1)
            model.code_text(running(h, back, text, of, model.code), learn=True)
        if not model.events:
            return
        part = TaskContext.get().partitionId() // 16
        for k, c in enumerate(model.counts):
            for j, t in enumerate(np.split(c, TEXT_PARTS)):
                first = k == j == 0
                row = [part, k * TEXT_PARTS + j, zlib.compress(t.astype("<u4").tobytes(), 1), model.events if first else 0, model.weights.ravel().astype(float).tolist() if first else []]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return run


def text_odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The log odds of a one of every slot, in half precision, from added counts."""
    for batch in batches:
        for pos, t in zip(batch.column("pos").to_pylist(), batch.column("t").to_pylist(), strict=True):
            n = np.frombuffer(zlib.decompress(t), dtype=np.uint64).reshape(-1, 2) + 0.4
            odds = np.log(n[:, 1] / n[:, 0]).astype("<f2")
            yield pa.RecordBatch.from_arrays([pa.array([pos], pa.int32()), pa.array([zlib.compress(odds.tobytes(), 1)], pa.binary())], names=["pos", "t"])


def text_model(rows: DataFrame, n: int, code, classes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(log odds of every context's slots, weights), learned from all training texts by learners whose counts are added up."""
    spark = rows.sparkSession
    learners = max(spark.sparkContext.defaultParallelism, -(-n // LEARNER_DOCS))
    learned = stage(rows.where("train").select("block", "text", "train").coalesce(learners).mapInArrow(learn_text(code, classes), LEARNED))
    tables, form = learned.select("part", "pos", "t"), "part int, pos int, t binary"
    for last in (False, True):
        tables = tables.withColumn("part", F.lit(0)) if last else tables
        tables = tables.repartition("part", "pos").sortWithinPartitions("part", "pos").mapInArrow(lambda b, first=not last: add_tables(b, first), form)
    odds = [np.zeros(1 << bits, dtype="<f2") for bits in TABLES]
    for r in tables.select("pos", "t").mapInArrow(text_odds, "pos int, t binary").collect():
        k, j = divmod(r["pos"], TEXT_PARTS)
        np.split(odds[k], TEXT_PARTS)[j][:] = np.frombuffer(zlib.decompress(r["t"]), "<f2")
    model = learned.where(F.col("events") > 0).select("events", F.posexplode("weights").alias("pos", "w"))
    weights = TextModel(code.value, odds).weights
    for r in model.groupBy("pos").agg((F.sum(F.col("w") * F.col("events")) / F.sum("events")).alias("w")).collect():
        weights.ravel()[r["pos"]] = r["w"]
    return odds, weights


def spell_words(model, code: Code):
    """(block, slice, counts, logs) for every block's words of a slice, in order of their hash."""
    schema = pa.schema([("block", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary()), ("logs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        stretch = [m.stretch(k) for k in range(len(ORDERS))]
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<i8")
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                logs = np.zeros(len(counts), dtype=np.float64)
                for at, some, n in batches_of(np.frombuffer(row["raw"], np.uint8), lengths):
                    e = events(some, n, code)
                    p = m.mix([stretch[k].take(s) for k, s in enumerate(e.slots)], e)[2]
                    logs[at] = np.bincount(e.word, weights=np.log10(np.where(e.bit, p, 1 - p)), minlength=len(n))
                for b in row["blocks"]:
                    index = np.frombuffer(b["index"], "<u4")
                    out = [b["block"], row["slice"], counts[index].tobytes(), logs[index].astype("<f4").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return run, "block bigint, slice int, counts binary, logs binary"


def score_block(tokens: int, words: int, share: float, rest: int, by_class: np.ndarray, model, classes: np.ndarray):
    """Scores of each text of a block, from its running text and its words' counts and spellings.

    A text's probability is that of its class (the class's share of the training tokens) times
    that of its tokens in it.
    """
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_bytes", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(replies.column("slice")))
        counts = _u(replies.column("counts"), order, "<i8")
        logs = _u(replies.column("logs"), order, "<f4").astype(np.float64)
        texts = [t.as_buffer().to_pybytes() for t in docs.column("text").combine_chunks()]
        laid, start, length, text = words_in(texts)
        every = np.append(hashes_of(laid, start, length), END_HASH)
        h, back = np.unique(every, return_inverse=True)
        if len(h) != len(counts):
            raise ValueError("the documents changed between two readings")
        base = np.log10((counts + 0.5) / (tokens + 0.5 * (words + 1)))

        def total(value: np.ndarray) -> np.ndarray:
            return np.bincount(text, weights=value[back[:-1]], minlength=len(texts)) + value[back[-1]]

        of = (histograms(texts) @ classes.T).argmax(axis=1)
        coder = TextModel(model.value[0], *model.value[1:])
        r = running(h, back, text, of, coder.code)
        coded = coder.code_text(r)
        # a word outside the prefix code: by its count among such words, and its spelling
        counted = share * counts / rest if rest else 0.0 * counts
        spelt = np.log10(counted + (1 - share if rest else 1.0) * 10.0 ** np.maximum(logs, -300))
        coded += np.where(r.number == 0, spelt[r.back], 0.0)
        of_class = np.log10((by_class + 1) / (by_class + 1).sum())
        sums = {
            "n_known": total((counts > 0).astype(float)),
            "base_score": total(base),
            "score": of_class[of] + np.bincount(r.text, weights=coded, minlength=len(texts)),
        }
        n = np.bincount(text, minlength=len(texts)) + 1
        columns = [
            docs.column("id"),
            pa.array(~np.asarray(docs.column("train"))),
            pa.array(n),
            pa.array(np.round(sums["n_known"]).astype(np.int64)),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(sums["base_score"]),
            pa.array(sums["score"]),
        ]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    return run, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, n_bytes bigint, base_score double, score double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """log10 probabilities of all texts, learned from the documents that are not held out.

    A document is held out if crc32 of its id as text leaves ``held_out`` modulo ``folds``;
    a null id counts as an empty text. Tokens are the words in lower case and one end.
    ``base_score`` is that of smoothed word counts. ``score`` is that of the mixers
    of running text and of spellings, so that words never seen in training have a probability too;
    ``bits_per_byte`` is its cost by UTF-8 byte of the text (null without bytes). A null
    text is empty and has the end only. Repeated rows and ids are rows of their own.

    ``docs`` is read several times and must give the same rows in the same partitions, as a scan of
    files does; if it does not, the job fails. Other columns are not carried.
    """
    spark = docs.sparkSession
    remainder = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))
    number = F.monotonically_increasing_id()
    block = F.shiftright(number, 33) * (1 << 33) + F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK_ROWS)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"), (remainder != held_out).alias("train"), block.cast("bigint").alias("block"))
    n = docs.count()
    slices = max(16, -(-n // SLICE_DOCS))
    classes, letters = fit_classes(rows)
    code = Code(letters)
    run, form = count_words(slices, classes)
    pieces = rows.select("block", "text", "train").mapInArrow(run, form)
    many = len(classes)
    vocabulary = stage(pieces.groupBy("slice").applyInArrow(lambda t: learn_slice(t, code, many), VOCABULARY))
    total = vocabulary.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    tokens, words = total["n"] or 0, total["v"] or 0
    model = spark.sparkContext.broadcast(merged(vocabulary))
    run, form = spell_words(model, code)
    replies = vocabulary.select("slice", "counts", "lengths", "raw", "blocks").mapInArrow(run, form)
    sums = vocabulary.select(F.posexplode("by_class").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    by_class = np.zeros(many)
    for r in sums:
        by_class[r["k"]] = r["n"]
    word, least, rest = word_code(vocabulary, tokens)
    text = text_model(rows, n, spark.sparkContext.broadcast(word), classes)
    whole = spark.sparkContext.broadcast((word, *text))
    run, form = score_block(tokens, words, word_share(vocabulary, least, rest), rest, by_class, whole, classes)
    out = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, form)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / np.log10(2.0) / F.col("n_bytes")).alias("bits_per_byte")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score", bits)
