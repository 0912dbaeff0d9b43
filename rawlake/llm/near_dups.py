"""MinHash near-dedup with odd sketches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake.llm.common import ascii_lower, hash_pair, stage, text_of, words_of
from rawlake.llm.components import components

# Values of one band; samples that a sketch folds, and its bits.
ROWS, SAMPLES, BITS = 5, 1024, 2048
# A link at the threshold shares no band, or fails the sketch test, less often than this.
MISS = 1e-6
# Documents of one bucket that are compared with each other in one task.
BLOCK = 1024


@dataclass(frozen=True)
class Family:
    """Hash functions for a similarity threshold."""

    threshold: float

    @property
    def bands(self) -> int:
        return ceil(log(MISS) / log(1 - self.threshold**ROWS))

    @property
    def samples(self) -> int:
        return self.bands * ROWS

    def most_bits(self, na, nb, m):
        """The largest population count of two XORed sketches of linked sets of ``na`` and ``nb``.

        Sets of at most ``SAMPLES`` shingles are sampled whole, and of linked ones at most
        ``(1 - t) / (1 + t)`` of all shingles differ. Of larger sets the least ``SAMPLES`` of
        the union are binomial, taken with six standard deviations. A differing sample turns
        one bit. ``m`` has the functions for columns or arrays.
        """
        t = self.threshold
        sampled = 2 * (SAMPLES * (1 - t) + 6 * (SAMPLES * t * (1 - t)) ** 0.5)
        small = (na <= SAMPLES) & (nb <= SAMPLES)
        differ = m.where(small, (na + nb) * ((1 - t) / (1 + t)), sampled)
        odd = (1.0 - m.pow(1 - 2 / BITS, differ)) * (BITS / 2)
        return m.least(differ, odd + m.sqrt(differ) * 6.0) + 1e-6

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(9)
        return rng.integers(0, 1 << 31, self.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, self.samples, dtype=np.uint32)


class OnColumns:
    sqrt, pow = F.sqrt, staticmethod(lambda a, b: F.pow(F.lit(a), b))
    least = F.least
    where = staticmethod(lambda cond, a, b: F.when(cond, a).otherwise(F.lit(b)))


class OnArrays:
    sqrt, pow, least, where = np.sqrt, np.power, np.minimum, np.where


def shingles(text: Column, width: int) -> Column:
    """Distinct hashes of runs of ``width`` words in lower case; of fewer words, of all of them."""
    words = words_of(ascii_lower(text))

    def of(words: Column) -> Column:
        last = F.size(words) - width
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, width))))
        none = F.array().cast("array<bigint>")
        return F.when(last >= 0, many).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none)

    return F.get(F.transform(F.array(words), of), F.lit(0))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits (a finaliser of shifts and odd factors)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signatures(sets: DataFrame, family: Family) -> DataFrame:
    """(r1, r2, id, set) to (r1, r2, id, n, node, bands, sketch): ``node`` identifies the set, null if it is empty."""
    schema = "r1 bigint, r2 bigint, id bigint, n bigint, node bigint, bands array<bigint>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = family.factors()
        k = len(a)
        numbers = np.arange(family.bands, dtype=np.uint64)[:, None]
        for batch in batches:
            lists = batch.column("set")
            values = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
            nodes, bands, sketches, start = [], [], [], 0
            for end in ends:
                h = values[start:end]
                start = end
                if not len(h):
                    nodes.append(None)
                    bands.append(None)
                    sketches.append(None)
                    continue
                nodes.append(int(_mixed(_mixed(h).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))[0].astype(np.int64)))
                spread = np.sort(_mixed(h))
                samples = spread[:SAMPLES]
                # the parity of the samples that fall on a bit
                bits = np.bincount((_mixed(samples) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                sketches.append(np.packbits(bits.astype(np.uint8)).tobytes())
                low = (spread & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                least = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
                for at in range(0, len(low), 2048):
                    np.minimum(least, (a[:, None] * low[None, at : at + 2048] + b[:, None]).min(axis=1), out=least)
                rows = least.astype(np.uint64).reshape(family.bands, ROWS)
                key = numbers[:, 0].copy()
                for c in range(ROWS):
                    key = _mixed(key * np.uint64(0x100000001B3) + rows[:, c] + np.uint64(1))
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("r1"),
                    batch.column("r2"),
                    batch.column("id"),
                    pa.array(np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)),
                    pa.array(nodes, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=["r1", "r2", "id", "n", "node", "bands", "sketch"],
            )

    return sets.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    union = F.size("sa") + F.size("sb") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def _sketch_pairs(family: Family):
    """Pairs of different components of a block whose sketches and sizes allow a link."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        node, comp, n, part = (np.asarray(table.column(c)) for c in ("node", "comp", "n", "part"))
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        first, second = int(np.asarray(table.column("i"))[0]), int(np.asarray(table.column("j"))[0])
        left, right = np.flatnonzero(part == first), np.flatnonzero(part == second)
        found = []
        for at in left:
            other = right[(comp[right] != comp[at]) & ((node[right] > node[at]) if first == second else True)]
            other = other[np.minimum(n[other], n[at]) >= family.threshold * np.maximum(n[other], n[at]) - 1e-9]
            count = np.bitwise_count(bits[other] ^ bits[at]).sum(axis=1)
            most = family.most_bits(n[other].astype(float), float(n[at]), OnArrays)
            found += [(node[at], node[k]) for k in other[count <= most]]
        return pa.Table.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())}, schema=out)

    return run


def linked(nodes: DataFrame, texts: DataFrame, family: Family, width: int, percent: int) -> DataFrame:
    """(node, root): components of distinct sets with the similarity, for nodes that have links.

    Sets that share a band are candidates. First every set of a bucket is compared with the
    bucket's most popular member, and true links give components. Then, in buckets that
    still hold several components, blocks of members are compared across components by
    XOR of their sketches; only pairs that pass are rows. Every link is confirmed on full
    sets, and no pair across components is left out.
    """
    every = nodes.select("node", F.explode("bands").alias("key"))
    sizes = every.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    shared = stage(every.join(sizes, "key"))
    popular = shared.groupBy("node").agg(F.sum("m").alias("pop"))
    members = stage(shared.join(popular, "node"))
    needed = popular.select("node")
    reps = nodes.join(needed, "node", "left_semi").select("node", "r1", "r2")
    row = hash_pair(F.col("id"), F.col("text"))
    keyed = texts.withColumns({"r1": row[0], "r2": row[1]}).join(reps, ["r1", "r2"]).dropDuplicates(["node"])
    sets = stage(keyed.select("node", shingles(F.col("text"), width).alias("set")))

    info = nodes.select("node", "n", "sketch").join(needed, "node", "left_semi")
    info = stage(info)
    leaders = members.groupBy("key").agg(F.max(F.struct("pop", "node")).alias("top"))
    star = members.join(leaders, "key").select(F.col("top.node").alias("a"), F.col("node").alias("b")).where(F.col("a") != F.col("b")).distinct()
    ia, ib = (info.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    star = star.join(ia, "a").join(ib, "b")
    fits = F.least("na", "nb") >= family.threshold * F.greatest("na", "nb") - 1e-9
    star = star.where(fits & (_xor_bits("sa", "sb") <= family.most_bits(F.col("na"), F.col("nb"), OnColumns)))
    edges = stage(confirmed(star, sets, percent))
    roots = stage(components(edges))

    marked = shared.join(roots, "node", "left").select("key", "node", "m", F.coalesce("root", "node").alias("comp"))
    several = marked.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where(F.col("x") != F.col("y"))
    left = marked.join(several.select("key"), "key", "left_semi").join(info, "node")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    left = left.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node"), parts).cast("int")})
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    blocks = left.select("key", "node", "comp", "n", "sketch", "part", F.inline(pairs))
    tried = blocks.groupBy("key", "i", "j").applyInArrow(_sketch_pairs(family), "a bigint, b bigint").distinct()
    more = confirmed(tried, sets, percent)
    return components(edges.unionByName(stage(more)))


def _xor_bits(x: str, y: str) -> Column:
    """Bits that differ between two sketches, by 64-bit words."""

    def word(c: str, k: int) -> Column:
        return F.conv(F.hex(F.substring(F.col(c), 8 * k + 1, 8)), 16, -10).cast("bigint")

    total = F.lit(0)
    for k in range(BITS // 64):
        total += F.bit_count(word(x, k).bitwiseXOR(word(y, k)))
    return total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """The near-duplicate group of every document.

    A document's set has its distinct ``width``-word shingles, A-Z in lower case; with fewer
    words the whole sequence is one; a null or empty text has none and is linked with
    nothing. Documents with ``100 * intersection >= percent * union`` are linked; equal sets
    are one class before any pair is made. Returns (id, ``r1``, ``r2``, ``n_shingles``,
    ``component_id``, ``kept``): the smallest id reachable, and whether it is the row's own.
    Rows that repeat an id with the same text are one document and get the same answer.
    Null ids are linked as others are, but are kept only where a group has no other id.
    """
    family = Family(percent / 100)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    row = hash_pair(F.col("id"), F.col("text"))
    sets = texts.select(row[0].alias("r1"), row[1].alias("r2"), "id", shingles(F.col("text"), width).alias("set"))
    signed = stage(signatures(sets, family))
    some = signed.where(F.col("node").isNotNull())
    # one row per distinct set; its columns but for the first document are equal in all rows
    nodes = some.groupBy("node").agg(
        F.min(F.struct("id", "r1", "r2")).alias("one"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    nodes = stage(nodes.select("node", "least", "one.r1", "one.r2", "n", "bands", "sketch"))
    roots = stage(linked(nodes, texts, family, width, percent))
    owner = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = stage(owner.join(smallest, "root").select("node", "component_id"))
    out = some.select("r1", "r2", "id", "n", "node").join(owner, "node").drop("node")
    alone = signed.where(F.col("node").isNull()).select("r1", "r2", "id", "n", F.col("id").alias("component_id"))
    out = out.select("r1", "r2", "id", "n", "component_id").unionByName(alone)
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.select(F.col("id").alias(id_col), "r1", "r2", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each near-duplicate group, with all columns of ``docs``."""
    found = near_duplicates(docs, id_col, text_col, width, percent).where(~F.col("kept"))
    names = ["__near_row1", "__near_row2"]
    gone = found.select(F.col("r1").alias(names[0]), F.col("r2").alias(names[1])).distinct()
    row = hash_pair(F.col(id_col).cast("bigint"), text_of(text_col))
    return docs.withColumns(dict(zip(names, row, strict=True))).join(gone, names, "left_anti").drop(*names)
