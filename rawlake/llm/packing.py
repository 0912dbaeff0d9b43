"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rawlake.llm.common import stage, text_of
from rawlake.llm.tokens import encoder

# Items of one block: what one island packs. Bounds its memory.
BLOCK_ITEMS = 50_000


@dataclass(frozen=True)
class Plan:
    """Parameters of the search. Epochs go on until one leaves a block with as many bins as before."""

    islands: int = 4
    population: int = 6
    generations: int = 24
    full: float = 0.97


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, longest first, each into the fullest bin that has room.

    The room left in bins is one whole number with a bit for every size, so that the
    tightest room is its lowest bit at or above the length.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, b in enumerate(bins):
        room = capacity - sum(lengths[i] for i in b)
        rooms[room].append(k)
        mask |= 1 << room
    for i in sorted(items, key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        rooms[room - n].append(k)
        mask |= 1 << (room - n)
    return bins


class Lengths:
    """Items by length; which lengths are left is one whole number with a bit for each, and its mirror."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity = capacity
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i, n in enumerate(lengths):
            self.held[n].append(i)
        self.mask = sum(1 << n for n, h in enumerate(self.held) if h)
        self.mirror = sum(1 << (capacity - n) for n, h in enumerate(self.held) if h)

    def take(self, n: int) -> int:
        item = self.held[n].pop()
        if not self.held[n]:
            self.mask ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)
        return item

    def pair(self, room: int) -> int:
        """The larger of two lengths left that sum to ``room``, or 0."""
        half = (room + 1) // 2
        both = ((self.mask & (self.mirror >> (self.capacity - room)) & ((1 << room) - 1)) >> half) << half
        while both:
            a = both.bit_length() - 1
            if 2 * a != room or len(self.held[a]) > 1:
                return a
            both ^= 1 << a
        return 0


def exact_fill(lengths: list[int], capacity: int, tries: int) -> list[list[int]]:
    """Bins from the longest item down, each filled up exactly by one, two or three others if these are left.

    ``tries`` bounds the first items of a triple that are tried.
    """
    left, bins = Lengths(lengths, capacity), []
    while left.mask:
        n = left.mask.bit_length() - 1
        b, room = [left.take(n)], capacity - n
        while room:
            low = left.mask & ((1 << (room + 1)) - 1)
            if not low:
                break
            if low >> room & 1:
                b.append(left.take(room))
                break
            if a := left.pair(room):
                b += [left.take(a), left.take(room - a)]
                break
            rest = low
            for _ in range(tries):
                c = rest.bit_length() - 1
                if c < 1:
                    break
                rest ^= 1 << c
                a = left.pair(room - c) if room - c > 1 else 0
                if a and (c not in (a, room - c - a) or len(left.held[c]) > 2):
                    b += [left.take(c), left.take(a), left.take(room - c - a)]
                    room = 0
                    break
            if room:
                n = low.bit_length() - 1
                b.append(left.take(n))
                room -= n
        bins.append(b)
    return bins


def flat_of(bins: list[list[int]], n: int) -> np.ndarray:
    """The bin of every item."""
    out = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def fills(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(flat, weights=lengths).astype(np.int64)


def worth(flat: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then uneven filling, which leaves whole bins easier to empty."""
    fill = fills(flat, lengths) / capacity
    return -len(fill), float((fill * fill).sum())


def repack(flat: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Pack the ``loose`` items again: filled exactly as far as that goes, the others best fit into the room of all bins."""
    items = np.flatnonzero(loose)
    rest = ~loose
    used = np.bincount(flat[rest], minlength=1) > 0
    out = (np.cumsum(used) - 1).astype(np.int32)[np.where(rest, flat, 0)]
    fill = np.bincount(out[rest], weights=lengths[rest], minlength=int(used.sum())).astype(np.int64).tolist()
    some = lengths[items].tolist()
    spare = []
    for b in exact_fill(some, capacity, rng.randrange(8, 40)):
        total = sum(some[i] for i in b)
        if total == capacity:
            out[items[b]] = len(fill)
            fill.append(total)
        else:
            spare.append((total, b))
    # a bin that is not full is put away whole where it fits, else it stays a bin with room
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, total in enumerate(fill):
        rooms[capacity - total].append(k)
        mask |= 1 << (capacity - total)
    for total, b in sorted(spare, key=lambda x: -x[0]):
        for part in [b] if mask >> total else [[i] for i in sorted(b, key=lambda i: -some[i])]:
            n = sum(some[i] for i in part)
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                k = rooms[room].pop()
                if not rooms[room]:
                    mask &= ~(1 << room)
            else:
                room, k = capacity, len(fill)
                fill.append(0)
            out[items[part]] = k
            rooms[room - n].append(k)
            mask |= 1 << (room - n)
    return out


def cross(first: np.ndarray, second: np.ndarray, lengths: np.ndarray, capacity: int, full: float, rng: random.Random) -> np.ndarray:
    """A child: whole well-filled bins of ``second`` go into ``first``.

    Bins of ``first`` that share an item with them are dissolved, and what they displaced is
    packed again.
    """
    draw = np.random.default_rng(rng.getrandbits(64))
    good = fills(second, lengths) >= full * capacity
    injected = (good & (draw.random(len(good)) < rng.uniform(0.01, 0.2)))[second]
    dissolved = np.zeros(int(first.max()) + 1, dtype=bool)
    dissolved[first[injected]] = True
    out = np.where(injected, second + len(dissolved), first)
    return repack(out, dissolved[first] & ~injected, lengths, capacity, rng)


def mutate(flat: np.ndarray, lengths: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Empty the worst-filled bins and a few others and pack their items again."""
    fill = fills(flat, lengths)
    out = np.zeros(len(fill), dtype=bool)
    out[np.argsort(fill, kind="stable")[: max(1, len(fill) // 50)]] = True
    out[[rng.randrange(len(fill)) for _ in range(max(1, len(fill) // 20))]] = True
    return repack(flat, out[flat], lengths, capacity, rng)


def evolve(sizes: list[int], population: list[np.ndarray], capacity: int, plan: Plan, seed: int) -> list[np.ndarray]:
    """Some generations on one island; ends at once when the lower bound is reached."""
    rng = random.Random(seed)
    lengths = np.array(sizes, dtype=np.int64)
    least = -(-sum(sizes) // capacity)
    held = [(worth(p, lengths, capacity), p) for p in population]
    while len(held) < plan.population and not (held and -held[-1][0][0] <= least):
        if (seed + len(held)) % 2:
            bins = exact_fill(sizes, capacity, rng.randrange(8, 40))
        else:
            order = sorted(range(len(sizes)), key=lambda i: -sizes[i] + (rng.random() - 0.5) * 30)
            half = best_fit(sizes, order[: len(order) // 2], [], capacity)
            bins = best_fit(sizes, order[len(order) // 2 :], half, capacity)
        p = flat_of(bins, len(sizes))
        held.append((worth(p, lengths, capacity), p))
    held.sort(key=lambda x: x[0], reverse=True)
    for _ in range(plan.generations):
        if -held[0][0][0] <= least:
            break
        (_, a), (_, b) = rng.sample(held, 2) if len(held) > 1 else (held[0], held[0])
        child = mutate(cross(a, b, lengths, capacity, plan.full, rng), lengths, capacity, rng)
        held = sorted([*held, (worth(child, lengths, capacity), child)], key=lambda x: x[0], reverse=True)[: plan.population]
    return [p for _, p in held]


STATE = "block bigint, island int, lengths array<int>, population array<array<int>>, best int, before int"
STATE_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("island", pa.int32()),
        ("lengths", pa.list_(pa.int32())),
        ("population", pa.list_(pa.list_(pa.int32()))),
        ("best", pa.int32()),
        ("before", pa.int32()),
    ]
)


def _island_task(capacity: int, plan: Plan, epoch: int):
    """Evolves each (block, island) row whose block is open; a row is a block's item lengths and a few packings of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row.pop("open"):
                    held = [np.array(p, dtype=np.int32) for p in row["population"] or []]
                    seed = (epoch << 48) + row["block"] * plan.islands + row["island"]
                    got = evolve(row["lengths"], held, capacity, plan, seed)
                    row |= {"population": [p.tolist() for p in got], "best": int(got[0].max()) + 1}
                yield pa.RecordBatch.from_pylist([row], schema=STATE_ARROW)

    return run


def pack_blocks(items: DataFrame, n_items: int, capacity: int, plan: Plan, number: int) -> tuple[DataFrame, int]:
    """Pack (item, n) in blocks of about ``BLOCK_ITEMS``: (item, n, block, bin), and the number of blocks.

    All islands of a block pack the same items. After an epoch each island gets the elite of
    its neighbour, for its next crossovers. A block is closed at its lower bound, or when an
    epoch has left its best island with as many bins as before.
    """
    blocks = max(1, -(-n_items // BLOCK_ITEMS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64(F.lit(number), "item"), F.lit(blocks)))
    held = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item", "n"))).alias("held"))
    held = stage(held.select("block", F.col("held.item").alias("ids"), F.col("held.n").cast("array<int>").alias("lengths")))
    island = F.explode(F.sequence(F.lit(0), F.lit(plan.islands - 1))).alias("island")
    empty = F.lit(None).cast("array<array<int>>").alias("population")
    state = held.select("block", island, "lengths", empty, F.lit(0).alias("best"), F.lit(0).alias("before"), F.lit(True).alias("open"))
    tasks = min(blocks * plan.islands, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    least = F.ceil(F.aggregate(F.first("lengths"), F.lit(0).cast("bigint"), lambda a, n: a + n) / capacity)
    epoch = 0
    while True:
        state = stage(state.repartition(tasks, "block", "island").mapInArrow(_island_task(capacity, plan, epoch), STATE))
        went = state.groupBy("block").agg(F.min("best").alias("now"), F.max("before").alias("was"), least.alias("least"))
        went = went.select("block", "now", ((F.col("now") > F.col("least")) & ((F.col("was") == 0) | (F.col("now") < F.col("was")))).alias("open"))
        if went.where("open").isEmpty():
            break
        neighbour = F.pmod(F.col("island") + 1, F.lit(plan.islands)).alias("island")
        elite = state.select("block", neighbour, F.get("population", F.lit(0)).alias("guest"))
        state = state.join(elite, ["block", "island"]).join(went, "block")
        population = F.when(F.col("open"), F.concat(F.array("guest"), "population")).otherwise(F.col("population"))
        state = state.select("block", "island", "lengths", population.alias("population"), "best", F.col("now").alias("before"), "open")
        epoch += 1
    best = state.groupBy("block").agg(F.min_by(F.get("population", F.lit(0)), F.struct("best", "island")).alias("bins"))
    rows = held.join(best, "block").select("block", F.inline(F.arrays_zip("ids", "lengths", "bins")))
    return rows.select(F.col("ids").alias("item"), F.col("lengths").alias("n"), "block", F.col("bins").alias("bin")), blocks


def place(items: DataFrame, capacity: int, plan: Plan) -> DataFrame:
    """(item, sequence_id, offset) of every item.

    Blocks are packed apart, so each leaves about one badly filled bin. Its items go to the
    next round, whose blocks are thousands of times fewer, until one block is left.
    """
    done, number = [], 0
    left = items
    while True:
        packed, blocks = pack_blocks(left, left.count(), capacity, plan, number)
        packed = stage(packed)
        if blocks > 1:
            fill = packed.groupBy("block", "bin").agg(F.sum("n").alias("fill"))
            worst = fill.groupBy("block").agg(F.min_by("bin", F.struct("fill", "bin")).alias("bin"))
            left = stage(packed.join(worst, ["block", "bin"], "left_semi").select("item", "n"))
            packed = packed.join(worst, ["block", "bin"], "left_anti")
        before = F.sum("n").over(W.partitionBy("block", "bin").orderBy("item").rowsBetween(W.unboundedPreceding, -1))
        sequence = F.lit(number << 56) + F.col("block") * (1 << 16) + F.col("bin")
        done.append(packed.select("item", sequence.alias("sequence_id"), F.coalesce(before, F.lit(0)).cast("bigint").alias("offset")))
        if blocks == 1:
            return reduce(DataFrame.unionByName, done)
        number += 1


PIECES = "doc bigint, piece int, start bigint, length bigint, ids binary"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's ids and the end id, cut into pieces from the end, so that only the first may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        schema = pa.schema([("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    rows += [(doc, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col), text_of(text_col)).mapInArrow(run, PIECES)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    plan: Plan = Plan(),
) -> DataFrame:
    """Documents as token pieces packed into sequences of at most ``capacity`` ids.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian
    unsigned 32-bit numbers), ``sequence_id`` and ``offset``. A piece that fills a sequence
    has it alone. A null or empty text is its end id only; null and repeated ids are rows of
    their own; an empty table gives no rows; other columns are not carried. Ids of documents
    must be whole numbers.
    """
    cut = pieces(docs, vocabulary, capacity, end_id, id_col, text_col)
    cut = stage(cut.withColumn("item", F.monotonically_increasing_id()), compression="zstd")
    short = F.col("length") < capacity
    items = cut.where(short).select("item", F.col("length").cast("int").alias("n"))
    packed = cut.where(short).join(place(items, capacity, plan), "item")
    alone = cut.where(~short).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("bigint")})
    return packed.unionByName(alone).drop("item").withColumnRenamed("doc", "doc_id")
