"""Near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from rawlake.llm import near_dups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        c = min(known) if known else None
        out.append((d, len(sets[i]), c, True if c is None else d == c))
    return out


def near_rows(seed):
    rng = random.Random(seed)
    rows, doc = [], 1000
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((doc, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_components(spark, table, odd_docs, seed, width, percent):
    rows = [r[:2] for r in odd_docs[0]] + near_rows(seed)
    got = near_dups.near_duplicates(table(rows, "doc_id bigint, text string"), width=width, percent=percent)
    got = [tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()]
    want = brute(rows, width, percent)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_blocks_of_a_large_bucket(spark, table, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rows = near_rows(4)
    got = near_dups.near_duplicates(table(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == sorted(brute(rows, 3, 85))


def test_keep_one(spark, table, odd_docs):
    docs = table(*odd_docs)
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    assert near_dups.keep_one(docs.limit(0)).count() == 0
    want = [d for d, _, _, keep in brute([r[:2] for r in odd_docs[0]], 5, 80) if keep]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(d or 0 for d in want)


@pytest.mark.parametrize("size", [5, 40, 300, 5000, 20000])
def test_the_sketch_test_keeps_links(spark, size):
    f = near_dups.Family(0.85)
    assert (1 - f.threshold**near_dups.ROWS) ** f.bands <= near_dups.MISS
    rng = np.random.default_rng(size)
    differ = int(size * 0.15 / 1.85)  # of each side, at the threshold
    rows = []
    for k in range(20):
        both = rng.integers(-(1 << 63), 1 << 63, size - differ)
        for side in (0, 1):
            rows.append((k, side, k, [*both.tolist(), *rng.integers(-(1 << 63), 1 << 63, differ).tolist()]))
    signed = near_dups.signatures(spark.createDataFrame(rows, "r1 long, r2 long, id long, set array<bigint>"), f).collect()
    of = {(r.r1, r.r2): np.frombuffer(r.sketch, np.uint64) for r in signed}
    most = f.most_bits(float(size), float(size), near_dups.OnArrays)
    counts = [int(np.bitwise_count(of[k, 0] ^ of[k, 1]).sum()) for k in range(20)]
    assert max(counts) <= most
    # unlike sets fail it
    assert min(int(np.bitwise_count(of[k, 0] ^ of[k + 1, 0]).sum()) for k in range(19)) > most
