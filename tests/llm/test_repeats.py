"""Substring and byte dedup against brute force."""

import random
import re

import numpy as np
import pytest

from rawlake.llm import repeats, substrings, suffixes

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, units, width):
    """Mask of removed units by row."""
    first = {}
    for doc, text in rows:
        u = units(text)
        for i in range(len(u) - width + 1):
            key = tuple(u[i : i + width])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        u = units(text)
        mask = [False] * len(u)
        for i in range(len(u) - width + 1):
            if first[tuple(u[i : i + width])] < doc:
                mask[i : i + width] = [True] * width
        out.append((u, mask))
    return out


def random_rows(seed, alphabet, n, most):
    rng = random.Random(seed)
    base = [rng.choice(alphabet) for _ in range(400)]
    rows = []
    for doc in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            a = rng.randrange(0, 300)
            parts += base[a : a + rng.randrange(1, 100)] if rng.random() < 0.7 else [rng.choice(alphabet) for _ in range(rng.randrange(1, most))]
        rows.append((doc // 2 if doc % 7 == 0 else doc, "".join(parts) if len(alphabet[0]) == 1 else " ".join(parts)))
    return rows


def keyed(rows):
    return [(-(1 << 63) if d is None else d, t or "") for d, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, table, odd_docs, seed):
    rows = [r[:2] for r in odd_docs[0]] + random_rows(seed, ["a", "b", "cc", "dd", "é"], 40, 80)
    rows = [(d, t) if d is None or i < 17 else (d + 100, t) for i, (d, t) in enumerate(rows)]
    got = substrings.dedup_substrings(table(rows, "doc_id bigint, text string"), bits=16).collect()
    want = [
        (d, " ".join(w for w, m in zip(u, mask, strict=True) if not m), len(u), sum(mask))
        for (d, _), (u, mask) in zip(rows, brute(keyed(rows), SPLIT.findall, 50), strict=True)
    ]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, table, odd_docs, seed):
    rows = [r[:2] for r in odd_docs[0]] + random_rows(seed, list("abcé"), 40, 80)
    rows = [(d, t) if d is None or i < 17 else (d + 100, t) for i, (d, t) in enumerate(rows)]
    got = suffixes.dedup_bytes(table(rows, "doc_id bigint, text string"), bits=16).collect()
    want = []
    for (d, _), (u, mask) in zip(rows, brute(keyed(rows), lambda t: t.encode(), 50), strict=True):
        kept = bytes(b for b, m in zip(u, mask, strict=True) if not m)
        spans = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        want.append((d, kept, len(u), sum(mask), spans))
    assert sorted((repr((r[0], bytes(r[1]), *r[2:])) for r in got)) == sorted(map(repr, want))


def test_a_hot_anchor_is_spread(spark, table, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 2)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 300)
    rng = random.Random(3)
    line = "a very common line that stands in nearly every one of the documents here"
    rows = [(d, "".join(rng.choice("pqrs") for _ in range(rng.randrange(5))) + line + "".join(rng.choice("pq") for _ in range(rng.randrange(60)))) for d in range(60)]
    got = {r[0]: bytes(r[1]) for r in suffixes.dedup_bytes(table(rows, "doc_id bigint, text string"), bits=16).collect()}
    for (d, _), (u, mask) in zip(rows, brute(rows, lambda t: t.encode(), 50), strict=True):
        assert got[d] == bytes(b for b, m in zip(u, mask, strict=True) if not m)


def test_empty_table(spark, table):
    none = table([], "doc_id bigint, text string")
    assert substrings.dedup_substrings(none, bits=16).count() == 0
    assert suffixes.dedup_bytes(none, bits=16).count() == 0


@pytest.mark.parametrize("names", [suffixes.BUCKETS, 0])
def test_suffix_array(names, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKETS", names)
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, k = int(rng.integers(1, 90)), int(rng.integers(1, 5))
        s = np.append(rng.integers(1, k + 1, n), 0)
        assert list(suffixes.suffix_array(s, k + 1)) == sorted(range(n + 1), key=lambda i: list(s[i:]))


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "PART", 64)
    units = np.arange(500, dtype=np.uint64)
    seen = []
    for keys, laid, ends in repeats.parts(iter([((1,), units), ((2,), units[:3])]), 50):
        s = repeats.Stretches(laid, ends, 50, 25).find()
        offset = np.array([k[-1] for k in keys])
        start = s.first - (ends - np.diff(ends, prepend=0))[s.text] + offset[s.text]
        seen += [a + i for a, n in zip(start, s.count, strict=True) for i in range(n)]
    assert sorted(seen) == list(range(451))


def test_equal_rolling_hashes_are_not_equal_texts(spark, table):
    """Thue-Morse texts and their complements agree in every polynomial hash modulo 2 ** 64."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    rows = []
    for k, pair in enumerate(["ab", "xy", "nq"]):
        one, other = ("".join(pair[b ^ flip] for b in bits) for flip in (0, 1))
        assert repeats.Rolling(np.frombuffer(one.encode(), np.uint8)).at(np.array([0]), 4096) == repeats.Rolling(np.frombuffer(other.encode(), np.uint8)).at(np.array([0]), 4096)
        rows += [(2 * k, f"{k}123456789" + one), (2 * k + 1, f"{k}123456789" + other), (20 + k, one)]
    got = {r[0]: bytes(r[1]) for r in suffixes.dedup_bytes(table(rows, "doc_id bigint, text string"), bits=16).collect()}
    for (d, _), (u, mask) in zip(rows, brute(rows, lambda t: t.encode(), 50), strict=True):
        assert got[d] == bytes(b for b, m in zip(u, mask, strict=True) if not m)
