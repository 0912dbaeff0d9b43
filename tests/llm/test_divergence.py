"""Term shares and distances against counting word by word."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rawlake.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n bigint, p string, rank string"


def words(text):
    return [w.translate(LOW) for w in WORD.findall(text or "")]


def brute(rows, least, top):
    docs = [((r[2] or ""), (r[3] or ""), words(r[1])) for r in rows]
    df, counts = Counter(), Counter()
    for lang, source, w in docs:
        df.update((lang, x) for x in set(w))
        counts.update((lang, source, x) for x in w)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(x for (g, x), k in df.items() if g == lang and k >= least)
        sources = sorted({d[1] for d in docs if d[0] == lang}, key=str.encode)

        def shares(n, kept=kept):
            total = sum(n[x] for x in kept)
            return {x: 1 + 10**9 * (n[x] + 5) // (total + 5 * len(kept)) for x in kept}

        by = {s: Counter({x: counts[lang, s, x] for x in kept}) for s in sources}
        p = {s: shares(by[s]) for s in sources}
        q = shares(sum(by.values(), Counter()))
        for s in sources:
            pair = [(o, sum(abs(p[s][x] - p[o][x]) for x in kept)) for o in sources if o != s]
            term = [(x, p[s][x] - q[x]) for x in kept if by[s][x] and p[s][x] > q[x]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return out


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    some = ["The", "the", "tHE", "éa", "Éa", "longwordofmany", "longwordofmanz", "longwordofman", "a", "ab", "漢字", "x9y", "don't", "averyveryverylongwordindeed"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(some[: 3 + k % 12]) for _ in range(rng.randrange(40)))
        rows.append((k, text, rng.choice(["en", "en", "de", None]), rng.choice(sources), "a", 1, "b", "c"))
    rows += [(1, None, "fr", "only", None, None, None, None), (1, "", "en", None, None, None, None, None), (None, "!! 12", "xx", "s", "", 0, "", "")]
    return [*rows, *rows[:5], (n, "big Word\n" * 50_000, "en", "hot", "", 0, "", "")]


@pytest.mark.parametrize("blocks", [(256, 1 << 20), (2, 7)])
def test_divergence(table, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "SOURCES", blocks[0])
    monkeypatch.setattr(divergence, "CELLS", blocks[1])
    rows = rows_of(3, 300, ["hot"] * 8 + ["s1", "S2", "é", "", None, "s3"])
    got = divergence.divergence(table(rows, SCHEMA), least_docs=4, top=3).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, 4, 3)))


def test_no_term_is_kept_and_no_row(table):
    rows = rows_of(4, 10, ["a", "b"])
    got = divergence.divergence(table(rows, SCHEMA), least_docs=99).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, 99, 50))) and all(r.value == 0 for r in got)
    assert divergence.divergence(table([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("small", "tiny"), [(1, 0), (4, 2), (16, 0), (8, 8), (1 << 14, 256)])
def test_pointers_are_sorted(monkeypatch, small, tiny):
    monkeypatch.setattr(divergence, "SMALL", small)
    monkeypatch.setattr(divergence, "TINY", tiny)
    rng = random.Random(small)
    for _ in range(30):
        texts = ["".join(rng.choice("aAbé -") for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(1, 6))]
        texts.append("z" * rng.randrange(1, 40) + "Z" * 8)
        raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        group = np.array([rng.randrange(2) for _ in texts], dtype=np.uint16)
        p = divergence.Pointers(np.concatenate(raw), np.cumsum([len(r) for r in raw]), group)
        got = [(w.encode(), *r) for w, *r in zip(*[x.to_pylist() if isinstance(x, pa.Array) else list(x) for x in p.counts()], strict=True)]
        n, df = Counter(), Counter()
        for t, g in zip(texts, group, strict=True):
            n.update((w.encode(), g) for w in words(t))
            df.update({(w.encode(), g) for w in words(t)})
        assert got == [(*k, n[k], df[k]) for k in sorted(n)]


def test_long_texts_are_counted_in_slices(monkeypatch):
    rows = [("en", "s", "a bb a " * 40 + "c" * 100 + " bb"), ("en", "s", "bb Ccc"), ("en", "s", ""), ("de", "s", "a" * 300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])
    seen = []
    for size in (16, 1 << 20):
        monkeypatch.setattr(divergence, "SHARD_BYTES", size)
        total = Counter()
        for out in divergence.shard_counts(iter([batch])):
            for r in out.to_pylist():
                total.update({(r["lang"], r["source"], r["term"], "n"): r["n"], (r["lang"], r["source"], r["term"], "df"): r["df"]})
        seen.append(total)
    assert seen[0] == seen[1] and seen[0]["en", "s", "bb", "n"] == 42 and seen[0]["en", "s", "bb", "df"] == 2
