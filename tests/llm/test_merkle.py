"""Merkle manifests against a tree built one node at a time."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rawlake.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, s string, i int, n string, digest string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    doc, text, lang, source, n_chars = row[:5]
    return sha(*map(one, (doc, source, lang, n_chars, text)))


def climb(digests, fanout):
    """The root, and for every leaf its siblings by level: (left, right)."""
    ways = [[] for _ in digests]
    below = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        runs = [digests[k : k + fanout] for k in range(0, len(digests), fanout)]
        held = [below[k : k + fanout] for k in range(0, len(digests), fanout)]
        for run, leaves in zip(runs, held, strict=True):
            for k, some in enumerate(leaves):
                for x in some:
                    ways[x].append(("".join(run[:k]), "".join(run[k + 1 :])))
        digests = [sha(*run) for run in runs]
        below = [[x for some in leaves for x in some] for leaves in held]
    return digests[0], ways


def brute(rows, fanout=3):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in sources:
        some = sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = (some, *climb([leaf(r) for r in some], fanout))
    root, upper = climb([trees[x][1] for x in sources], fanout)
    out = []
    for x, above in zip(sources, upper, strict=True):
        some, subroot, ways = trees[x]
        out += [(r[0], leaf(r), subroot, root, [*way, *above]) for r, way in zip(some, ways, strict=True)]
    return out


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    out = [(k if rng.random() < 0.9 else k // 2, "é\nx" * rng.randrange(4), rng.choice(["en", None]), rng.choice(sources), k, "a", 1, "b", "c", "d") for k in range(n)]
    return [*out, *out[:3], (None, None, None, None, None, None, None, None, None, None), (None, "long " * 100_000, "", "", 0, None, None, None, None, None)]


@pytest.mark.parametrize(("n", "sources"), [(0, ["x"]), (1, ["x"]), (60, ["x"]), (90, ["hot"] * 9 + [None, "", "z", "ä", "Z", "b", "cc"])])
def test_manifest(table, n, sources):
    rows = rows_of(n, n, sources)
    found = merkle.manifest(table(rows, SCHEMA))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "path"]
    folded = merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")
    got = found.withColumns({"proof": merkle.sibling_digest(F.col("path")), "ok": folded}).collect()
    assert all(r.ok for r in got)
    want = brute(rows)
    assert sorted(repr((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path])) for r in got) == sorted(map(repr, want))
    assert sorted(r.proof for r in got) == sorted(sha(*[a + b for a, b in w[4]]) for w in want)


def test_one_row_and_none(table):
    one = [(7, "t", "en", "x", 1, *[None] * 5)]
    got = merkle.manifest(table(one, SCHEMA)).collect()
    assert [(r.leaf, r.subroot, r.root, r.path) for r in got] == [(leaf(one[0]),) * 3 + ([],)]
    assert merkle.manifest(table([], SCHEMA)).count() == 0


def test_other_fanout_and_tampering(table):
    rows = rows_of(4, 40, ["x", "y"])
    docs = table(rows, SCHEMA)
    values = {f: F.col(f) for f in merkle.FIELDS} | {"text": F.concat("text", F.lit("!"))}
    found = merkle.manifest(docs, fanout=4, carry={"bad": merkle.leaf_digest(*values.values())})
    fold = merkle.folded(F.col("bad"), F.col("path")).alias("fold")
    got = found.select("doc_id", "leaf", "bad", "root", "path", fold).collect()
    assert sorted(repr((r.leaf, r.root, [tuple(s) for s in r.path])) for r in got) == sorted(repr((w[1], w[3], w[4])) for w in brute(rows, 4))
    # a null text stays null, every other changes the root that its leaf gives
    assert all((r.fold == r.root) == (r.bad == r.leaf) for r in got) and sum(r.bad == r.leaf for r in got) == 1
