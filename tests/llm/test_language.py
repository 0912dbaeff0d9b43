"""Language identification against plain loops and on held-out texts."""

import random
import zlib

import numpy as np
import pytest

from rawlake.llm import language

SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch ung ein ver heit", "cc": "eau oui ère tion ça", "dd": "ок на ли го ра"}
SCHEMA = "doc_id bigint, text string, lang string, lang_pred string, score double, id string"


def text_of(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows_of(seed, n):
    rng = random.Random(seed)
    langs = [rng.choice([*SYLLABLES, "aa", "aa"]) for _ in range(n)]
    return [(k, text_of(rng, x, rng.randrange(3, 60)), x, "x", 1.0, "y") for k, x in enumerate(langs)]


def plain_mean(table, text):
    """One subword at a time."""
    words, now = [], bytearray()
    for b in text.lower().encode():
        if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128:
            now.append(b)
        elif now:
            words.append(bytes(now))
            now = bytearray()
    words += [bytes(now)] if now else []
    held = b" " + b" ".join(words) + (b" " if words else b"")
    rows = []
    for n in range(1, language.ORDER + 1):
        for at in range(len(held) - n + 1):
            h = 0x811C9DC5
            for b in held[at : at + n]:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            rows.append(table[h >> 16])
    return np.mean(rows, axis=0)


@pytest.mark.parametrize("part", [1, 5, 1 << 20])
def test_means_are_those_of_all_subwords(monkeypatch, part):
    monkeypatch.setattr(language, "PART", part)
    table = np.random.default_rng(1).normal(size=(language.BUCKETS, 3)).astype(np.float32)
    for text in ("a", "Ab, cd", "  é!!x--y  ", "漢字", "12 z", "one two three four " * 3):
        got = language.text_mean(table, np.frombuffer(text.lower().encode(), np.uint8))
        assert np.abs(got - plain_mean(table, text)).max() < 1e-4


def test_held_out_texts(spark, table):
    rows = rows_of(1, 900)
    model = language.learn(table(rows[:600], SCHEMA))
    assert model.langs == sorted(SYLLABLES)
    got = language.identify(table(rows[600:], SCHEMA), model).collect()
    right = {r[0]: r[2] for r in rows[600:]}
    assert len(got) == 300 and sum(r.lang_pred == right[r.doc_id] for r in got) >= 295
    assert all(0 <= r.score <= 1 and r.accepted == (r.score >= model.least) for r in got)
    # the same by loops
    texts = {r[0]: r[1] for r in rows}
    for r in got[:20]:
        p = model.probabilities(plain_mean(model.embedding, texts[r.doc_id]) @ model.weight + model.bias)
        assert model.langs[p.argmax()] == r.lang_pred and abs(p.max() - r.score) < 1e-3


def test_a_bounded_sample_is_fitted(spark, table, monkeypatch):
    seen = []
    real = language._trainer
    monkeypatch.setattr(language, "_trainer", lambda *a: [seen.append(a), real(*a)][1])
    rows = rows_of(2, 2000)
    model = language.learn(table(rows, SCHEMA), max_rows=200, epochs=2)
    assert set(model.langs) == set(SYLLABLES) and seen == [(2, 0.5, 0.99)]


def test_strange_texts_are_rejected():
    rng = random.Random(3)
    model = language.Model.fresh(["a", "b"])
    rows = [np.frombuffer((" " + text_of(rng, x, 9) + " ").encode(), np.uint8) for x in ["aa", "bb"] * 200]
    # a fifth of the labels says nothing
    labels = [k % 2 if k % 5 else rng.randrange(2) for k in range(400)]
    examples = language.Examples([language.subwords(r) for r in rows], labels)
    model = language.fit(examples, ["a", "b"], np.arange(200), 5, 0.5)
    language.calibrate(model, examples, np.arange(200, 400), 0.8)
    assert 0 < model.least <= 1
    p = model.probabilities(examples.means(model, np.arange(200, 400)) @ model.weight + model.bias)
    chosen = p.max(axis=1) >= model.least
    assert chosen.any() and (p.argmax(axis=1) == examples.label[200:])[chosen].mean() >= 0.8
    # about nine tenths of the labels are right, and the score says so
    assert 0.75 < p.max(axis=1).mean() < 0.99


def test_odd_rows(spark, table, odd_docs):
    rows = rows_of(4, 300)
    model = language.learn(table([*rows, *rows[:9], (None, None, "zz", "", 0.0, ""), (5, "text", None, "", 0.0, "")], SCHEMA))
    assert model.langs == sorted(SYLLABLES)
    odd = [(None, None), (1, ""), (2, " 12 !!"), (2, " 12 !!"), (3, "ka lo" * 300_000), (None, "schung einver"), (4, "漢")]
    docs = [(*r, "en", "x", 0.5, "i") for r in odd]
    got = language.identify(table(docs, SCHEMA), model).collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "lang_pred", "score", "accepted"]
    by = sorted((repr(r.doc_id), r.lang_pred, r.score > 0) for r in got)
    assert by[:3] == [("1", "und", False), ("2", "und", False), ("2", "und", False)] and ("3", "aa", True) in by
    assert ("None", "und", False) in by and ("None", "bb", True) in by and len(got) == len(odd)
    assert language.identify(table([], SCHEMA), model).count() == 0
    assert language.learn(table([], SCHEMA)) is None
    assert {(r.lang_pred, r.score, r.accepted) for r in language.identify(table(docs, SCHEMA), None).collect()} == {("und", 0.0, False)}


def test_query(spark, sf):
    from rawlake.llm import queries

    got = queries.op13_subword_embeddings(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
