"""Language identification: averaged embeddings of hashed subwords under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawlake.llm.common import stage

# Subwords are runs of one to four bytes of a text in lower case, in which all but letters is
# one blank; they fall into so many buckets.
ORDER = 4
BITS = 16
BUCKETS = 1 << BITS
DIM = 16
# Bytes of text handled at once. Longer texts are summed over parts that overlap.
PART = 1 << 20
# Pieces of a labelled text that the model is fitted on, and their lengths in bytes.
PIECES, SHORTEST, LONGEST = 4, 16, 1024
UNKNOWN = "und"

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LETTER = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_PLAIN = np.where(_LETTER, np.where(_UPPER, _BYTES + 32, _BYTES), 0x20).astype(np.uint8)


def plain(raw: np.ndarray) -> np.ndarray:
    """Letters in lower case (A-Z here; others are lowered before) with one blank between words and at both ends."""
    held = np.concatenate([[0x20], _PLAIN[raw], [0x20]]).astype(np.uint8)
    blank = held == 0x20
    return held[~(blank & np.append(False, blank[:-1]))]


def subwords(text: np.ndarray) -> np.ndarray:
    """The buckets of the subwords at every place of a plain text, shorter ones first."""
    out, h = [], np.full(len(text), 0x811C9DC5, dtype=np.uint32)
    for n in range(1, ORDER + 1):
        # a longer subword goes on from the hash of the shorter one at its place
        h = (h[: len(text) - n + 1] ^ text[n - 1 :]) * np.uint32(0x01000193)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.intp)


@dataclass
class Model:
    """Embeddings of buckets, their weights per language, and the calibration."""

    langs: list[str]
    embedding: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    @classmethod
    def fresh(cls, langs: list[str]) -> Model:
        rng = np.random.default_rng(13)
        start = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
        return cls(langs, start.astype(np.float32), np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32))

    def table(self) -> np.ndarray:
        """What a bucket adds to each language, or the embeddings where these are shorter."""
        return (self.embedding @ self.weight).astype(np.float32) if len(self.langs) <= DIM else self.embedding

    def logits(self, mean: np.ndarray) -> np.ndarray:
        """From the mean of the table's rows over a text."""
        return (mean if len(self.langs) <= DIM else mean @ self.weight) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.heat
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def dump(self) -> dict:
        arrays = {k: getattr(self, k).tobytes() for k in ("embedding", "weight", "bias")}
        return {"langs": self.langs, **arrays, "heat": float(self.heat), "least": float(self.least)}

    @classmethod
    def load(cls, row) -> Model:
        n = len(row["langs"])
        embedding, weight, bias = (np.frombuffer(row[k], np.float32) for k in ("embedding", "weight", "bias"))
        return cls(list(row["langs"]), embedding.reshape(BUCKETS, DIM), weight.reshape(DIM, n), bias, row["heat"], row["least"])


MODEL = "langs array<string>, embedding binary, weight binary, bias binary, heat double, least double"
MODEL_ARROW = pa.schema(
    [("langs", pa.list_(pa.string())), *[(k, pa.binary()) for k in ("embedding", "weight", "bias")], ("heat", pa.float64()), ("least", pa.float64())]
)


class Examples:
    """Texts as (bucket, share) pairs that lie end to end."""

    def __init__(self, rows: list[np.ndarray], label: list[int]):
        pairs = [np.unique(r, return_counts=True) for r in rows]
        self.ends = np.cumsum([0, *[len(u) for u, _ in pairs]])
        self.bucket = np.concatenate([u for u, _ in pairs]).astype(np.int32)
        self.share = np.concatenate([n / n.sum() for _, n in pairs]).astype(np.float32)
        self.label = np.array(label)

    def some(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, share, example) of the chosen examples."""
        sizes = self.ends[chosen + 1] - self.ends[chosen]
        at = np.repeat(self.ends[chosen] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        return self.bucket[at], self.share[at], np.append(0, np.cumsum(sizes)[:-1])

    def means(self, model: Model, chosen: np.ndarray) -> np.ndarray:
        bucket, share, first = self.some(chosen)
        return np.add.reduceat(model.embedding[bucket] * share[:, None], first)


def fit(examples: Examples, langs: list[str], train: np.ndarray, epochs: int, rate: float, batch: int = 32, least: int = 1500) -> Model:
    """Stochastic gradient descent over small batches, with a rate that falls to zero.

    Few examples are seen in more epochs, for ``least`` steps in all.
    """
    model, rng = Model.fresh(langs), np.random.default_rng(7)
    epoch = -(-len(train) // batch)
    epochs = max(epochs, -(-least // epoch))
    steps = epochs * epoch
    done = 0
    for _ in range(epochs):
        shuffled = rng.permutation(train)
        for at in range(0, len(shuffled), batch):
            chosen = shuffled[at : at + batch]
            bucket, share, first = examples.some(chosen)
            mean = np.add.reduceat(model.embedding[bucket] * share[:, None], first)
            off = model.probabilities(mean @ model.weight + model.bias)
            off[np.arange(len(chosen)), examples.label[chosen]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = off @ model.weight.T
            model.weight -= step * (mean.T @ off)
            model.bias -= step * off.sum(axis=0) / np.float32(batch)
            sizes = np.diff(np.append(first, len(bucket)))
            np.subtract.at(model.embedding, bucket, (step * share)[:, None] * np.repeat(back, sizes, axis=0))
            done += 1
    return model


def calibrate(model: Model, examples: Examples, held: np.ndarray, precision: float) -> None:
    """On held-out examples: the temperature of least log loss, and the least score to accept.

    ``least`` is the smallest score above which at least ``precision`` of the answers are right.
    """
    if not len(held):
        return
    logits = np.concatenate([examples.means(model, held[k : k + 256]) for k in range(0, len(held), 256)]) @ model.weight + model.bias
    label, places = examples.label[held], np.arange(len(held))

    def loss(heat: float) -> float:
        model.heat = heat
        return float(-np.log(np.maximum(model.probabilities(logits)[places, label], 1e-12)).mean())

    model.heat = min(np.geomspace(0.05, 20, 61).tolist(), key=loss)
    p = model.probabilities(logits)
    score, right = p.max(axis=1), p.argmax(axis=1) == label
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
    model.least = float(score[order][good[-1]]) if len(good) else 1.0


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plain pieces of labelled texts at places and of lengths that the text's hash gives: (lang, held, piece)."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("piece", pa.binary())])
    for batch in batches:
        rows = []
        for lang, h, text in zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), batch.column("text"), strict=True):
            raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
            rng = np.random.default_rng(h & 0x7FFFFFFFFFFFFFFF)
            for size in np.exp(rng.uniform(np.log(SHORTEST), np.log(LONGEST), PIECES)).astype(int).tolist():
                at = int(rng.integers(0, max(1, len(raw) - size + 1)))
                piece = plain(raw[at : at + size])
                if len(piece) > 2:
                    rows.append((lang, h, piece.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _trainer(epochs: int, rate: float, precision: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(r["h"], r["lang"], r["piece"]) for b in batches for r in b.to_pylist()})
        if not rows:
            return
        langs = sorted({lang for _, lang, _ in rows}, key=str.encode)
        number = {x: k for k, x in enumerate(langs)}
        examples = Examples([subwords(np.frombuffer(p, np.uint8)) for _, _, p in rows], [number[x] for _, x, _ in rows])
        # all pieces of a text are on one side
        held = np.array([h % 5 == 0 for h, _, _ in rows])
        train = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
        model = fit(examples, langs, train, epochs, rate)
        calibrate(model, examples, np.flatnonzero(held), precision)
        d = model.dump()
        yield pa.RecordBatch.from_arrays([pa.array([d[f.name]], f.type) for f in MODEL_ARROW], schema=MODEL_ARROW)

    return run


def learn(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 4000,
    epochs: int = 3,
    rate: float = 0.5,
    precision: float = 0.99,
) -> Model | None:
    """A model fitted on about ``max_rows`` labelled texts, chosen by a hash of text and label.

    Rows without a text or label are left out, equal rows are one. Four pieces of each
    chosen text, of 16 to 1,024 bytes, are the examples, so that the one task that fits them
    is of bounded size whatever the texts; a fifth of the texts calibrates. The lists of
    languages and labels are those of the chosen texts. Without any there is no model.
    """
    h = F.xxhash64(F.lit("pick"), F.col(text_col), F.col(lang_col))
    marked = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"), h.alias("h"))
    n = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).count()
    if n > max_rows:
        marked = marked.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    pieces = stage(marked.mapInArrow(_pieces, "lang string, h bigint, piece binary"))
    found = stage(pieces.coalesce(1).mapInArrow(_trainer(epochs, rate, precision), MODEL)).collect()
    return Model.load(found[0]) if found else None


def text_mean(table: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The mean of the table's rows over all subwords of a text in lower case, part by part."""
    text = plain(raw)
    total, count = np.zeros(table.shape[1]), 0
    for at in range(0, len(text), PART):
        # subwords that start in the part, and those that the bytes behind it end
        part = text[at : at + PART + ORDER - 1]
        found = subwords(part)
        extra = subwords(part[PART:])
        total += np.ones(len(found), np.float32) @ table[found] - np.ones(len(extra), np.float32) @ table[extra]
        count += len(found) - len(extra)
    return total / count


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score``, ``accepted``) of every row, from its whole text alone.

    ``score`` is the calibrated probability of the language, and a row is accepted if its
    score reaches the model's ``least``. A null text, and one without any letter, is ``und``
    with score 0 and not accepted, as are all rows where there is no model. Rows may repeat
    and ids may be null; a text of any length is summed part by part. Other columns are not
    read.
    """
    letters = F.coalesce(F.rlike(F.col(text_col), F.lit("\\p{L}")), F.lit(False))
    texts = docs.select(F.col(id_col).alias("id"), F.when(letters, F.lower(text_col)).alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean"
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        table = model.table() if model else None
        for batch in batches:
            found = []
            for text in batch.column("text"):
                if model is None or not text.is_valid:
                    found.append((UNKNOWN, 0.0, False))
                    continue
                p = model.probabilities(model.logits(text_mean(table, np.frombuffer(text.as_buffer(), dtype=np.uint8))))
                best = int(p.argmax())
                found.append((model.langs[best], float(p[best]), bool(p[best] >= model.least)))
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "lang_pred", "score", "accepted"])

    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)
