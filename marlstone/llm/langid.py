"""Language identification: averaged embeddings of hashed byte n-grams, a linear softmax, SGD in numpy, calibrated rejection.

A text is lower-cased in ASCII, what isn't a letter there becomes one space, and each n-gram of its bytes gets one of
``BUCKETS`` embeddings. The mean embedding goes through a linear softmax. Since both are linear, a trained model is
applied as one table of n-gram scores. A temperature is fitted on documents kept from training and short parts of them,
so that the score of a few words is as sure as they are, and a document whose calibrated score is below the rejection bound (a low quantile of those documents' scores, at most ``REJECT_AT``) is
rejected, as is one without letters.

The classifier learns from a bounded sample: about ``SAMPLE`` documents of a label, fewer where there are so many labels
that all together would be more than ``TOTAL``, but ``LEAST`` of each (all of a label that has no more); by a hash of
their ids, so that every label has its documents; six pieces of each, the whole text among them. Everything else is done
for every row and whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with nothing to learn from, all are
``und``; rows with a null label or id aren't learned from; repeated rows are predicted one by one; a null id isn't held
out; an empty table gives an empty table; a very long text is scored whole, block by block; of labels with equal scores
the first in alphabetical order is predicted; columns other than the named ones aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documents of a label that the classifier learns from, about; of all labels, about; of a label that has so many, at least.
SAMPLE, TOTAL, LEAST = 600, 4800, 8
BUCKETS = 1 << 15
WIDTH = 16
GRAMS = (2, 3, 4, 5)
#: Texts that a document gives: the whole and short parts.
PIECES = 6
EPOCHS = 4
RATE = 0.2
#: Shares of n-grams are small: without this factor the embeddings would hardly move.
PACE = 10
#: A calibrated score below this at most is rejected; the bound itself is the quantile below, if that is less.
REJECT_AT = 0.4
QUANTILE = 0.002
#: Cells of a score table that a worker holds at once.
CELLS = 4_000_000
#: Labels whose counts are told to all tasks at once; beyond, they are joined.
BROADCAST_LABELS = 100_000
UNKNOWN = "und"

_LETTERS = bytes((c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20) for c in range(256))


def plain(text: bytes | None) -> bytes:
    """The text as the n-grams see it, between two spaces; empty if it has no letter."""
    own = text.translate(_LETTERS).split() if text else []
    if not own or not (any(65 <= w[0] <= 122 for w in own) or any(map(str.isalpha, text.decode()))):
        return b""
    return b" " + b" ".join(own) + b" "


def buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each n-gram of bytes, by its start."""
    many = max(0, len(raw) - n + 1)
    h = np.full(many, n, dtype=np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= raw[k : k + many]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - (BUCKETS.bit_length() - 1))


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a plain text and how often each occurs, two bytes each; counts beyond that are all scaled down."""
    raw = np.frombuffer(text, dtype=np.uint8)
    seen, many = np.unique(np.concatenate([buckets(raw, n) for n in GRAMS]), return_counts=True)
    most = int(many.max())
    many = many if most < 1 << 16 else np.ceil(many * (0xFFFF / most))
    return seen.astype(np.uint16), many.astype(np.uint16)


def shares(many: np.ndarray) -> np.ndarray:
    return (many / many.sum(dtype=np.int64)).astype(np.float32)


def pieces(text: bytes, seed: int) -> list[bytes]:
    """The whole plain text and five short parts of it, so that short documents are learned too."""
    words = text.split()
    rng = np.random.default_rng(seed)
    out = [text]
    for size in (1, 2, 4, 8, 32):
        at = int(rng.integers(0, max(1, len(words) - size + 1)))
        out.append(b" " + b" ".join(words[at : at + size]) + b" ")
    return out


@dataclass
class Model:
    labels: list[str]
    embedding: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, table: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Scores of plain texts. ``table`` is what n-grams add up: of few labels, their scores themselves (embedding times output)."""
        out = np.zeros((len(texts), table.shape[1]), dtype=np.float64)
        grams = np.zeros(len(texts))
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        block = max(1, CELLS // max(1, table.shape[1]))
        longest = max(GRAMS)
        for s in range(0, len(raw), block):
            part = raw[s : s + block + longest - 1]
            for n in GRAMS:
                h = buckets(part, n)[:block]
                at = np.arange(s, s + len(h))
                doc = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[doc]  # an n-gram lies within one text
                h, doc = h[inside], doc[inside]
                if len(h):
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    out[doc[first]] += np.add.reduceat(table[h], first, axis=0, dtype=np.float64)
                    grams[doc[first]] += np.diff(np.append(first, len(h)))
        out /= np.maximum(grams, 1)[:, None]
        return (out if self.few() else out @ self.output) + self.bias

    def few(self) -> bool:
        """Are there fewer labels than an embedding has numbers?"""
        return len(self.labels) <= WIDTH

    def table(self) -> np.ndarray:
        return (self.embedding @ self.output if self.few() else self.embedding).astype(np.float32)

    def predict(self, texts: list[bytes | None], table: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        own = [plain(t) for t in texts]
        label, score = [UNKNOWN] * len(own), np.zeros(len(own))
        some = [k for k, t in enumerate(own) if t]
        if some and self.labels:
            z = self.logits(self.table() if table is None else table, [own[k] for k in some])
            p = softmax(z / self.temperature)
            best = p.argmax(axis=1)
            for k, b, x in zip(some, best.tolist(), p[np.arange(len(best)), best].tolist(), strict=True):
                label[k], score[k] = self.labels[b], x
        return label, score


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, labels: list[str], seed: int = 1) -> Model:
    """Stochastic gradient descent, one bag a step; every label weighs the same."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
    w = np.zeros((WIDTH, len(labels)), dtype=np.float32)
    b = np.zeros(len(labels), dtype=np.float32)
    weight = (len(target) / np.maximum(np.bincount(target, minlength=len(labels)), 1) / len(labels)).astype(np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            at, share = bags[k][0], shares(bags[k][1])
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ e[at]
            wrong = softmax(mean @ w + b)
            wrong[target[k]] -= 1
            wrong *= rate * min(weight[target[k]], 4.0)
            back = w @ wrong
            w -= np.outer(mean, wrong)
            b -= 0.1 * wrong
            e[at] -= np.outer(share * PACE, back)
    return Model(labels, e, w, b)


def calibrate(model: Model, z: np.ndarray, target: np.ndarray, whole: np.ndarray) -> None:
    """Temperature by likelihood over short and whole texts that weren't learned from; then the rejection bound, by the whole ones."""
    rows = np.arange(len(z))
    grid = np.geomspace(0.02, 20, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[rows, target] + 1e-12).mean()))
    top = softmax(z[whole] / model.temperature).max(axis=1)
    model.reject_below = float(min(REJECT_AT, np.quantile(top, QUANTILE)))


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, by which documents are held out."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, usable: Column, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model learned from a bounded sample of the rows where ``usable`` holds; one in five of them calibrates."""
    common.ship(docs.sparkSession)
    rows = docs.where(usable & F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("label"), F.col(text).alias("text")
    )
    counts = common.written(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
    many = counts.count()
    if not many:
        return Model([], np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    # Ids whose hash is below the label's share of the hash range: about as many rows as are wanted, spread over all files.
    wanted = max(LEAST, min(sample, TOTAL // many))
    place = F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(F.broadcast(counts) if many <= BROADCAST_LABELS else counts, "label").where((F.col("n") <= wanted) | (place < F.lit(float(wanted)) / F.col("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.chunks(batches, "text"):
            keys, names = part.column(0).to_pylist(), part.column(1).to_pylist()
            for k, name, t in zip(keys, names, texts, strict=True):
                if own := plain(t):
                    seed = int.from_bytes(k.encode()[-8:], "little")
                    made = [bag(p) for p in pieces(own, seed)]
                    yield pa.RecordBatch.from_pydict({"key": [k], "label": [name], "at": [[m[0].tobytes() for m in made]], "many": [[m[1].tobytes() for m in made]]})

    got = few.select("key", "label", "text").mapInArrow(run, "key string, label string, at array<binary>, many array<binary>").toArrow()
    names, keys = got.column("label").to_pylist(), got.column("key").to_pylist()
    labels = sorted(set(names))
    number = {x: k for k, x in enumerate(labels)}
    bags, target, held, held_target = [], [], [], []
    for turn, k in enumerate(sorted(range(len(names)), key=lambda k: (names[k], keys[k]))):
        name = number[names[k]]
        own = [(np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(m.as_buffer(), np.uint16)) for a, m in zip(got["at"][k].values, got["many"][k].values, strict=True)]
        if turn % 5 == 0:
            held += own
            held_target += [name] * len(own)
        else:
            bags += own
            target += [name] * len(own)
    if not bags:
        bags, target, held = held, held_target, []  # too few to keep any
    model = train(bags, np.array(target), labels)
    if held:
        table = model.table()
        mean = np.stack([shares(m) @ table[a] for a, m in held])
        z = (mean if model.few() else mean @ model.output) + model.bias
        calibrate(model, z, np.array(held_target), np.arange(len(held)) % PIECES == 0)
    del got, bags, held
    common.settle()
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score and rejected of every row; one pass, no shuffle. The model is a few MB at most."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast((model, model.table()))
    column = text if text in keep else common.free("__text", keep)  # a text that is kept travels once
    source = docs.select(*keep) if column == text else docs.select(*keep, F.col(text).alias(column))
    out = T.StructType([
        *docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = sent.value
        for rows, texts in common.chunks(batches, column):
            label, score = own.predict(texts, table)
            rejected = [x == UNKNOWN or s < own.reject_below for x, s in zip(label, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(label, pa.string()), pa.array(score), pa.array(rejected)], names=out.names)

    return source.mapInArrow(run, out)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document, learned from those that aren't held out."""
    model = fit(docs, fold(F.col("doc_id")) != 0)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose language isn't rejected."""
    model = fit(docs, fold(F.col("doc_id")) != 0, text)
    own = docs.columns
    names = [f"__c{i}" for i in range(len(own))]
    rows = predict(docs.toDF(*names), model, names[own.index(text)], tuple(names))
    return rows.where(~F.col("rejected")).select(*names).toDF(*own)
