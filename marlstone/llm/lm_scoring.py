"""Masked pseudo-likelihood: a window network, trained in numpy, predicts every token from both sides.

A document's score is the sum over its words of log P(word | two words before, two after). The vocabulary is that of the
whole corpus, by exact counts: its ``WORDS`` most frequent words are outputs of the network, all others share ``BUCKETS``
more outputs by hash, and log P(word | its output) is that of the word's own share of the output's counts; a word that isn't
in the corpus gets ``UNSEEN`` of an occurrence. Tasks know the shares of the ``NAMED`` most frequent of these words; the
occurrences of rarer ones, which are few, are joined with the counts, so every word has its own count at any size. ``score``,
for texts at hand, does without the join: it has these shares by slots, twice as many as there are such words, ``MOST_SLOTS``
at most, and words of one slot share it.
Training runs where the data is: in each round every task starts from the same parameters, learns from its share of the word
positions of all its documents, and sends its parameters on; they are averaged by positions in two steps, so the driver gets
``GROUPS`` sets a round. All rounds together learn from every position of the corpus just once; there is one, unless more are
asked for, whose shares lie side by side. How documents lie in tasks is part of the training: another split of the files gives other
parameters, and scores that differ a little.

Defined cases: null and wordless texts have no token, logprob 0 and no mean; words are parted by ASCII blanks and
lower-cased in ASCII; words of more than ``LONGEST`` bytes are counted by their digest and aren't outputs of their own;
words with equal counts are in order of their bytes; repeated rows are scored each; an empty table leaves the network
untrained and the result empty; a very long text is learned from and scored in batches of positions; columns other than the
named ones aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CLASSES, SIZE = 32, 64
VOCABULARY = CLASSES * SIZE
#: Outputs that words share by hash, and words known by name.
BUCKETS = 256
WORDS = VOCABULARY - BUCKETS
#: Counts of the other words, at most (16 MB), and at least; occurrences that a word out of the corpus gets.
MOST_SLOTS, LEAST_SLOTS, UNSEEN = 1 << 23, 1 << 12, 0.5
#: Other words whose shares tasks know, at most; rarer ones are joined.
NAMED = 200_000
#: Where a known word's place lies in its number, above its slot.
_KNOWN = 24
#: Parts in which the counts are sent on.
RANGES = 64
#: Other words whose hashes a task remembers before it forgets them all.
REMEMBERED = 200_000
WIDTH, HIDDEN, REACH = 8, 24, 2
ROUNDS = 1
BATCH = 8192
RATE = 0.2
#: Sets of parameters that the driver gets in a round.
GROUPS = 16
LONGEST = 64
#: Positions that are scored at once.
BLOCK = 1 << 13
#: Bytes of text whose words a task counts at once.
COUNTED = 1 << 25
#: Scores whose exponentials a float holds as they are.
NEAR = 40

PAD = VOCABULARY
_SHAPES = {
    "e": (VOCABULARY + 1, WIDTH), "w": (2 * REACH * WIDTH, HIDDEN), "b": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
    "wo": (CLASSES, HIDDEN, SIZE), "bo": (CLASSES, SIZE),
}


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def split(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as ``words_of`` has them, one after the other, and the number of words of each text."""
    own = [t.lower().strip() if t else b"" for t in texts]
    sizes = np.array([bool(t) for t in own], dtype=np.int64)
    found = compute.ascii_split_whitespace(pa.array([t for t in own if t], pa.large_binary()).view(pa.large_string()))
    sizes[sizes > 0] = np.asarray(compute.list_value_length(found))
    return found.flatten().view(pa.large_binary()), sizes


def key_of(word: bytes) -> bytes:
    """The word, or a blank and its digest if it is long; no word has a blank."""
    return word if len(word) <= LONGEST else b" " + sha256(word).digest()


def keys_of(words: pa.Array) -> pa.Array:
    if not len(words) or compute.max(compute.binary_length(words)).as_py() <= LONGEST:
        return words.cast(pa.binary())
    return pa.array([key_of(w) for w in words.to_pylist()], pa.binary())


@dataclass
class Network:
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        scale = {"e": 0.3, "w": 0.2, "wc": 0.1, "wo": 0.1}
        return Network({k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in _SHAPES.items()})

    def pack(self) -> bytes:
        return b"".join(self.p[k].astype(np.float32).tobytes() for k in _SHAPES)

    @staticmethod
    def unpack(raw: np.ndarray) -> Network:
        out, at = {}, 0
        for k, s in _SHAPES.items():
            n = int(np.prod(s))
            out[k] = raw[at : at + n].astype(np.float32).reshape(s)
            at += n
        return Network(out)

    def _forward(self, around: np.ndarray, target: np.ndarray, learning: bool = True):
        """Activations with positions side by side, in order of their classes, so that a class is one slice."""
        p = self.p
        order = np.argsort((target // SIZE).astype(np.uint8), kind="stable")
        around, target = around[order], target[order]
        c, s = target // SIZE, target % SIZE
        edges = np.searchsorted(c, np.arange(CLASSES + 1))
        x = p["e"][around].reshape(len(around), -1).T
        h = np.tanh(p["w"].T @ x + p["b"][:, None])
        rows = np.arange(len(target))
        # No activation is beyond 1, so the weights tell how large a score can be.
        far = [not (np.abs(p[w]).sum(axis=-2) + np.abs(p[b])).max() <= NEAR for w, b in (("wc", "bc"), ("wo", "bo"))]
        pc, log_p = _softmax(p["wc"].T @ h + p["bc"][:, None], c, rows, far[0], learning)
        parts = []
        for k in range(CLASSES):
            own = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                po, more = _softmax(p["wo"][k].T @ h[:, own] + p["bo"][k][:, None], s[own], rows[: edges[k + 1] - edges[k]], far[1], learning)
                log_p[own] += more
                parts.append((k, own, po))
        return order, around, x, h, c, s, pc, parts, log_p

    def log_p(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, *_, found = self._forward(around, target, learning=False)
        out = np.empty(len(target))
        out[order] = found
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, seen: dict[str, np.ndarray]) -> None:
        """One step of AdaGrad on a batch; ``seen`` has the summed squares of the gradients."""
        p = self.p
        _, around, x, h, c, s, pc, parts, _ = self._forward(around, target)
        n = len(target)
        rows = np.arange(n)
        pc[c, rows] -= 1
        pc /= n
        g = {"wc": h @ pc.T, "bc": pc.sum(axis=1), "wo": np.zeros_like(p["wo"]), "bo": np.zeros_like(p["bo"])}
        dh = p["wc"] @ pc
        for k, own, d in parts:
            d[s[own], rows[: d.shape[1]]] -= 1
            d /= n
            g["wo"][k] = h[:, own] @ d.T
            g["bo"][k] = d.sum(axis=1)
            dh[:, own] += p["wo"][k] @ d
        dh *= 1 - h * h
        g["w"], g["b"] = x @ dh.T, dh.sum(axis=1)
        dx = p["w"] @ dh
        g["e"] = np.zeros_like(p["e"])
        for k in range(len(dx)):
            g["e"][:, k % WIDTH] += np.bincount(around[:, k // WIDTH], weights=dx[k], minlength=VOCABULARY + 1)
        for k, d in g.items():
            seen[k] += d * d
            p[k] -= RATE * d / np.sqrt(seen[k] + 1e-8)


def _softmax(z: np.ndarray, target: np.ndarray, rows: np.ndarray, far: bool = True, learning: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each column of scores (if ``learning``), and the target's log-probability. Scores that aren't ``far`` are within ``NEAR``."""
    if far:
        z -= z.max(axis=0)
    log_p = z[target, rows]
    np.exp(z, out=z)
    total = np.ones(len(z), dtype=z.dtype) @ z
    if learning:
        z /= total
    return z, log_p - np.log(total)


@dataclass
class Words:
    """The corpus's vocabulary: ids of the frequent words; for the others, log P(word | output) by slot, log P of a word out of the
    corpus by output, and what more known words have; ``rest``: the words that aren't known (word, more).
    """

    names: dict[bytes, int]
    slots: np.ndarray
    unseen: np.ndarray
    known: dict[bytes, float] = field(default_factory=dict)
    rest: DataFrame | None = None

    def slot(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(key_of(word), seed=42) & (len(self.slots) - 1)

    def numbers(self) -> _Numbers:
        return _Numbers(self)


class _Numbers(dict):
    """Words' numbers: below 0 those of frequent words, else slots, below the places of known words (from 1) in ``more``; slots are
    worked out once and remembered.
    """

    def __init__(self, words: Words):
        self.words = words
        self.more = np.array([0.0, *words.known.values()])
        super().__init__((w, -1 - i) for w, i in words.names.items())
        self.update((w, words.slot(w) + (k << _KNOWN)) for k, w in enumerate(words.known, 1))
        self.least = len(self)

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONGEST:
            key = key_of(word)
            return self[key] if key in self else self.words.slot(word)
        self[word] = n = self.words.slot(word)
        return n

    def thinned(self) -> _Numbers:
        """These, or fresh ones in place of too many."""
        return self if len(self) <= self.least + REMEMBERED else _Numbers(self.words)


def ids_of(texts: list[bytes | None], numbers: _Numbers, said: list[pa.Array] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words with padding around each text; the places of the words; the number of words of each text; slots, or below 0. The words go to ``said``.

    Each different word is looked up once.
    """
    words, sizes = split(texts)
    if said is not None:
        said.append(words)
    coded = words.dictionary_encode()
    found = np.fromiter(map(numbers.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
    at = np.arange(len(words)) + REACH * (1 + np.repeat(np.arange(len(texts)), sizes))
    slots = np.full(len(words) + REACH * (1 + len(texts)), -1 - PAD)
    slots[at] = found[np.asarray(coded.indices)]
    ids = np.where(slots < 0, -1 - slots, WORDS + (slots & (BUCKETS - 1))).astype(np.int32)
    return ids, at, sizes, slots


def around(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([ids[at + d] for d in (*range(-REACH, 0), *range(1, REACH + 1))], axis=1)


def score(network: Network, numbers: _Numbers, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log-probability of each text, other words' shares by slots."""
    return _score(network, numbers, texts, lambda own: numbers.words.slots[own & (1 << _KNOWN) - 1])[:2]


def _score(network: Network, numbers: _Numbers, texts: list[bytes | None], share) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Also the keys of each text's words that are neither frequent nor known."""
    said: list[pa.Array] = []
    ids, at, sizes, slots = ids_of(texts, numbers, said)
    doc = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros(len(texts))
    for k in range(0, len(at), BLOCK):
        part = at[k : k + BLOCK]
        own = slots[part]
        found = network.log_p(around(ids, part), ids[part]) + np.where(own < 0, 0, share(np.maximum(own, 0)))
        out += np.bincount(doc[k : k + BLOCK], weights=found, minlength=len(texts))
    own = slots[at]
    rare = np.flatnonzero((own >= 0) & (own >> _KNOWN == 0))
    ends = np.searchsorted(rare, np.append(0, np.cumsum(sizes)))
    return sizes, out, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys_of(said[0].take(pa.array(rare))))


def shares(counts: np.ndarray) -> np.ndarray:
    """log P(slot | output): a slot's share of its output's counts; slots of one output are ``BUCKETS`` apart."""
    by = counts.reshape(-1, BUCKETS).astype(np.float64) + UNSEEN
    return np.log(by / by.sum(axis=0)).ravel().astype(np.float16)


def vocabulary(docs: DataFrame, text: str = "text") -> Words:
    """The most frequent words, ties by their bytes, and the counts of the others; counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0

        def sent() -> pa.RecordBatch:
            own = pa.chunked_array(held, pa.large_binary()).value_counts()
            return pa.RecordBatch.from_arrays([keys_of(own.field(0)), own.field(1)], names=["word", "n"])

        for _, texts in common.chunks(batches, "__text"):
            held.append(split(texts)[0])
            size += sum(len(t) for t in texts if t)
            if size > COUNTED:
                yield sent()
                held, size = [], 0
        yield sent()

    counts = docs.select(F.col(text).alias("__text")).mapInArrow(run, "word binary, n long")
    counts = common.written(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    short = ~F.startswith("word", F.lit(b" "))
    names = {bytes(r.word): k for k, r in enumerate(counts.where(short).orderBy(F.desc("n"), "word").limit(WORDS).collect())}
    many = counts.count()
    size = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (2 * many - 1).bit_length() if many else 0))
    each = size // RANGES
    known = docs.sparkSession.createDataFrame([(bytearray(w),) for w in names], "word binary")
    others = counts.join(F.broadcast(known), "word", "left_anti")
    slots = others.groupBy(F.xxhash64("word").bitwiseAND(F.lit(size - 1)).alias("slot")).agg(F.sum("n").alias("n"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            slot, n = np.asarray(b.column(0)), np.asarray(b.column(1))
            for r in np.unique(slot // each).tolist():
                own = slot // each == r
                held.setdefault(r, np.zeros(each, dtype=np.float32))[slot[own] - r * each] = n[own]
        for r, x in held.items():
            yield pa.RecordBatch.from_pydict({"part": [r], "counts": [x.tobytes()]})

    ranged = slots.repartition(RANGES, F.floor(F.col("slot") / each)).mapInArrow(dense, "part long, counts binary")
    found = np.zeros(size, dtype=np.float32)
    for r in ranged.collect():  # ``RANGES`` rows, 32 MB at most
        found[r.part * each : (r.part + 1) * each] = np.frombuffer(r.counts, dtype=np.float32)
    # Counts that at most ``NAMED`` words reach tell which are known.
    levels = sorted(others.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
    reached = np.cumsum([r.words for r in levels])
    left = int(np.searchsorted(reached, NAMED, side="right"))
    more = others.select("word", "n", F.log((F.col("n") + UNSEEN) / UNSEEN).alias("more"))
    rest = more.where(F.col("n") <= levels[left].n).select("word", "more") if left < len(levels) else None
    top = (more.where(F.col("n") > levels[left].n) if rest is not None else more).select("word", "more").toArrow()
    known = dict(zip(top.column("word").to_pylist(), top.column("more").to_pylist(), strict=True))
    # An output's words have their counts and ``UNSEEN`` each; words out of the corpus have the slots that are empty.
    total = UNSEEN * (found.reshape(-1, BUCKETS) == 0).sum(axis=0)
    output = F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1))
    for r in others.groupBy(output.alias("output")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        total[r.output] += r.n + UNSEEN * r.words
    return Words(names, shares(found), np.log(UNSEEN / np.maximum(total, UNSEEN)), known, rest)


def share(at: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The positions that a round learns from; each belongs to one round."""
    return at[turn % rounds :: rounds]


def _round(docs: DataFrame, text: str, network: Network, words: Words, turn: int = 0, rounds: int = 1) -> Network:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((network.p, replace(words, rest=None, known={})))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        params, known = sent.value
        own = Network({k: v.copy() for k, v in params.items()})
        seen = {k: np.full_like(v, 1e-3) for k, v in own.p.items()}
        weight, numbers = 0, known.numbers()
        for _, texts in common.chunks(batches, "__text"):
            numbers = numbers.thinned()
            ids, at, _, _ = ids_of(texts, numbers)
            at = share(at, turn, rounds)
            for k in range(0, len(at), BATCH):
                part = at[k : k + BATCH]
                own.learn(around(ids, part), ids[part], seen)
                weight += len(part)
        if weight:
            who = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_pydict({"grp": [who], "weight": [float(weight)], "p": [own.pack()]})

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k in range(len(b)):
                w = b.column(1)[k].as_py()
                p = np.frombuffer(b.column(2)[k].as_py(), dtype=np.float32).astype(np.float64) * w
                own = sums.setdefault(b.column(0)[k].as_py(), [0.0, 0.0])
                own[0] += w
                own[1] = own[1] + p
        for g, (w, p) in sums.items():
            yield pa.RecordBatch.from_pydict({"grp": [g], "weight": [w], "p": [(p / w).astype(np.float32).tobytes()]})

    trained = docs.select(F.col(text).alias("__text")).mapInArrow(local, "grp long, weight double, p binary")
    parts = trained.repartition(GROUPS, "grp").mapInArrow(mean, "grp long, weight double, p binary").collect()
    if not parts:
        return network
    total = sum(r.weight for r in parts)
    return Network.unpack(sum(np.frombuffer(r.p, dtype=np.float32).astype(np.float64) * (r.weight / total) for r in sorted(parts, key=lambda r: r.grp)))


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Network, Words]:
    """The network and vocabulary of a corpus."""
    common.ship(docs.sparkSession)
    words, network = vocabulary(docs, text), Network.fresh()
    for turn in range(rounds):
        network = _round(docs, text, network, words, turn, rounds)
    return network, words


def score_rows(docs: DataFrame, network: Network, words: Words, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, logprob and mean_logprob of every row; one pass, and a join of the rare words' occurrences."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast((network.p, replace(words, rest=None)))
    column, row, rest, more = (common.free(n, keep) for n in ("__text", "__row", "__rest", "__more"))
    source = docs.select(*keep, F.col(text).alias(column))
    out = T.StructType([
        *docs.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("logprob", T.DoubleType()),
        T.StructField(row, T.LongType()), T.StructField(rest, T.ArrayType(T.BinaryType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, numbers = Network(sent.value[0]), sent.value[1].numbers()
        place = TaskContext.get().partitionId() << 33
        for rows, texts in common.chunks(batches, column):
            numbers = numbers.thinned()
            # Words that aren't known count as out of the corpus here; the join adds what they have more.
            n, total, rare = _score(own, numbers, texts, lambda s, k=numbers: k.words.unseen[s & BUCKETS - 1] + k.more[s >> _KNOWN])
            at = pa.array(np.arange(place, place + len(n)))
            place += len(n)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(n, pa.int64()), pa.array(total), at, rare], names=out.names)

    made = source.mapInArrow(run, out)
    if words.rest is not None:
        made = common.written(made, "scored")
        rare = made.select(row, F.explode(rest).alias("word")).join(words.rest, "word").groupBy(row).agg(F.sum("more").alias(more))
        made = made.drop(rest).join(rare, row, "left").withColumn("logprob", F.col("logprob") + F.coalesce(more, F.lit(0.0)))
    return made.select(*keep, "n_tokens", "logprob", F.when(F.col("n_tokens") > 0, F.col("logprob") / F.col("n_tokens")).alias("mean_logprob"))


def scores(docs: DataFrame) -> DataFrame:
    """Pseudo-log-likelihood of every document under the network of its own corpus."""
    return score_rows(docs, *fit(docs))
