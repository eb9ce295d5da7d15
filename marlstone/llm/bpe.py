"""Byte-level BPE by speculation: greedy longest match proposes, vectorised pair checks verify, failing words merge exactly.

Why adjacent pairs suffice: merges run by rank, leftmost first. If every token stands for itself and no merge ever
crosses the border between two neighbours, each token is built just as it would be alone. A merge (x, y) of rank r
crosses a border when x ends the left token and y begins the right one at the time r; x lives until the merge that
takes it up in the left token, y until the one that takes it up in the right token. At equal rank the leftmost merge
comes first, so r must be below x's end but may equal y's.

Defined cases: null text is the empty text, which has no token; a special token's string in a text becomes its id;
ties, repeated rows and null ids are encoded row by row; an empty table gives an empty table; a very long text is cut into
words piece by piece; a kept column of an output's name gives way to it; columns not named in ``keep`` aren't read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The largest tokenizer file that is sent to every executor.
MAX_MODEL_BYTES = 64 << 20
#: Words, and pairs of tokens, that a task remembers before it forgets them all.
CACHE_WORDS, CACHE_PAIRS = 450_000, 300_000
#: Text of more characters is cut into words piece by piece.
LONG_TEXT = 1 << 20
#: The split pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words up to this many bytes are merged by looking at all pairs, longer ones with a heap.
SHORT_WORD = 24

NEVER = int(np.iinfo(np.int64).max)


def _alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the file: printable Latin-1 for itself, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Tables of one tokenizer file and the words encoded so far. Tokens are numbered by birth: bytes, then merges."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, alphabet = spec["model"], _alphabet()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE file without normalizer is needed")
        raw = lambda s: bytes(map(alphabet.__getitem__, s))
        vocab = {raw(k): v for k, v in model["vocab"].items() if all(c in alphabet for c in k)}
        self.own: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        names = [bytes([b]) for b in range(256)]
        left, right = list(range(256)), list(range(256))
        merges: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            x, y, made = self.own[a], self.own[b], a + b
            if made in self.own:
                raise ValueError("two merges make one token")
            merges[x, y] = self.own[made] = len(names)
            names.append(made)
            left.append(x)
            right.append(y)
        self.names = names
        self.ids = np.array([vocab[x] for x in names], dtype=np.int64)
        self.bytes_of = {int(i): x for i, x in zip(self.ids, names, strict=True)}
        self.merges = merges
        self.left, self.right = np.array(left), np.array(right)
        n = len(names)
        keys = np.fromiter((x * n + y for x, y in merges), dtype=np.int64, count=len(merges))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(merges.values(), dtype=np.int64, count=len(merges))[order]
        self.n = n
        self.pairs: dict[int, bool] = {}
        # A token that merging never yields from its own bytes may not be proposed.
        whole = np.arange(256, n)
        bad = set((whole[self._crossed(self.left[whole], self.right[whole], whole)]).tolist())
        for t in range(256, n):  # parts are older than the whole
            if left[t] in bad or right[t] in bad:
                bad.add(t)
        self.known = {x: t for x, t in self.own.items() if t not in bad}
        self.longest = max(map(len, self.known))
        self.reach: dict[bytes, int] = {}  # the longest token by its first four bytes
        for x in self.known:
            if len(x) > 3:
                self.reach[x[:4]] = max(len(x), self.reach.get(x[:4], 0))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("special tokens that take up their surroundings aren't handled")
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}  # ids as 32-bit integers

    def _crossed(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For pairs of tokens: does a merge cross their border (before the merge ``until``, if given)?"""
        x, y = x.copy(), y.copy()
        end_x = np.full(len(x), NEVER) if until is None else until.copy()
        end_y = end_x - 1 if until is not None else end_x.copy()
        out, live = np.zeros(len(x), dtype=bool), np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (self.made[at] < end_x[live]) & (self.made[at] <= end_y[live])
            out[live[hit]] = True
            go = ~hit & ((a >= 256) | (b >= 256))  # two bytes have no earlier state
            live, a, b = live[go], a[go], b[go]
            later = a > b  # undo the later birth; of equal ones the right one
            u, v = live[later], live[~later]
            end_x[u], x[u] = x[u], self.right[x[u]]
            end_y[v], y[v] = y[v], self.left[y[v]]
        return out

    def _propose(self, word: bytes) -> list[int]:
        out, at, n, known, reach = [], 0, len(word), self.known, self.reach
        if (t := known.get(word)) is not None:
            return [t]
        while at < n:
            stop = min(n, at + reach.get(word[at : at + 4], 3))
            while (t := known.get(word[at:stop])) is None:
                stop -= 1
            out.append(t)
            at = stop
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost."""
        toks, merges = list(word), self.merges
        n = len(toks)
        if n <= SHORT_WORD:
            get = merges.get
            born = [get(x, NEVER) for x in pairwise(toks)]
            while born and (made := min(born)) != NEVER:
                i = born.index(made)
                toks[i : i + 2] = [made]
                del born[i]
                if i:
                    born[i - 1] = get((toks[i - 1], made), NEVER)
                if i < len(born):
                    born[i] = get((made, toks[i + 1]), NEVER)
            return toks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := merges.get((toks[i], toks[i + 1])))]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            if toks[i] < 0 or (j := after[i]) >= n or merges.get((toks[i], toks[j])) != made:
                continue
            toks[i], toks[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get((made, toks[k]))) is not None:
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := merges.get((toks[h], made))) is not None:
                heapq.heappush(heap, (m, h))
        return [t for t in toks if t >= 0]

    def learn(self, new: list[str]) -> None:
        """Encode words that the cache lacks, all at once."""
        raws = [w.encode() for w in new]
        guesses = [self._propose(w) for w in raws]
        flat = np.fromiter(chain.from_iterable(guesses), dtype=np.int64)
        sizes = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        word = np.repeat(np.arange(len(guesses)), sizes)
        near = np.flatnonzero(word[1:] == word[:-1])
        pair, back = np.unique(flat[near] * self.n + flat[near + 1], return_inverse=True)
        memo = self.pairs
        unknown = np.array([p for p in pair.tolist() if p not in memo], dtype=np.int64)
        memo.update(zip(unknown.tolist(), self._crossed(unknown // self.n, unknown % self.n).tolist(), strict=True))
        wrong = np.fromiter(map(memo.__getitem__, pair.tolist()), dtype=bool, count=len(pair))
        cache, all_ids = self.cache, self.ids[flat].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        cache.update((w, all_ids[a:b]) for w, a, b in zip(new, [0, *ends], ends, strict=False))
        for k in np.unique(word[near[wrong[back]]]).tolist():
            cache[new[k]] = self.ids[self.merge(raws[k])].astype(np.int32).tobytes()

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.words.findall(text)
            return
        found = (m.group() for m in self.words.finditer(text))
        while part := list(islice(found, LONG_TEXT // 8)):
            yield part

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut: list[list] = []
        for text in texts:
            own: list = []
            for i, part in enumerate(self.cut.split(text) if self.cut and text else [text]):
                own += [self.special[part]] if i % 2 else [p for p in self._pieces(part)]
            cut.append(own)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        new = set()
        for own in cut:
            for p in own:
                if not isinstance(p, int):
                    new.update(p)
        if new := [w for w in new if w not in self.cache]:
            self.learn(new)
        get = self.cache.__getitem__
        each = lambda own: chain.from_iterable([p.to_bytes(4, "little")] if isinstance(p, int) else map(get, p) for p in own)
        return [np.frombuffer(b"".join(each(own)), dtype="<i4") for own in cut]

    def forget(self) -> None:
        """Let go what was learned from texts; a worker outlives its task."""
        self.cache, self.pairs = {}, {}

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(broadcast) -> Encoder:
    """One encoder a worker; the worker outlives its tasks."""
    blob = broadcast.value
    key = hash(blob)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(blob)
    return _encoders[key]


def model_broadcast(spark, path: str):
    """The tokenizer file, read on the driver; its size is checked."""
    with open(path, "rb") as f:
        blob = f.read(MAX_MODEL_BYTES + 1)
    if len(blob) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(blob)


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in {x.name for x in fields}] + list(fields))


def _encoded(df: DataFrame, tokenizer: str, text: str, keep: tuple[str, ...], made: tuple[str, ...]) -> DataFrame:
    """``keep`` and, by the names of ``made``, the ids of every row's text and, if it has a second name, what they decode to."""
    common.ship(df.sparkSession)
    model = model_broadcast(df.sparkSession, tokenizer)
    column = text if text in keep else common.free("__text", keep)  # a text that is kept travels once
    source = df.select(*keep) if column == text else df.select(*keep, F.col(text).alias(column))
    fields = (T.StructField(made[0], T.ArrayType(T.IntegerType(), False), False), *(T.StructField(n, T.StringType(), False) for n in made[1:]))
    out = _with(df.select(*keep).schema, *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for rows, texts in common.chunks(batches, column):
            ids = encoder.encode([(t or b"").decode() for t in texts])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            cols = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))]
            cols += [pa.array(map(encoder.decode, ids), pa.string()) for _ in made[1:]]
            yield pa.RecordBatch.from_arrays([rows.column(i) for i, n in enumerate(keep) if n not in made] + cols, names=out.names)
        encoder.forget()

    return source.mapInArrow(run, out)


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` and ``ids`` (array of int) of every row; no shuffle, one pass."""
    return _encoded(df, tokenizer, text, keep, (ids,))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "decoded") -> DataFrame:
    """``keep`` and the text of ``ids``; null ids give the empty text."""
    common.ship(df.sparkSession)
    model = model_broadcast(df.sparkSession, tokenizer)
    source = df.select(*keep, F.col(ids).alias(common.free("__ids", keep)))
    out = _with(df.select(*keep).schema, T.StructField(text, T.StringType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for rows in batches:
            lists = rows.column(len(keep))
            for start in range(0, len(rows), 256):
                made = [encoder.decode(np.asarray(v.values)) if v.is_valid else "" for v in lists[start : start + 256]]
                part = rows.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(i) for i, n in enumerate(keep) if n != text] + [pa.array(made, pa.string())], names=out.names)

    return source.mapInArrow(run, out)


def roundtrip(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids and the text decoded from them; both in one pass, so that a task needs one worker and one set of tables."""
    return _encoded(df, tokenizer, text, keep, ("ids", "decoded"))


def digests(df: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return roundtrip(df, tokenizer).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
