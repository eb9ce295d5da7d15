"""Benchmark decontamination: an FM-index per shard of documents, searched backward for the benchmark's windows.

A shard is a chunk of documents inside a task. Its words are numbered by the benchmark's vocabulary; a word outside it
ends a run, and runs shorter than the shortest window hold no occurrence, so only the other runs are indexed: this
changes no result. Each window's suffix range gives its occurrences, located through sampled suffix positions; their
spans are merged per document. Nothing is shuffled.

The benchmark's windows are sent to the executors in blocks of at most ``BLOCK_BYTES`` of benchmark text; more blocks
mean more passes within the same tasks, so that memory doesn't grow with the benchmark.

Defined cases: null texts have no words; items without words have no window; repeated item texts count as items each;
a null item_id is left out of the listed ids (so n_items doesn't count it) but its windows hit; repeated documents are
judged row by row; an empty table gives an empty table, an empty benchmark hits nothing; a very long text is a shard of
its own; columns other than the named ones aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .fmindex import FMIndex

#: Words of a window.
WINDOW = 10
#: Benchmark text that is sent to the executors at once.
BLOCK_BYTES = 16 << 20
#: Text of an index shard.
SHARD_BYTES = 8 << 20
#: Patterns that search at once, and occurrences that are located at once.
BATCH = 1 << 16

#: Bytes of words: digits, letters in lower case, all of UTF-8 beyond ASCII; the rest parts words.
_WORDS = bytes((c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20) for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class Windows:
    """The windows of a block of items: distinct patterns, and the items of each."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        owners: list[tuple[int, int]] = []
        self.names: list[str | None] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode() if text else None)]
            for i in range(max(0, len(ids) - window) + 1 if ids else 0):
                p = tuple(ids[i : i + window])
                owners.append((number.setdefault(p, len(number)), len(self.names)))
            self.names.append(None if item is None else str(item))
        self.lengths = np.array([len(p) for p in number], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if len(number) else 0
        self.patterns = np.zeros((len(number), window), dtype=np.int64)
        for k, p in enumerate(number):
            self.patterns[k, window - len(p) :] = p
        pairs = np.array(sorted(set(owners)), dtype=np.int64).reshape(-1, 2)
        self.owner = pairs[:, 1]
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(number) + 1))

    def hits(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each text: the number of words, the merged hit spans (rows [start, end) in words), the indices of its items."""
        get = self.vocabulary.get
        sizes = np.zeros(len(texts), dtype=np.int64)
        flat = []
        for k, t in enumerate(texts):
            own = words_of(t)
            sizes[k] = len(own)
            flat += [get(w, 0) for w in own]
            flat.append(0)  # no window crosses the border of two texts
        ids = np.array(flat, dtype=np.int64)
        none: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)] * len(texts)
        nobody: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
        if not len(self.lengths):
            return sizes, none, nobody
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        run = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
        begin, end = np.flatnonzero(run == 1), np.flatnonzero(run == -1)
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return sizes, none, nobody
        span = end - begin + 1  # each with the 0 that ends it
        place = np.repeat(begin - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        index = FMIndex(ids[place], len(self.vocabulary))
        found_at, found_by = [], []
        for k in range(0, len(self.lengths), BATCH):
            low, high = index.search(self.patterns[k : k + BATCH])
            some = np.flatnonzero(high > low)
            many = (high - low)[some]
            rows = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[some], many)
            for j in range(0, len(rows), BATCH):
                found_at.append(place[index.locate(rows[j : j + BATCH])])
            found_by.append(np.repeat(some + k, many))
        if not found_at:
            return sizes, none, nobody
        at, by = np.concatenate(found_at), np.concatenate(found_by)
        doc = np.searchsorted(starts, at, side="right") - 1
        spans, items = list(none), list(nobody)
        order = np.lexsort((at, doc))
        at, by, doc = at[order], by[order], doc[order]
        edge = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            d = doc[a]
            first = at[a:b] - starts[d]
            spans[d] = merged(np.stack([first, first + self.lengths[by[a:b]]], axis=1))
            mine = np.unique(by[a:b])
            items[d] = np.unique(np.concatenate([self.owner[self.owner_start[p] : self.owner_start[p + 1]] for p in mine]))
        return sizes, spans, items


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans as one, by start."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    start = np.flatnonzero(new)
    return np.stack([spans[start, 0], reach[np.append(start[1:], len(spans)) - 1]], axis=1)


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    """The benchmark in parts of about ``BLOCK_BYTES`` each."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
    return [items] if n <= 1 else [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _found(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], text: str, item: str, item_text: str, window: int, out: T.StructType, made: Callable) -> DataFrame:
    """What ``made`` gives for each chunk: from its rows, texts, numbers of words, spans (merged) and names of items."""
    spark = docs.sparkSession
    common.ship(spark)
    held = []
    for block in _blocks(benchmark, item, item_text):
        rows = [(r.item, r.text) for r in block.collect()]
        held.append(spark.sparkContext.broadcast(rows))
    column = text if text in keep else common.free("__text", keep)  # a text that is kept travels once
    source = docs.select(*keep) if column == text else docs.select(*keep, F.col(text).alias(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = [Windows(b.value, window) for b in held] if len(held) == 1 else None
        for rows, texts in common.chunks(batches, column, SHARD_BYTES):
            sizes, spans = None, [[] for _ in texts]
            names: list[set[str]] = [set() for _ in texts]
            for w in windows or (Windows(b.value, window) for b in held):
                sizes, own, items = w.hits(texts)
                for k in range(len(texts)):
                    if len(own[k]):
                        spans[k].append(own[k])
                        names[k].update(w.names[i] for i in items[k] if w.names[i] is not None)
            yield made(rows, texts, sizes, [merged(np.concatenate(s)) if s else [] for s in spans], names)

    return source.mapInArrow(run, out)


def find(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``keep``, n_words, spans (array of start and end in words, merged) and item_ids (as strings, sorted) of every row."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([
        *docs.select(*keep).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ])

    def made(rows: pa.RecordBatch, texts: list, sizes: np.ndarray, spans: list, names: list[set[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*rows.columns[: len(keep)], pa.array(sizes, pa.int64()),
             pa.array([[{"start": int(a), "end": int(b)} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array([sorted(n) for n in names], pa.list_(pa.string()))],
            names=out.names,
        )

    return _found(docs, benchmark, keep, text, item, item_text, window, out, made)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document, and its spans."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return find(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans",
    )


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between those words."""
    own = text.translate(_WORDS)
    edges, at = [], 0
    for w in own.split():
        at = own.index(w, at)
        edges.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : edges[a][0]])
        at = edges[b - 1][1]
    out.append(text[at:])
    return b"".join(out)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with all columns, the benchmark's spans cut out of the text. Rows of which no word is left go."""
    own = docs.columns
    names = [f"__c{i}" for i in range(len(own))]
    plain = docs.toDF(*names)
    mine = own.index(text)

    def made(rows: pa.RecordBatch, texts: list, sizes: np.ndarray, spans: list, items: list[set[str]]) -> pa.RecordBatch:
        left = [cut(t, s) if len(s) else t for t, s in zip(texts, spans, strict=True)]
        stay = pa.array([not len(s) or bool(words_of(t)) for t, s in zip(left, spans, strict=True)])
        kind = rows.column(mine).type
        cols = [pa.array(left, pa.binary()).cast(kind) if k == mine else rows.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(cols, names=names).filter(stay)

    return _found(plain, benchmark, tuple(names), names[mine], item, item_text, window, plain.schema, made).toDF(*own)
