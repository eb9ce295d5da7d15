"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees of fingerprint shards.

Two fingerprints that differ in at most r bits agree on all but r of m bit blocks. So for each choice of m - r blocks the
distinct fingerprints are dealt by those bits; each shard gets a BK-tree and is searched along edges within the radius.
Any m finds every link; ``BLOCKS`` keeps shards of random fingerprints small up to some 10^10 of them. A shard of more than ``SHARD``
fingerprints is split, and each part's tree meets each part's queries in a cell of its own. A cell sends on a spanning
forest of its links, never all pairs: components need no more. Equal fingerprints are one node from the start.

``similar`` is the form for a Jaccard similarity of shingle sets. Nodes are distinct sets of shingles. First the BK-trees link their
fingerprints within ``NEAR`` bits; the sets of each such link, and of equal fingerprints, are compared, which an equal phrase
in unlike texts doesn't stand. Similar sets may differ in more bits than a tree can prune, so the rest is found exactly, among
sets that the trees haven't joined. In one order of all
shingles a set's prefix is so long that two sets of the similarity must share a shingle of their prefixes; so every shingle
has a list of sets, and candidates share a list. Every set of a list meets the list's first one: that many pairs a list
row, not a square. What their comparison links is labelled; then the sets of a list meet all others of it that have another
label, in cells like those above, where sizes, positions and sketches rule out, for sure, pairs that can't be similar, before
they are told; at first a cell tells a spanning forest of the rest only, by the sketches' likeness, and after another
labelling all that still have different labels. Whole sets are compared for every pair that is told. The order (common
shingles last, as a sample shows them) changes the number of candidates only.

Defined cases: a null or wordless text has fingerprint 0 and is linked like any other; fewer words than a shingle make
one shingle; repeated rows give repeated result rows; a null doc_id is never the smallest unless all of a component are
null; an empty table gives an empty table; a very long text is laid out in bits piece by piece, or, in the exact form,
compared as one set of hashes; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bktree import Forest, join_labels
from .components import components

#: Fingerprints of a shard's tree, at most.
SHARD = 4096
#: Bit blocks: 35 choices of three, with 27 bits each.
BLOCKS = 7
#: Large shards that are told to all tasks at once; beyond, they are joined.
BROADCAST_ROWS = 100_000
#: Hashes whose bits are laid out at once.
BITS_AT_ONCE = 1 << 14
#: The form by similarity: differing bits within which trees link, and the blocks for that (28 choices of two, with 16 bits each).
NEAR, NEAR_BLOCKS = 6, 8
#: Documents that show which shingles are common, such shingles at most, sets of a list that meet in one step.
SAMPLE, COMMON, MEET = 8_000, 100_000, 64
#: Bits of a sketch, at least; a brief one has just so many.
LEAST_BITS = 512
#: Candidates that a task holds before it thins them.
AT_ONCE = 1_000_000
#: Slack for rounding in bounds of the candidates; the comparison itself has none.
ROUNDING = 1e-6
#: Rows that a task gets in the search, about.
TASK_ROWS = 200_000


def hashes_of(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of the shingles, repeats included; none for a text without words."""
    own = text.lower().split() if text else []
    if not own:
        return np.zeros(0, dtype=np.uint64)
    made = [b" ".join(own)] if len(own) <= words else map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False))
    return np.fromiter(map(_digest, made), dtype=np.uint64)


_digest = partial(xxhash.xxh64_intdigest, seed=42)


def prefix(hashes: np.ndarray, similarity: float, common_: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first of a set's hashes (distinct, sorted) that a similar set can't do without, in order of rank and hash."""
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - ROUNDING)) + 1
    if not len(hashes) or not len(common_):
        return hashes[:n]
    at = np.minimum(np.searchsorted(common_, hashes), len(common_) - 1)
    return hashes[np.lexsort((hashes, np.where(common_[at] == hashes, ranks[at], 0)))[:n]]


def may_be_similar(size_a, pos_a, size_b, pos_b, similarity: float) -> np.ndarray:
    """Whether sets with a shingle in common at these positions can share enough of them."""
    most = np.minimum(pos_a, pos_b) + np.minimum(size_a - pos_a, size_b - pos_b)
    return most >= similarity / (1 + similarity) * (size_a + size_b) - ROUNDING


def sketch(hashes: np.ndarray) -> bytes:
    """For each value of the lowest bits, whether the number of hashes is odd; at least a bit for each hash."""
    bits = max(LEAST_BITS, 1 << max(0, len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def brief(sketch_: bytes) -> bytes:
    """The sketch of the fewest bits, from a larger one."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch_, dtype=np.uint8).reshape(-1, LEAST_BITS // 8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of hashes that one of two sets has, from their sketches."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    n = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n)) ^ np.bitwise_xor.reduce(y.reshape(-1, n))).sum())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets, distinct and sorted."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_of(texts: list[bytes | None], words: int) -> np.ndarray:
    """Fingerprints of texts in UTF-8."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for k, t in enumerate(texts):
        out[k] = fingerprint(hashes_of(t, words))
    return out


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """Each bit by the majority of the hashes' bits; 0 for no hash."""
    if not len(hashes):
        return np.uint64(0)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), BITS_AT_ONCE):
        bits = np.unpackbits(hashes[a : a + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(df: DataFrame, text: str = "text", words: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (the fingerprint's bits as a long) of every row; one pass, no shuffle."""
    common.ship(df.sparkSession)
    column = common.free("__text", keep)
    source = df.select(*keep, F.col(text).alias(column))
    out = T.StructType([*df.select(*keep).schema.fields, T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.chunks(batches, column):
            fp = fingerprint_of(texts, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(fp)], names=out.names)

    return source.mapInArrow(run, out)


def masks(radius: int, blocks: int = BLOCKS, bits: int = 64) -> list[int]:
    """Bit masks such that fingerprints within the radius agree under one of them at least."""
    edge = [round(i * bits / blocks) for i in range(blocks + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(block, blocks - radius)]


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links in the cells of a task. Rows: choice, shard, part, other, in_tree, asks, fp."""
    got = [b for b in batches if len(b)]
    if not got:
        return
    rows = pa.Table.from_batches(got)
    col = {n: np.asarray(rows.column(n)) for n in ("choice", "shard", "part", "other", "fp")}
    tree, asks = (np.asarray(rows.column(n).combine_chunks().cast(pa.uint8())).astype(bool) for n in ("in_tree", "asks"))
    fp = col["fp"].view(np.uint64)
    order = np.lexsort((fp, col["other"], col["part"], col["shard"], col["choice"]))
    fp, tree, asks = fp[order], tree[order], asks[order]
    new = np.zeros(len(fp), dtype=bool)
    new[0] = True
    for n in ("choice", "shard", "part", "other"):
        x = col[n][order]
        new[1:] |= x[1:] != x[:-1]
    cell = np.cumsum(new) - 1
    node, query = np.flatnonzero(tree), np.flatnonzero(asks)
    forest = Forest(cell[node], fp[node])
    label = np.arange(len(fp))
    for q, t in forest.near(cell[query], fp[query], radius):
        label = join_labels(label, query[q], node[t])
    linked = np.flatnonzero(label != np.arange(len(fp)))
    if len(linked):
        signed = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[label[linked]])], names=["a", "b"])


def links(distinct: DataFrame, radius: int = 4, shard: int = SHARD, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that connect just what fingerprints (``fp``, distinct) within the radius connect."""
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius, blocks)])).alias("choice", "shard"))
    return _linked(dealt, distinct.count() * math.comb(blocks, radius), partial(_search, radius=radius), shard)


def _linked(dealt: DataFrame, rows: int, search, shard: int) -> DataFrame:
    """The search over dealt rows (choice, shard, fp and what else it needs), large shards in cells."""
    spark = dealt.sparkSession
    common.ship(spark)
    more = [c for c in dealt.columns if c not in ("choice", "shard")]
    large = common.written(dealt.groupBy("choice", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard), "large")
    many = large.agg(F.count(F.lit(1)).alias("shards"), F.sum(F.col("n") * (F.ceil(F.col("n") / shard) - 1)).alias("again")).first()
    # Rarely more than a few shards are large; then nothing is shuffled to tell them.
    large = F.broadcast(large) if many.shards <= BROADCAST_ROWS else large
    dealt = dealt.join(large, ["choice", "shard"], "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / shard).cast("int"))
    cells = (
        dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "choice", "shard", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"),
            (F.col("own") >= F.col("with")).alias("in_tree"), (F.col("own") <= F.col("with")).alias("asks"), *more,
        )
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((rows + (many.again or 0)) / TASK_ROWS))
    return cells.repartition(parts, "choice", "shard", "part", "other").mapInArrow(search, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row."""
    docs = common.written(fingerprints(df, text, words), "fingerprints")
    nodes = common.written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    return _named(docs, nodes, components(links(nodes.select("fp"), radius)))


def _met(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows of lists (key, node, size, pos) in order of key and node: candidates (a, b) of each row with its list's first, and the rows
    of lists of three or more, with their key. A batch at a time: a list of any length needs no more memory.
    """
    names = ("key", "node", "size", "pos")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def told(key, a, b, size, pos) -> pa.RecordBatch:
        n = len(a)
        cols = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip((key, a, b, size, pos), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=["key", "a", "b", "size", "pos"])

    held: dict[str, np.ndarray] = {}  # the last list's first two rows, with their places
    for batch in batches:
        if not len(batch):
            continue
        col = {n: np.asarray(batch.column(k)) for k, n in enumerate(names)}
        known = len(held["place"]) if held else 0
        both = {n: np.concatenate([held[n], c]) if held else c for n, c in col.items()}
        n = known + len(batch)
        start = np.flatnonzero(np.append(True, both["key"][1:] != both["key"][:-1]))
        begin = np.repeat(start, np.diff(np.append(start, n)))
        place = np.arange(n) - begin
        if known:
            more = (begin == 0) & (np.arange(n) >= known)
            place[more] = held["seen"][0] + np.arange(int(more.sum()))
        fresh = np.arange(n) >= known
        b = np.flatnonzero(fresh & (place > 0))
        a = begin[b]
        ok = may_be_similar(both["size"][a], both["pos"][a], both["size"][b], both["pos"][b], similarity)
        pairs = np.unique(np.stack([both["node"][a[ok]], both["node"][b[ok]]], axis=1), axis=0)
        if len(pairs):
            yield told(None, pairs[:, 0].copy(), pairs[:, 1].copy(), None, None)
        third = np.flatnonzero(fresh & (place == 2))
        crowd = np.sort(np.concatenate([begin[third], begin[third] + 1, np.flatnonzero(fresh & (place >= 2))]))
        if len(crowd):
            yield told(both["key"][crowd], both["node"][crowd], None, both["size"][crowd], both["pos"][crowd])
        last = begin[-1]
        keep = np.arange(last, min(last + 2, n)) if last or not known else np.arange(0, min(2, n))
        held = {name: c[keep] for name, c in both.items()} | {"place": place[keep], "seen": np.array([place[-1] + 1])}


def spanning(group: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The edges a-b of a lightest spanning forest over groups of nodes: in each step every group's lightest edge out of it."""
    chosen, left = [], np.arange(len(a))
    while True:
        x, y = group[a[left]], group[b[left]]
        left = left[x != y]
        if not len(left):
            return np.unique(np.concatenate(chosen)) if chosen else left
        x, y = group[a[left]], group[b[left]]
        order = np.lexsort((left, weight[left]))  # ties by place: two groups never pick edges that close a ring
        both = np.concatenate([x[order], y[order]])
        rank = np.concatenate([order, order])
        by = np.argsort(np.concatenate([np.arange(len(order))] * 2), kind="stable")
        _, first = np.unique(both[by], return_index=True)
        picked = left[np.unique(rank[by][first])]
        chosen.append(picked)
        label = join_labels(np.arange(int(group.max()) + 1), group[a[picked]], group[b[picked]])
        group = label[group]


def _across(batches: Iterator[pa.RecordBatch], similarity: float, forest: bool) -> Iterator[pa.RecordBatch]:
    """Candidates in the cells of a task whose labels differ; all, or a spanning forest of them in each cell.

    Rows: shard, part, other, in_tree, asks, fp (the node), size, pos, label and brief.
    """
    got = [b for b in batches if len(b)]
    if not got:
        return
    rows = pa.Table.from_batches(got)
    del got
    col = {n: np.asarray(rows.column(n)) for n in ("shard", "part", "other", "fp", "size", "pos", "label")}
    tree, asks = (np.asarray(rows.column(n).combine_chunks().cast(pa.uint8())).astype(bool) for n in ("in_tree", "asks"))
    bits = np.frombuffer(b"".join(rows.column("brief").to_pylist()), dtype=np.uint64).reshape(len(rows), -1)
    order = np.lexsort((col["other"], col["part"], col["shard"]))
    col, tree, asks, bits = {n: x[order] for n, x in col.items()}, tree[order], asks[order], bits[order]
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for n in ("shard", "part", "other"):
        new[1:] |= col[n][1:] != col[n][:-1]
    edge = np.append(np.flatnonzero(new), len(order))
    many = np.diff(edge)
    node, size, pos, label = (col[n] for n in ("fp", "size", "pos", "label"))

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        ok = (label[a] != label[b]) & may_be_similar(size[a], pos[a], size[b], pos[b], similarity)
        a, b = a[ok], b[ok]
        least = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1)
        most = (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + ROUNDING
        ok = least <= most
        return a[ok], b[ok], least[ok] / most[ok]

    def told(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1), axis=0)
        for k in range(0, len(pairs), 1 << 16):
            part = pairs[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["a", "b"])

    def thinned(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for x in found:
            if not forest:
                yield from told(*x[:2])
                continue
            held.append(x)
            if sum(len(y[0]) for y in held) > AT_ONCE:
                held = [lightest(held)]
        if held:
            yield from told(*lightest(held)[:2])

    def lightest(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, weight = (np.concatenate(c) for c in zip(*held, strict=True))
        own = spanning(group, a, b, weight)
        return a[own], b[own], weight[own]

    cell = np.repeat(np.arange(len(many)), many)
    group = np.unique(np.stack([cell, label]), axis=1, return_inverse=True)[1].ravel()
    short = np.flatnonzero((many[cell] <= MEET) & tree & asks)  # cells of one part: every row is in the tree and asks

    def by_distance() -> Iterator[tuple[np.ndarray, ...]]:
        for d in range(1, MEET):
            a, b = short[:-d], short[d:]
            same = np.flatnonzero(cell[a] == cell[b])
            if not len(same):
                return
            for k in range(0, len(same), 1 << 16):
                yield near(a[same[k : k + (1 << 16)]], b[same[k : k + (1 << 16)]])

    def by_query(low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
        t, q = (low + np.flatnonzero(x[low:high]) for x in (tree, asks))
        step = max(1, (1 << 16) // max(1, len(t)))
        for j in range(0, len(q), step):
            part = q[j : j + step]
            yield near(np.repeat(part, len(t)), np.tile(t, len(part)))

    yield from thinned(by_distance())
    for k in np.flatnonzero((many > MEET) | ~np.minimum.reduceat(tree & asks, edge[:-1])):
        yield from thinned(by_query(edge[k], edge[k + 1]))


def _by_trees(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (``node``, ``fp``) that connect what the fingerprints within ``NEAR`` bits connect, by the trees."""
    first = common.written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    equal = nodes.join(first.toDF("fp", "a"), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    found = links(first.select("fp"), NEAR, blocks=NEAR_BLOCKS).distinct().toDF("fp_a", "fp_b")
    return found.join(first.toDF("fp_a", "a"), "fp_a").join(first.toDF("fp_b", "b"), "fp_b").select("a", "b").unionByName(equal)


def _apart_by(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that the roots (node, root) don't join."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.toDF(side, f"of_{side}"), side, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _verified(pairs: DataFrame, source: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b: nodes) whose sets of shingles have the similarity; the sets come from the texts again."""
    own = nodes.select("node", "size", "sketch")
    left, right = own.toDF("a", "size_a", "x"), own.toDF("b", "size_b", "y")

    def near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (1 - similarity) / (1 + similarity) * (np.asarray(b.column(2)) + np.asarray(b.column(3))) + ROUNDING
            ok = [apart(b.column(4)[k].as_py(), b.column(5)[k].as_py()) <= most[k] for k in range(len(b))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sketched = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "x", "y")
    pairs = common.written(sketched.mapInArrow(near_enough, "a long, b long"), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = common.written(asked.join(nodes.select("node", "th"), "node"), "asked")
    texts = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    # A set that many rows have is made once.
    found = source.select(F.coalesce(F.xxhash64("__text"), F.lit(0)).alias("th"), "__text").join(texts, "th").dropDuplicates(["node"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in common.chunks(batches, "__text"):
            made = [np.unique(hashes_of(t, words)).tobytes() for t in own]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(made, pa.binary())], names=["node", "hashes"])

    held = common.written(found.select("node", "__text").mapInArrow(sets, "node long, hashes binary"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            ok = [jaccard(*(np.frombuffer(c[k].as_py(), dtype=np.uint64) for c in (x, y))) >= similarity for k in range(len(b))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = held.toDF("a", "x"), held.toDF("b", "y")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return common.written(both.mapInArrow(compare, "a long, b long"), "verified")


def common_shingles(source: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, that are in several of the sample's documents, and in how many."""
    step = max(1, source.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in common.chunks(batches, "__text"):
            flat = np.concatenate([np.unique(hashes_of(t, words)) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["h"])

    seen = source.where(F.pmod(F.xxhash64("__text"), F.lit(step)) == 0).select("__text").mapInArrow(run, "h long")
    most = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = np.asarray(most.column("h").combine_chunks()).view(np.uint64), np.asarray(most.column("n").combine_chunks())
    order = np.argsort(h)
    return h[order], n[order]


def _groups(df: DataFrame, text: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, th: hash of the text, fp, node: their set of shingles), nodes with their smallest doc_id, and the roots of linked nodes."""
    spark = df.sparkSession
    common.ship(spark)
    source = df.select("doc_id", F.col(text).alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    often, ranks = common_shingles(source, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.chunks(batches, "__text"):
            fp, node, size, keys, sketches, briefs = [], [], [], [], [], []
            for t in texts:
                hashes = np.unique(hashes_of(t, words))
                fp.append(fingerprint(hashes))
                node.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                size.append(len(hashes))
                keys.append(prefix(hashes, similarity, often, ranks))
                sketches.append(sketch(hashes))
                briefs.append(brief(sketches[-1]))
            ends = np.cumsum([0, *map(len, keys)])
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fp, node)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], *longs, pa.array(size, pa.int32()), held, pa.array(sketches, pa.binary()), pa.array(briefs, pa.binary())], names=["doc_id", "th", "fp", "node", "size", "keys", "sketch", "brief"])

    shape = f"doc_id {kind}, th long, fp long, node long, size int, keys array<long>, sketch binary, brief binary"
    hashed = source.select("doc_id", F.coalesce(F.xxhash64("__text"), F.lit(0)).alias("th"), "__text")
    docs = common.written(hashed.mapInArrow(run, shape), "signatures")
    # Documents of one set of shingles are one node.
    nodes = common.written(docs.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief")), "nodes")
    lists = nodes.select("node", "size", F.posexplode("keys").alias("pos", "key")).select("key", "node", "size", "pos")
    rows = nodes.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS / 4))
    lists = lists.repartition(parts, "key").sortWithinPartitions("key", "node")
    met = common.written(lists.mapInArrow(partial(_met, similarity=similarity), "key long, a long, b long, size int, pos int"), "met")
    found = _verified(_by_trees(nodes.select("node", "fp")), source, nodes, words, similarity)
    firsts = _apart_by(met.where("key is null").select("a", "b").distinct(), components(found))
    found = found.unionByName(_verified(firsts, source, nodes, words, similarity))
    crowd = met.where("key is not null").select(F.lit(0).alias("choice"), F.col("key").alias("shard"), F.col("a").alias("fp"), "size", "pos")
    n = crowd.count()
    for forest in (True, False) if n else ():
        roots = components(found).select(F.col("node").alias("__node"), "root")
        known = nodes.join(roots, nodes.node == roots["__node"], "left").select(F.col("node").alias("fp"), F.coalesce("root", "node").alias("label"), "brief")
        dealt = common.written(crowd.join(known, "fp"), "crowd")
        more = common.written(_linked(dealt, n, partial(_across, similarity=similarity, forest=forest), SHARD), "across")
        found = found.unionByName(_verified(more, source, nodes, words, similarity))
    return docs.select("doc_id", "th", "fp", "node"), nodes.select("node", "first"), components(found)


def similar(df: DataFrame, text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The same columns, with documents linked just from this Jaccard similarity of their shingle sets on.

    The fingerprint is that of the distinct shingles.
    """
    docs, nodes, roots = _groups(df, text, words, similarity)
    return _named(docs.drop("th"), nodes, roots, "node")


def _named(docs: DataFrame, nodes: DataFrame, roots: DataFrame, key: str = "fp") -> DataFrame:
    """Documents with the smallest doc_id of their component; ``nodes``: the key and its smallest doc_id."""
    roots = roots.toDF("__node", "root")
    rooted = nodes.join(roots, nodes[key] == roots["__node"], "left").select(key, "first", F.coalesce("root", key).alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_key = rooted.join(named, "root").select(key, "component_id")
    return docs.join(by_key, key).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(df: DataFrame, text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df``, with all columns, one of each component of ``similar``.

    It is the row with the smallest doc_id (none last), then the smallest hash of the text; of rows that agree in both, any
    one. So an id that several texts have names several documents, each judged by its text. An empty table stays empty.
    """
    plain = df.select("doc_id", F.col(text).alias("text"))
    docs, _, roots = _groups(plain, "text", words, similarity)
    roots = roots.toDF("__node", "root")
    rooted = docs.join(roots, docs.node == roots["__node"], "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f"))
    first = common.written(first.select(F.col("f.doc_id").alias("__first"), F.col("f.th").alias("__th")), "first")
    rows = df.withColumn("__th_own", F.coalesce(F.xxhash64(text), F.lit(0)))
    # A hint for one plan at every size: texts and ids meet in sorted partitions, where repeated rows lie side by side.
    named, nameless = first.where(F.col("__first").isNotNull()), first.where(F.col("__first").isNull())
    kept = rows.where(F.col("doc_id").isNotNull()).join(named.hint("merge"), (F.col("doc_id") == F.col("__first")) & (F.col("__th_own") == F.col("__th")), "left_semi")
    other = rows.where(F.col("doc_id").isNull()).join(nameless.hint("merge"), F.col("__th_own") == F.col("__th"), "left_semi")
    return kept.dropDuplicates(["doc_id", "__th_own"]).unionByName(other.dropDuplicates(["__th_own"])).drop("__th_own")
