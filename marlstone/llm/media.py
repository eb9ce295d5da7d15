"""Local image descriptors in a media column: corners at several scales, rotated binary tests, Hamming tables, geometry.

Equal media are one class from the start. Each class is decoded to grey, and at each scale of a pyramid Harris corners
that are maxima of their neighbourhood get an orientation (intensity centroid) and ``BITS`` binary tests turned by it.
A descriptor's ``TABLES`` chunks are its keys in as many tables: descriptors that differ in fewer bits than there are tables
agree on one of them, and many of those within ``RADIUS`` bits do. Descriptors that meet in a bucket are compared, and each
match votes for the turn, scale and shift that carry one image onto the other. Two images with ``VOTES`` corners that agree on
these are linked. Cropped, turned, scaled, brighter or dimmer copies keep enough corners; components of links are copy groups.
A copy is to agree in ``AGREED`` corners and a ``SHARE`` of the smaller image's: unrelated images agree in a few by chance.

The corners of a bucket come in order of their descriptors. The first ``MEET`` meet all; each further one first meets the
``NEAR`` before it, which are the likest, and the first with its very descriptor, through which a large group of copies
holds together. Then the images of all larger buckets are dealt to cells, in which every two of them that aren't connected
yet meet by all their buckets; so no pair of a bucket is left out. Plain patterns fill buckets with unrelated images, so
this grows with the square of the images that have such corners, in time and not in what is kept: a cell holds its own
corners and tells a forest of links only.

Defined cases: null, empty and undecodable media have no corners and a class by their bytes (null is a class of its own
row by row: nulls aren't copies of each other); repeated rows are copies; ties of ids are one image's; a null id is
replaced by the smallest id only where its class has one; an empty table gives an empty table; a very large image is
described by itself; columns other than the named ones aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bktree import join_labels
from .components import components
from .simhash import spanning

BITS, TABLES, RADIUS = 128, 4, 8
SCALES = 3
#: Half the side of the patch that a corner's tests look at.
REACH = 7
#: A corner's response, as a share of the image's largest.
QUALITY = 0.01
TURNS = 24
#: Corners that must agree, and the width in pixels of a bin of shifts.
VOTES, SHIFT = 4, 6
#: Copies agree in more: among very many images some pairs agree in ``VOTES`` corners by chance. Corners, and their share of the image's.
AGREED, SHARE = 6, 0.2
#: Corners of a bucket that all meet at once, and those before it that each further one meets first.
MEET, NEAR = 8, 3
#: Bits of a corner's number that go with its vote; corners that agree in them count once.
CORNER_BITS = 14
#: Images that are described at once.
TOGETHER = 256
#: Large buckets that are told to all tasks at once; beyond, they are joined.
BROADCAST_ROWS = 100_000
#: Corners of a part of the crowded images; corners of a cell's tree and meetings that are compared at once.
PART, TREE, MEETINGS = 1 << 18, 1 << 18, 1 << 16

_HEADER = re.compile(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def encode(grey: np.ndarray) -> bytes:
    """A grey image as a binary portable graymap."""
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.ascontiguousarray(grey, dtype=np.uint8).tobytes()


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey image of a binary portable graymap or pixmap; None for anything else."""
    m = _HEADER.match(raw or b"")
    if not m or int(m[4]) != 255:
        return None
    w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    if len(raw) - m.end() < w * h * depth or not w * h:
        return None
    pixels = np.frombuffer(raw, dtype=np.uint8, count=w * h * depth, offset=m.end()).astype(np.float32)
    return pixels.reshape(h, w) if depth == 1 else pixels.reshape(h, w, 3) @ np.float32([0.299, 0.587, 0.114])


def _tests() -> np.ndarray:
    """Pairs of points in a patch, turned to each orientation: (TURNS, BITS, 2 points, dy and dx)."""
    rng = np.random.default_rng(20)
    p = np.clip(rng.normal(0, REACH / 2.2, (BITS, 2, 2)), -REACH + 1, REACH - 1)
    out = np.empty((TURNS, BITS, 2, 2), dtype=np.int64)
    for k in range(TURNS):
        a = 2 * np.pi * k / TURNS
        y, x = p[..., 0], p[..., 1]
        out[k, ..., 0] = np.clip(np.rint(y * np.cos(a) + x * np.sin(a)), -REACH, REACH)
        out[k, ..., 1] = np.clip(np.rint(x * np.cos(a) - y * np.sin(a)), -REACH, REACH)
    return out


_PAIRS = _tests()
_GRID = np.mgrid[-REACH : REACH + 1, -REACH : REACH + 1].reshape(2, -1)
_GRID = _GRID[:, (_GRID**2).sum(axis=0) <= REACH * REACH]


def _smooth(x: np.ndarray) -> np.ndarray:
    """Binomial filter of five taps, both ways."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        y = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        cut = lambda k, y=y, axis=axis, n=n: np.take(y, range(k, k + n), axis=axis)
        x = (cut(0) + cut(4) + 4 * (cut(1) + cut(3)) + 6 * cut(2)) / 16
    return x


def _corners(x: np.ndarray) -> np.ndarray:
    """(image, y, x) of the corners of equal-sized images, a patch away from the border."""
    gy, gx = np.gradient(x, axis=(1, 2))
    a, b, c = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    r[:, : REACH + 1], r[:, -REACH - 1 :], r[:, :, : REACH + 1], r[:, :, -REACH - 1 :] = (0,) * 4
    best = r.copy()
    for dy in (-2, -1, 0, 1, 2):
        for dx in (-2, -1, 0, 1, 2):
            if dy or dx:
                np.maximum(best[:, 2:-2, 2:-2], r[:, 2 + dy : r.shape[1] - 2 + dy, 2 + dx : r.shape[2] - 2 + dx], out=best[:, 2:-2, 2:-2])
    floor = np.maximum(r.max(axis=(1, 2), keepdims=True) * QUALITY, 1e-6)
    return np.argwhere((r >= best) & (r > floor))


def describe(images: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Equal-sized images: image, y and x in its own pixels, scale, turn and descriptor (two 64-bit words) of each corner."""
    x = np.stack(images).astype(np.float32)
    out = []
    for scale in range(SCALES):
        if min(x.shape[1:]) < 4 * REACH:
            break
        x = _smooth(x)
        at = _corners(x)
        if len(at):
            n, cy, cx = at.T
            patch = x[n[:, None], cy[:, None] + _GRID[0], cx[:, None] + _GRID[1]]
            angle = np.arctan2(patch @ _GRID[0].astype(np.float32), patch @ _GRID[1].astype(np.float32))
            turn = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
            words = []
            for k in range(0, len(at), 8192):
                part = slice(k, k + 8192)
                p = _PAIRS[turn[part]]
                v = x[n[part, None, None], cy[part, None, None] + p[..., 0], cx[part, None, None] + p[..., 1]]
                words.append(np.packbits(v[..., 0] < v[..., 1], axis=1).view(np.int64))
            out.append((n, (cy + 0.5) * 2**scale, (cx + 0.5) * 2**scale, np.full(len(n), scale), turn, np.concatenate(words)))
        h, w = x.shape[1] // 2 * 2, x.shape[2] // 2 * 2
        x = (x[:, :h:2, :w:2] + x[:, 1:h:2, :w:2] + x[:, :h:2, 1:w:2] + x[:, 1:h:2, 1:w:2]) / 4
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5)) + (np.zeros((0, 2), dtype=np.int64),)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_CORNERS = "image long, corner int, place long, d0 long, d1 long"
#: Where a corner's numbers lie in ``place``: the first bit, the number of bits, the unit.
_PLACE = {"y": (0, 22, 4), "x": (22, 22, 4), "scale": (44, 8, 1), "turn": (52, 8, 1)}


def packed(**numbers: np.ndarray) -> np.ndarray:
    return sum(np.rint(v * _PLACE[k][2]).astype(np.int64) << _PLACE[k][0] for k, v in numbers.items())


def unpacked(place: np.ndarray, name: str) -> np.ndarray:
    first, bits, unit = _PLACE[name]
    whole = (place >> first) & ((1 << bits) - 1)
    return whole if unit == 1 else whole / unit


def corners(classes: DataFrame) -> DataFrame:
    """The corners of all media (``image`` long, ``media`` binary), a row each."""
    common.ship(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in common.chunks(batches, "media"):
            ids = np.asarray(rows.column(0))
            by: dict[tuple, list] = {}
            for k, r in enumerate(raw):
                if (grey := decode(r)) is not None:
                    by.setdefault(grey.shape, []).append((ids[k], grey))
            for shape, own in by.items():
                step = max(1, min(TOGETHER, (1 << 22) // (shape[0] * shape[1])))
                for k in range(0, len(own), step):
                    part = own[k : k + step]
                    n, y, x, scale, turn, d = describe([g for _, g in part])
                    image = np.array([i for i, _ in part])[n]
                    cols = [pa.array(image, pa.int64()), pa.array(np.arange(len(n)), pa.int32()), pa.array(packed(y=y, x=x, scale=scale, turn=turn))]
                    cols += [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())]
                    yield pa.RecordBatch.from_arrays(cols, names=["image", "corner", "place", "d0", "d1"])

    return classes.select("image", "media").mapInArrow(run, _CORNERS)


def key_of(table: np.ndarray, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """The chunk of a descriptor that is its key in a table."""
    word = np.where(table < 2, d0, d1)
    return np.where(table % 2, word >> 32, word) & 0xFFFFFFFF


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches in buckets (table, key), whose rows come in order of descriptor, place and image. A batch at a time: a bucket of any size
    needs no more memory.
    """
    held: dict[str, np.ndarray] = {}  # of the last bucket so far: the first row of its last descriptor, then its last rows
    for batch in batches:
        if not len(batch):
            continue
        col = {n: np.asarray(batch.column(k)) for k, n in enumerate(batch.schema.names)}
        known = len(held["nth"]) if held else 0
        col["key"] = key_of(col["table"], col["d0"], col["d1"])
        both = {n: np.concatenate([held[n], c]) if held else c for n, c in col.items()}
        n = known + len(batch)
        at = np.arange(n)
        differs = lambda *names, both=both: np.append(True, np.any([both[x][1:] != both[x][:-1] for x in names], axis=0))
        begin = np.maximum.accumulate(np.where(differs("table", "key"), at, 0))
        nth = at - begin
        if known:
            nth[:known] = held["nth"]
            more = (begin == 0) & (at >= known)
            nth[more] = nth[known - 1] + 1 + np.arange(int(more.sum()))
        # Row 0 stands for a descriptor that goes on from the batch before.
        lead = np.maximum.accumulate(np.where(differs("table", "key", "d0", "d1") & (at >= known), at, 0))
        fresh = at >= known
        for lag in range(1, MEET):
            b = np.flatnonzero(fresh & ((nth < MEET) | (lag <= NEAR)))
            b = b[b >= lag]
            a = b - lag
            ok = (begin[a] == begin[b]) & (nth[b] - nth[a] == lag)
            yield from _matches(both, a[ok], b[ok])
        far = np.flatnonzero(fresh & (nth >= MEET) & (nth - nth[lead] > NEAR))
        yield from _matches(both, lead[far], far)
        keep = np.append(lead[-1], np.arange(max(begin[-1], n - MEET + 1), n))
        held = {name: c[keep] for name, c in both.items()} | {"nth": nth[keep]}


def _matches(col: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Matching corners a and b: the two images, the motion (turn, scale, shift in half bins) packed in a long, the corner."""
    ok = (_apart(col, a, b) <= RADIUS) & (col["image"][a] != col["image"][b])
    if ok.any():
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _motions(col, a[ok], b[ok])], names=["a", "b", "vote"])


def _apart(col: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(col["d0"][a] ^ col["d0"][b]) + np.bitwise_count(col["d1"][a] ^ col["d1"][b])


def _motions(col: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    swap = col["image"][a] > col["image"][b]  # a pair's votes are counted one way
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    first, second = ({n: unpacked(col["place"][k], n) for n in ("y", "x", "scale", "turn")} for k in (a, b))
    turn = (second["turn"] - first["turn"]) % TURNS
    scale = second["scale"] - first["scale"]
    angle, zoom = 2 * np.pi * turn / TURNS, 2.0**scale
    x, y = first["x"] * zoom, first["y"] * zoom
    dx = second["x"] - (x * np.cos(angle) - y * np.sin(angle))
    dy = second["y"] - (x * np.sin(angle) + y * np.cos(angle))
    half = lambda d: np.floor(2 * d / SHIFT).astype(np.int64) + (1 << 18)
    motion = (((turn * 16 + scale + 8) << 20) + half(dx) << 20) + half(dy)
    return col["image"][a], col["image"][b], (motion << CORNER_BITS) + (col["corner"][a] & ((1 << CORNER_BITS) - 1))


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    return np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))


def _voted(a: np.ndarray, b: np.ndarray, vote: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs whose matches agree and in how many corners, from all matches of a pair, in order of a, b and vote.

    A match is in four bins, of grids half a bin apart, so that near shifts share one; a bin's corners count once.
    """
    if not len(a):
        return a, b, vote
    new = _new(a, b, vote >> 40 + CORNER_BITS)
    many = np.diff(np.append(np.flatnonzero(new), len(a)))
    ok = np.repeat(many >= votes, many)
    a, b, vote, group = a[ok], b[ok], vote[ok], (np.cumsum(new) - 1)[ok]
    low = (1 << 20) - 1
    x, y, corner = vote >> 20 + CORNER_BITS & low, vote >> CORNER_BITS & low, vote & (1 << CORNER_BITS) - 1
    hits, many = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for k in range(4) if len(a) else ():
        own = ((x + (k & 1) >> 1 << 20) + (y + (k >> 1) >> 1) << CORNER_BITS) + corner
        order = np.lexsort((own, group))
        order = order[_new(group[order], own[order])]
        begin = np.flatnonzero(_new(group[order], own[order] >> CORNER_BITS))
        n = np.diff(np.append(begin, len(order)))
        hits.append(order[begin[n >= votes]])
        many.append(n[n >= votes])
    hits, many = np.concatenate(hits), np.concatenate(many)
    a, b = a[hits], b[hits]
    order = np.lexsort((-many, b, a))
    order = order[_new(a[order], b[order])[: len(order)]]
    return a[order], b[order], many[order]


def _counted(batches: Iterator[pa.RecordBatch], votes: int) -> Iterator[pa.RecordBatch]:
    """Linked pairs of matches that come in order of a, b and vote; the last pair of a batch waits for the next."""
    held = [np.zeros(0, dtype=np.int64)] * 3
    for batch in batches:
        col = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns, strict=True)]
        last = np.flatnonzero(_new(*col[:2])[: len(col[0])])[-1] if len(col[0]) else 0
        yield _told(*_voted(*(c[:last] for c in col), votes))
        held = [c[last:] for c in col]
    yield _told(*_voted(*held, votes))


def _told(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n"])


def _cuts(sizes: np.ndarray, most: int) -> list[int]:
    """Edges of runs of neighbours whose sizes add up to ``most``, or of one that is larger."""
    ends, edges = np.cumsum(sizes), [0]
    while edges[-1] < len(sizes):
        done = ends[edges[-1] - 1] if edges[-1] else 0
        edges.append(max(edges[-1] + 1, int(np.searchsorted(ends, done + most, side="right"))))
    return edges


def _cell(col: dict[str, np.ndarray], tree: np.ndarray, asks: np.ndarray, within: bool, votes: int, share: float = 0.0) -> Iterator[tuple[np.ndarray, ...]]:
    """A spanning forest of the linked images of a cell that have different labels: every corner that asks meets all of the tree's
    that share a bucket with it. Rows are in order of images; a pair's matches are counted at once, so none is ever sent on. Matches
    that agree are meetings of one turn: only pairs with as many meetings of a turn as a link needs matches are compared.
    """
    keys = [key_of(np.int64(t), col["d0"], col["d1"]) for t in range(TABLES)]
    turns = unpacked(col["place"], "turn")
    label = np.unique(col["label"], return_inverse=True)[1]
    root = np.arange(int(label.max()) + 1)
    mine = label.copy()  # what each corner's image is linked to so far
    many_of = np.bincount(col["nth"])
    node, query = np.flatnonzero(tree), np.flatnonzero(asks)
    if not len(node) or not len(query):
        return
    of_tree = np.append(np.flatnonzero(_new(col["image"][node])), len(node))
    of_query = np.append(np.flatnonzero(_new(col["image"][query])), len(query)).tolist()
    rows = len(label)
    for u, v in pairwise(_cuts(np.diff(of_tree), TREE)):
        part = node[of_tree[u] : of_tree[v]]
        by_key, low, high = [], [], []
        for t, k in enumerate(keys):
            order = part[np.argsort(k[part], kind="stable")]
            place = k[order] * rows + order
            # A pair of the cell's own images meets once.
            low.append(np.searchsorted(place, k[query] * rows + (query + 1 if within else 0)) + t * len(part))
            high.append(np.searchsorted(place, (k[query] + 1) * rows) + t * len(part))
            by_key.append(order)
        by_key, low, high = np.concatenate(by_key), np.array(low).T.copy(), np.array(high).T.copy()
        # Counters by image and turn, for each turn of a corner that asks.
        seen = (np.cumsum(_new(col["image"][part])) - 1)[np.searchsorted(part, by_key)] * TURNS
        counter = [(seen + (turns[by_key] - k) % TURNS).astype(np.int32) for k in range(TURNS)]
        first = part[np.append(0, np.flatnonzero(np.diff(col["nth"][part])) + 1)]  # a corner of each image
        sizes = many_of[col["nth"][first]]
        held, waiting = [], 0
        for i, j in pairwise(of_query):
            asked = query[i:j]
            lo, hi = low[i:j].ravel(), high[i:j].ravel()
            met = np.concatenate([counter[t][x:y] for t, x, y in zip(np.repeat(turns[asked], TABLES).tolist(), lo.tolist(), hi.tolist(), strict=True)], dtype=np.int64)
            n = np.bincount(met)
            # Most pairs have too few meetings, and so too few matches, of one turn.
            at = np.flatnonzero(n[met] >= votes)
            often = met[at]
            other = often // TURNS
            at = at[(n[often] >= share * np.minimum(sizes[other], j - i)) & (mine[first[other]] != mine[asked[0]])]
            if len(at):
                ends = np.cumsum(hi - lo)
                nth = np.searchsorted(ends, at, side="right")
                held.append((asked[nth // TABLES], by_key[at + hi[nth] - ends[nth]], nth % TABLES))
                waiting += len(at)
            if not held or waiting < MEETINGS and j < len(query):
                continue
            a, b, table = (np.concatenate(x) for x in zip(*held, strict=True))
            held, waiting = [], 0
            ok = np.flatnonzero((mine[a] != mine[b]) & (_apart(col, a, b) <= RADIUS))
            for t in range(TABLES - 1):  # a match in several tables is one
                ok = ok[(table[ok] <= t) | (keys[t][a[ok]] != keys[t][b[ok]])]
            a, b, vote = _motions(col, a[ok], b[ok])
            order = np.lexsort((vote, b, a))
            a, b, n = _voted(a[order], b[order], vote[order], votes)
            x, y = np.searchsorted(col["image"], a), np.searchsorted(col["image"], b)
            ok = n >= share * np.minimum(many_of[col["nth"][x]], many_of[col["nth"][y]])
            a, b, n, x, y = (c[ok] for c in (a, b, n, mine[x], mine[y]))
            if len(a):
                forest = spanning(root, x, y, -n)
                root = join_labels(root, x[forest], y[forest])
                mine = root[label]
                yield a[forest], b[forest]


def _cells(batches: Iterator[pa.RecordBatch], votes: int, share: float) -> Iterator[pa.RecordBatch]:
    """Links in cells, which come one after the other, in order of images. Rows: part, other, own, image, label, corner, place, d0, d1."""

    def met(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        col = {n: np.asarray(rows.column(n)) for n in rows.column_names}
        col["nth"] = np.cumsum(_new(col["image"]))
        part, other = col["part"][0], col["other"][0]
        for a, b in _cell(col, col["own"] == other, col["own"] == part, part == other, votes, share):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        part, other = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for i, j in pairwise(np.append(np.flatnonzero(_new(part, other)), len(batch))):
            if last not in (None, (part[i], other[i])):
                yield from met(held)
                held = []
            last = part[i], other[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield from met(held)
    del held
    common.settle()


def _labelled(rows: DataFrame, roots: DataFrame, image: str, label: str) -> DataFrame:
    roots = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(roots, rows[image] == roots["__node"], "left").withColumn(label, F.coalesce("__root", image)).drop("__node", "__root")


def links(found: DataFrame, votes: int = VOTES, share: float = 0.0) -> DataFrame:
    """Pairs (a, b) of images whose matches agree on a turn, scale and shift: in that many corners, and that share of those of the image
    with fewer. All such pairs are connected by those that are told.

    Buckets of at most ``MEET`` corners meet whole, and matches are shuffled once, by pair. Of larger ones neighbours meet first. Their
    images are crowded: all of them that aren't connected yet meet in cells, by all their buckets. A pair with an image that isn't
    crowded shares small buckets only.
    """
    common.ship(found.sparkSession)
    word = lambda t: F.col("d0" if t < 2 else "d1")
    chunk = lambda t: F.shiftrightunsigned(word(t), 32) if t % 2 else word(t).bitwiseAND(F.lit(0xFFFFFFFF))
    key = chunk(TABLES - 1)
    for t in range(TABLES - 1):
        key = F.when(F.col("table") == t, chunk(t)).otherwise(key)
    dealt = found.withColumn("table", F.explode(F.array(*[F.lit(t) for t in range(TABLES)])))
    in_order = dealt.repartition("table", key).sortWithinPartitions("table", key, "d0", "d1", "place", "image", "corner")
    matched = in_order.mapInArrow(_meet, "a long, b long, vote long").repartition("a", "b").sortWithinPartitions("a", "b", "vote")
    sizes = found.groupBy("image").agg(F.count(F.lit(1)).alias("corners"))

    near = matched.mapInArrow(partial(_counted, votes=votes), "a long, b long, n long")
    if share:
        near = near.join(sizes.toDF("a", "of_a"), "a").join(sizes.toDF("b", "of_b"), "b").where(F.col("n") >= share * F.least("of_a", "of_b"))
    near = common.written(near.select("a", "b"), "near")
    keyed = dealt.select("image", "table", key.alias("key"))
    large = common.written(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEET).drop("n"), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    crowd = keyed.join(large, ["table", "key"], "left_semi").select("image").distinct()
    crowd = common.written(_labelled(sizes.join(crowd, "image"), components(near), "image", "label"), "crowd")
    parts = -(-(crowd.agg(F.sum("corners")).first()[0] or 0) // PART)
    if not parts:
        return near
    own = F.pmod(F.xxhash64("image"), F.lit(parts)).cast("int")
    cells = (
        found.join(crowd.drop("corners"), "image").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .select(F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"), "own", "image", "label", "corner", "place", "d0", "d1")
    )
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts * (parts + 1) // 2)
    cells = cells.repartition(tasks, "part", "other").sortWithinPartitions("part", "other", "image")
    return near.unionByName(cells.mapInArrow(partial(_cells, votes=votes, share=share), "a long, b long"))


def copies(df: DataFrame, media: Column, key: str = "id") -> DataFrame:
    """``key``, class_id (smallest id of equal media), group_id (smallest id of the copy group) and n_classes (different media in the group)."""
    digest = F.coalesce(F.sha2("media", 256), F.concat(F.lit("null "), F.col("id").cast("string")), F.lit("null"))
    whole = df.select(F.col(key).alias("id"), media.alias("media")).withColumn("digest", digest)
    # The media themselves are read twice and shuffled once, but never written.
    rows = common.written(whole.select("id", "digest"), "digests")
    # Numbers, written once, stand for digests from here on: no two media share one.
    classes = common.written(rows.groupBy("digest").agg(F.min("id").alias("class_id")).withColumn("image", F.monotonically_increasing_id()), "classes")
    single = whole.where("media is not null").groupBy("digest").agg(F.any_value("media").alias("media")).join(classes, "digest").select("image", "media")
    pairs = common.written(links(common.written(corners(single), "corners"), AGREED, SHARE), "pairs")
    named = _labelled(classes, components(pairs), "image", "root")
    first = named.groupBy("root").agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("n_classes"))
    named = named.join(first, "root").select("digest", "class_id", "group_id", "n_classes")
    return rows.select("id", "digest").join(named, "digest").select(F.col("id").alias(key), "class_id", "group_id", "n_classes")


def rendered(vector: list[float] | np.ndarray | None, side: int = 64) -> bytes | None:
    """A vector as a grey picture: its numbers on a square grid, drawn smoothly over ``side`` pixels."""
    if vector is None or not len(vector):
        return None
    v = np.nan_to_num(np.asarray(vector, dtype=np.float64))
    n = int(np.ceil(np.sqrt(len(v))))
    grid = np.zeros(n * n)
    grid[: len(v)] = v
    grid = grid.reshape(n, n)
    at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    lo = np.minimum(at.astype(int), max(0, n - 2))
    part = at - lo
    part = part * part * (3 - 2 * part)
    hi = np.minimum(lo + 1, n - 1)
    rows = grid[lo] * (1 - part)[:, None] + grid[hi] * part[:, None]
    out = rows[:, lo] * (1 - part) + rows[:, hi] * part
    top = np.abs(out).max() or 1.0
    return encode(np.clip(np.rint(127.5 + 120 * out / top), 0, 255))


def render_vectors(df: DataFrame, vector: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and a media column drawn from vectors: pictures for tables that hold none."""
    common.ship(df.sparkSession)
    source = df.select(*keep, F.col(vector).alias("__v"))
    out = T.StructType([*df.select(*keep).schema.fields, T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(0, len(rows), 1024):
                part = rows.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([rendered(v) for v in part.columns[-1].to_pylist()], pa.binary())], names=out.names)

    return source.mapInArrow(run, out)
