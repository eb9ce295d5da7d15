"""Line dedup by pairwise alignment: shared line hashes name pairs of documents, patience diff aligns them, and aligned
common blocks are deleted from the later document.

A document is a pair (doc_id, hash of its text); they are in order of doc_id (none last), then hash; blank lines don't
count. Lines that many documents have say little, so lines are hashed together with their neighbours until ``MIN_WORDS``
words are reached: a run from each line on, and one that ends at each line (often they are the same); a line of so many
words is a run of its own. Such hashes are rare where single lines are common, and whatever lines two documents have in
common side by side, of ``MIN_WORDS`` words in all, are covered by runs that both have. A run that an earlier document has
names the pair with the earliest one, and with the place there: so a run that a third of all documents share costs each of
them one row, nothing is paired within a group, and no frequency bound is needed.

Each pair is aligned by patience diff: runs on one diagonal are joined, those that cross nothing are anchors, their longest
increasing chain divides the documents, and repeated ones are aligned between the anchors. What a chain left out (moved or
repeated passages) is aligned again, ``ROUNDS`` times, after which each remaining stretch is a block by itself. Blocks are
formed within a pair only and have ``MIN_WORDS`` words each. So a line is deleted just if it is in a block of that many
words that some earlier document has too; the first occurrence of a line in the corpus always stays, and an exact copy of a
document of ``MIN_WORDS`` words goes whole.

Defined cases: null and empty texts have no lines, a text of fewer words than a block has no run; a null doc_id comes after
all others; rows that repeat a document are that document and have its result each; documents of one id with different
texts are different; what differs in blanks at the ends of lines only is one line; a passage that only one document repeats
stays; an empty table gives an empty table; a very long text is one task's work, line by line; other columns aren't looked
at and may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a block that is deleted, and of a run.
MIN_WORDS = 30
#: Alignments of a pair before what is left is taken stretch by stretch.
ROUNDS = 3

_RUNS = "doc_id long, th long, at int, n int, h1 long, h2 long"
_BLOCK = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("partner", pa.int64()), ("partner_start", pa.int32())])
_BLOCKS = "array<struct<start:int,end:int,partner:long,partner_start:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_SPANS = "array<struct<start:int,end:int>>"


def lines_of(text: bytes | None) -> list[bytes]:
    """The lines that aren't blank."""
    return [x for line in text.split(b"\n") if (x := line.strip())] if text else []


def runs_of(words: list[int]) -> list[tuple[int, int]]:
    """The shortest stretches [start, end) of lines that have ``MIN_WORDS`` words: from each line on, and up to each line."""
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    n, found = len(words), set()
    for i in range(n):
        if (j := bisect_left(total, total[i] + MIN_WORDS, i + 1)) <= n:
            found.add((i, j))
    for j in range(1, n + 1):
        if total[j] >= MIN_WORDS:
            found.add((bisect_right(total, total[j] - MIN_WORDS, 0, j) - 1, j))
    return sorted(found)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that increases in both, of pairs in order of the first (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at:
            back[n] = last[at - 1]
        if at == len(tops):
            tops.append(b)
            last.append(n)
        else:
            tops[at], last[at] = b, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(common_lines: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Aligned (later, earlier) positions from matched ones, in order of the first; the flag tells lines that occur once in both."""
    anchors = increasing([(a, b) for a, b, once in common_lines if once])
    rest = [(a, b) for a, b, once in common_lines if not once]
    if not rest:
        return anchors
    out, at = [], 0
    low = -1
    for a, b in [*anchors, (1 << 40, 1 << 40)]:
        gap = []
        while at < len(rest) and rest[at][0] < a:
            if low < rest[at][1] < b:
                gap.append(rest[at])
            at += 1
        out += increasing(gap)
        out.append((a, b))
        low = b
    return out[:-1]


def joined(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (later start, earlier start, lines) with those that touch on one diagonal as one."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(runs, key=lambda r: (r[1] - r[0], r[0])):
        if out and (last := out[-1])[1] - last[0] == b - a and a <= last[0] + last[2]:
            out[-1] = (last[0], last[1], max(last[2], a + n - last[0]))
        else:
            out.append((a, b, n))
    return sorted(out)


def _alone(runs: list[tuple[int, int, int]], side: int) -> set[tuple[int, int, int]]:
    """Runs that share no line of one side with another run."""
    order = sorted(runs, key=lambda r: r[side])
    out, reach = set(), -1
    for k, r in enumerate(order):
        end = r[side] + r[2]
        if r[side] >= reach and (k + 1 == len(order) or order[k + 1][side] >= end):
            out.add(r)
        reach = max(reach, end)
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [start, end) with those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def aligned(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (later start, earlier start, lines) of a pair, from its runs."""
    left, blocks = joined(runs), []
    for _ in range(ROUNDS):
        sure = _alone(left, 0) & _alone(left, 1)
        size = {r[:2]: r[2] for r in left}
        end_a = end_b = 0
        for a, b in patience([(a, b, (a, b, n) in sure) for a, b, n in left]):
            if a >= end_a and b >= end_b:
                blocks.append((a, b, size[a, b]))
                end_a, end_b = a + size[a, b], b + size[a, b]
        gone = union([(a, a + n) for a, _, n in blocks])
        starts = [x for x, _ in gone]
        inside = lambda r: (k := bisect_right(starts, r[0]) - 1) >= 0 and r[0] + r[2] <= gone[k][1]  # noqa: B023, E731
        left = [r for r in left if not inside(r)]
        if not left:
            return blocks
    return blocks + left


def decide(rows: list[tuple]) -> list[tuple[int, int, int | None, int]]:
    """Blocks (start, end, partner's doc_id, start there) to delete from a document. Rows: start, lines, earlier document, start there."""
    by: dict = {}
    for a, n, e, b in sorted(set(rows), key=str):
        by.setdefault(e, []).append((a, b, n))
    return sorted(((a, a + n, e[0], b) for e, runs in by.items() for a, b, n in aligned(runs)), key=lambda x: (x[0], x[1], str(x[2:])))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th"), F.col(text).alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in common.chunks(batches, "text"):
        doc, at, many, digest = [], [], [], bytearray()
        for d, t in enumerate(texts):
            own = lines_of(t)
            found = runs_of([len(x.split()) for x in own])
            if not found:
                continue
            hashes = b"".join(map(xxhash.xxh3_128_digest, own))
            for i, j in found:
                doc.append(d)
                at.append(i)
                many.append(j - i)
                digest += xxhash.xxh3_128_digest(hashes[16 * i : 16 * j])
        index = pa.array(doc, pa.int64())
        both = np.frombuffer(bytes(digest), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(index), rows.column(1).take(index), pa.array(at, pa.int32()), pa.array(many, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
            names=["doc_id", "th", "at", "n", "h1", "h2"],
        )


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document; a row out for each document that loses lines."""

    def batch(made: list[tuple]) -> pa.RecordBatch:
        cols = zip(*made, strict=True) if made else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(_BLOCK)), strict=True)], names=["doc_id", "th", "blocks"])

    names = ("start", "end", "partner", "partner_start")
    out = lambda key, rows: (*key, [dict(zip(names, b, strict=True)) for b in decide(rows)])
    key, held, made = None, [], []
    for b in batches:
        for doc, th, at, n, e_doc, e_th, e_at in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (doc, th) != key:
                if held:
                    made.append(out(key, held))
                key, held = (doc, th), []
            held.append((at, n, (e_doc, e_th), e_at))
        if len(made) >= 4096:
            yield batch(made)
            made = []
    if held:
        made.append(out(key, held))
    yield batch(made)


def overlaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text) and blocks (start, end, partner, partner_start) of the documents that lose lines."""
    common.ship(docs.sparkSession)
    runs = common.written(_keyed(docs, doc_id, text).mapInArrow(_runs, _RUNS), "runs")
    holder = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "at")
    found = runs.groupBy("h1", "h2").agg(F.min(holder).alias("e"), F.max(holder).alias("last"))
    other = lambda a, b: ~(F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}th") == F.col(f"{b}th")))
    # Written, so that both sides are plain exchanges: a run that very many documents hold can then be split.
    first = common.written(found.where(other("e.", "last.")).select("h1", "h2", "e"), "first")
    shared = runs.join(first.hint("merge"), ["h1", "h2"]).where(other("", "e."))
    rows = shared.select("doc_id", "th", "at", "n", F.col("e.doc_id").alias("e_doc"), F.col("e.th").alias("e_th"), F.col("e.at").alias("e_at"))
    return rows.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th").mapInArrow(_align, f"doc_id long, th long, blocks {_BLOCKS}")


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the lines of the spans, which count the lines that aren't blank."""
    gone = np.zeros(sum(1 for x in text.split(b"\n") if x.strip()) + 1, dtype=bool)
    for a, b in spans:
        gone[a:b] = True
    out, n = [], 0
    for line in text.split(b"\n"):
        blank = not line.strip()
        if blank or not gone[n]:
            out.append(line)
        n += not blank
    return b"\n".join(out)


def _joined(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    f = found.select(F.col("doc_id").alias("__d"), F.col("th").alias("__h"), F.col("blocks").alias("__blocks"))
    key = F.col(doc_id).cast("long").eqNullSafe(F.col("__d")) & (F.coalesce(F.xxhash64(text), F.lit(0)) == F.col("__h"))
    return docs.join(f.hint("merge"), key, "left").drop("__d", "__h")


def _spans(blocks: list | None) -> list[tuple[int, int]]:
    return union([(b["start"], b["end"]) for b in blocks]) if blocks else []


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed (lines), words_removed, spans, blocks, partners (earlier doc_ids) and kept_text of every row."""
    found = common.written(overlaps(docs, doc_id, text), "found")
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = _joined(plain, found, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.chunks(batches, "text"):
            blocks = part.column(2).to_pylist()
            spans, many, gone, words, partners, made = [], [], [], [], [], []
            for t, own in zip(texts, blocks, strict=True):
                lines, cut = lines_of(t), _spans(own)
                spans.append([{"start": a, "end": b} for a, b in cut])
                many.append(len(lines))
                gone.append(sum(b - a for a, b in cut))
                words.append(sum(len(x.split()) for a, b in cut for x in lines[a:b]))
                partners.append(sorted({b["partner"] for b in own or ()}, key=lambda x: (x is None, x or 0)))
                made.append(kept(t, cut) if cut else t)
            longs = [pa.array(x, pa.int64()) for x in (many, gone, words)]
            cols = [*longs, pa.array(spans, pa.list_(_SPAN)), pa.array([b or [] for b in blocks], pa.list_(_BLOCK)), pa.array(partners, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.array(made, pa.binary()).cast(pa.string())], names=names)

    names = ["doc_id", "n_lines", "n_removed", "words_removed", "spans", "blocks", "partners", "kept_text"]
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_lines long, n_removed long, words_removed long, spans {_SPANS}, blocks {_BLOCKS}, partners array<long>, kept_text string")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all columns and what is left of their texts; those of which every line was deleted go."""
    own = docs.columns
    names = [f"__c{i}" for i in range(len(own))]
    plain = docs.toDF(*names)
    d, t = names[own.index(doc_id)], names[own.index(text)]
    rows = _joined(plain, common.written(overlaps(plain, d, t), "found"), d, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.chunks(batches, t):
            spans = [_spans(b) for b in part.column(len(names)).to_pylist()]
            made = [kept(x, s) if s else x for x, s in zip(texts, spans, strict=True)]
            stay = pa.array([not s or bool(x.strip()) for x, s in zip(made, spans, strict=True)])
            cols = [pa.array(made, pa.binary()).cast(pa.string()) if n == t else part.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(stay)

    return rows.mapInArrow(run, plain.schema).toDF(*own)
