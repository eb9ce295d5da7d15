"""WARC archives of pages, read back into capture runs that a loser tree merges into one ordered index.

Writing: one record a row. Of equal payloads of ``DEDUP_BYTES`` at least, the one with the largest page_id is a response
and the others are revisits of it; the choice is made on digests alone, so only one join moves the payloads. Records
are written as text whose line separator is the blank line that ends a WARC record: Spark's own writer, in any file
system, with its task commits. Reading: each archive is parsed by its Content-Length headers, payloads are digested
again, and its captures form a run sorted by (URL key, time, page). Runs are dealt by key ranges, and within a range the
runs' parts are merged by a loser tree, so that the partitions in order hold the captures in order. A range is cut inside
a URL's history where that is long, since time and page are part of the key.

Defined cases: a null html is an empty payload; a null url has no target and the empty key, which sorts first; a null
page_id is never the one referred to unless all are null, when all are responses; rows that repeat the largest page_id
are all responses; line breaks in a url are percent-encoded; an empty table gives an empty index; columns other than the
named ones aren't read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads of fewer bytes are stored each time.
DEDUP_BYTES = 1000
#: Uncompressed bytes of an archive, about.
ARCHIVE_BYTES = 32 << 20
#: Captures that a task merges, about.
MERGE_ROWS = 400_000
#: What names a page in record ids.
URN = "urn:marlstone:page:"
_CRLF = "\r\n"
_HEAD_END = b"\r\n\r\n"
_SHAPE = "urlkey string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long"


def _lines(*parts) -> F.Column:
    """Header lines; those that are null are left out."""
    return F.concat_ws(_CRLF, *parts)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The text of one WARC record per row, in the column ``value``."""
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("body"))
    own = own.withColumns({"digest": F.sha1("body"), "size": F.octet_length("body")})
    large, small = own.where(F.col("size") >= DEDUP_BYTES), own.where(F.col("size") < DEDUP_BYTES)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # The small payloads don't join: many of them may be one and the same.
    rows = large.join(first, "digest", "left").unionByName(small.withColumn("first", F.lit(None).cast("long")))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    date = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF * 2))
    block = F.concat(http, F.when(again, "").otherwise(F.col("body")))
    name = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    clean = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(_CRLF * 2), block).alias("value"))


def write(pages: DataFrame, path: str, **columns) -> None:
    """Archives (gzip) of all rows under ``path``."""
    html = columns.get("html", "html")
    mean = pages.agg(F.avg(F.octet_length(F.coalesce(html, F.lit(""))))).first()[0] or 0
    (
        records(pages, **columns)
        .write.option("lineSep", _CRLF * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES // (mean + 600))))
        .text(path)
    )


def url_key(url: str | None) -> str:
    """Host labels from the last one on, then path and query; lower case, without scheme, default port and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){(parts.path or '/').lower()}" + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "")


class _Bytes:
    """What a gzip or plain archive holds, read piece by piece."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer, self.offset = memoryview(raw), 0, bytearray(), 0
        self.zip = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + (1 << 18)]
        self.at += len(part)
        if self.zip is None:
            self.buffer += part
            return True
        while True:
            self.buffer += self.zip.decompress(part)
            if not self.zip.eof or not (part := self.zip.unused_data):
                return True
            self.zip = zlib.decompressobj(31)  # the next member

    def until(self, mark: bytes) -> bytes | None:
        """Up to the mark, which is passed over; None at the end."""
        start = 0
        while (k := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer:
                    raise ValueError("an archive ends within a record")
                return None
        out = bytes(self.buffer[:k])
        self._drop(k + len(mark))
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.buffer[:n])
        self._drop(n)
        return out

    def _drop(self, n: int) -> None:
        del self.buffer[:n]
        self.offset += n


def parse(raw: bytes) -> Iterator[dict]:
    """The records of an archive: headers (lower-case names), payload, offset and length (uncompressed)."""
    data = _Bytes(raw)
    while True:
        start = data.offset
        head = data.until(_HEAD_END)
        if head is None:
            return
        version, *lines = head.decode().split(_CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {start}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = data.take(int(fields["content-length"]))
        if data.take(4) != _HEAD_END:
            raise ValueError(f"the record at {start} doesn't end in a blank line")
        http, _, payload = block.partition(_HEAD_END)
        http_fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split(_CRLF)[1:])}
        yield {"fields": fields, "http": http_fields, "payload": payload, "offset": start, "length": data.offset - start}


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(digits) if digits else None


def run_of(path: str, raw: bytes) -> list[tuple]:
    """The captures of one archive, sorted: a run."""
    out = []
    for r in parse(raw):
        f = r["fields"]
        kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and hashlib.sha1(r["payload"]).hexdigest() != digest:
            raise ValueError(f"{path} at {r['offset']}: the payload isn't the one that was written")
        size = len(r["payload"]) if kind == "response" else int(r["http"]["content-length"])
        url = f.get("warc-target-uri")
        when = "".join(c for c in f["warc-date"] if c.isdigit())
        out.append((url_key(url), when, _page(f["warc-record-id"]), size, digest, kind, _page(f.get("warc-refers-to")), url, path, r["offset"], r["length"]))
    return sorted(out, key=order_of)


def order_of(row: tuple) -> tuple:
    """URL key, time, page (none first), archive, offset."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


class LoserTree:
    """Merges sorted runs: every inner node keeps the loser of its match, so the next row costs one path to the top."""

    def __init__(self, runs: Iterable[Iterable], key=order_of):
        self.key = key
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads: list = [None] * self.k
        for i in range(self.k):
            self._advance(i)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _advance(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.heads[i] = None if row is None else (self.key(row), row)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return a[0] < b[0] or (a[0] == b[0] and i < j)

    def _play(self, i: int) -> None:
        """Take run i up from its leaf; while the tree is built a first comer waits for its match."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i][1]
            self._advance(i)
            self._play(i)


def segments(rows: Iterable[tuple]) -> list[list[tuple]]:
    """Rows as they come, by archive, cut wherever the order falls: sorted runs."""
    by: dict[str, list[list[tuple]]] = {}
    for r in rows:
        own = by.setdefault(r[8], [[]])
        if own[-1] and order_of(own[-1][-1]) > order_of(r):
            own.append([])
        own[-1].append(r)
    return [s for own in by.values() for s in own if s]


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _SHAPE.split(", "))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The runs of all archives under ``path``, each archive's captures sorted."""
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow()
        for rows in batches:
            for k in range(len(rows)):
                yield from _batches(run_of(rows.column(0)[k].as_py(), rows.column(1)[k].as_py()), schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SHAPE)


def merge(runs: DataFrame) -> DataFrame:
    """All captures in order: partitions hold ascending ranges, each merged from its runs."""
    spark = runs.sparkSession
    common.ship(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(runs.count() / MERGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(LoserTree(segments(rows)), _arrow())

    return runs.repartitionByRange(parts, "urlkey", "captured_at", "page_id", "archive", "offset").mapInArrow(run, _SHAPE)


def captures(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back, and return the merged index."""
    spark = pages.sparkSession
    path = path or f"{common.shared_dir(spark)}/warc"
    write(pages, path)
    return merge(common.written(read(spark, path), "runs"))
