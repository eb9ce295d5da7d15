"""What the training-data operators share: table paths, shipping the package, shared folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import shared_dir, table, written

__all__ = ["ascii_lower", "chunks", "free", "settle", "shared_dir", "ship", "table", "written"]

#: Text handled at once inside a Python worker; bounds the worker's memory whatever the row sizes are.
CHUNK_BYTES = 1 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that workers need no common folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone_pkg.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def free(name: str, taken) -> str:
    """The name, longer by underscores until no column has it."""
    while name in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def settle() -> None:
    """Give a task's memory back: a worker outlives its tasks, and executors are sized for what a task needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of Arrow batches with about ``limit`` bytes of text each (one row at least), with the column's bytes or None."""
    held: list = []
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        values = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()) if not pa.types.is_binary(col.type) else col
        start, size, held = 0, 0, []
        for i in range(len(values)):
            v = values[i].as_py()
            held.append(v)
            size += len(v) if v is not None else 0
            if size >= limit:
                yield batch.slice(start, i + 1 - start), held
                start, size, held = i + 1, 0, []
        if held:
            yield batch.slice(start), held
    del held
    settle()
