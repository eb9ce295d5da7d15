"""Connected components of a link table by alternating stars, each round written to the shared folder.

A table of at most ``SMALL`` links needs no rounds: one task joins them in numpy, whose memory that bound bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bktree import join_labels

#: Links that one task joins (6 MB).
SMALL = 200_000

#: Rounds after which something must be wrong; the number needed grows with the logarithm of a component's size.
MOST_ROUNDS = 60


def _stars_large(links: DataFrame) -> DataFrame:
    """Every node hands the smallest of its neighbours and itself to its larger neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _stars_small(links: DataFrame) -> DataFrame:
    """Every node hands the smallest of its smaller neighbours to the others of them and keeps it."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if len(b)]
    if not got:
        return
    a, b = (np.concatenate([np.asarray(x.column(k)) for x in got]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[join_labels(np.arange(len(nodes)), at[: len(a)], at[len(a) :])]
    other = np.flatnonzero(root != nodes)
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(root[other])], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long) that isn't its component's smallest, which is the root.

    No link gives an empty table. Repeated links and links of a node with itself change nothing.
    """
    links = common.written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    before = _state(links)
    for k in range(MOST_ROUNDS):
        if before[0] == 0:
            break
        if before[0] <= SMALL:
            common.ship(links.sparkSession)
            return common.written(links.coalesce(1).mapInArrow(_joined, "node long, root long"), "joined")
        links = common.written(_stars_small(_stars_large(links)), f"round{k}")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
