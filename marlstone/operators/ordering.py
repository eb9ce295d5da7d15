"""Total orders: a distributed sort, and each row's place in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.tables import written


def placed(rows: DataFrame, *order: Column | str, place: str = "rank") -> DataFrame:
    """The rows with their place in the order (from 1): a range-partitioned sort, then an offset per partition, never one task.

    The sorted rows are written once, since sampled ranges may fall otherwise when they are computed again.
    """
    rows = written(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the sort
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rows = rows.join(F.broadcast(offsets), part == F.col("_part"))
    return rows.withColumn(place, F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_offset")
