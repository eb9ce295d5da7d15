"""Small listings and observations for tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import history, normalize

COLUMNS = ("record_index", "source_id", "publication_id", "url", "observed_at", "location_text", "price_major", "currency", "total_area_sqm", "rooms")


def raw(spark: SparkSession, *records: dict) -> DataFrame:
    base = {"source_id": "s", "url": "https://h/x", "observed_at": "2026-01-01T00:00:00Z"}
    rows = [tuple(({"record_index": k, "publication_id": f"p{k}"} | base | r).get(c) for c in COLUMNS) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, normalize.RAW)


def at(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2026, 1, day, hour)


def listing(pid: str, day: int = 1, area: str | None = "50", rooms: str | None = "2", loc: str | None = "here", price: str | None = "100", cur: str | None = "RUB", source: str = "s", url: str = "https://h/x") -> dict:
    return {"publication_id": pid, "source_id": source, "observed_at": f"2026-01-{day:02d}T00:00:00Z", "url": url, "total_area_sqm": area, "rooms": rooms, "location_text": loc, "price_major": price, "currency": cur, "record_index": 0}


def observations(spark: SparkSession, *records: dict, gone: tuple[tuple[str, int, str], ...] = ()) -> DataFrame:
    """Available observations from listings, and unavailable ones from (publication, day, raw state)."""
    rows = history.available(normalize.normalized(raw(spark, *records)).drop("issues"))
    if gone:
        made = spark.createDataFrame([("s", p, at(d), state) for p, d, state in gone], "source_id string, publication_id string, observed_at timestamp, state string")
        kind = rows.schema["evidence"].dataType
        evidence = F.struct(*[(F.lit("direct") if f.name == "kind" else F.col("state") if f.name == "raw_source_state" else F.lit(None).cast("string")).alias(f.name) for f in kind.fields])
        rows = rows.unionByName(made.select(*history.KEY, F.lit(False).alias("is_available"), F.lit(None).cast(rows.schema["listing"].dataType).alias("listing"), evidence.alias("evidence")))
    return rows


def none(spark: SparkSession) -> DataFrame:
    return observations(spark, listing("x")).limit(0)
