"""Normalization of raw listings: one projection that parses every field and collects every issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.functions import parsing
from marlstone.functions.outcomes import outcome
from marlstone.operators.atomic import Result, issue

RAW = (
    "record_index int, source_id string, publication_id string, url string, observed_at string, location_text string, "
    "price_major string, currency string, total_area_sqm string, rooms string"
)


#: How each raw field is parsed.
PARSERS = {
    "observed_at": parsing.moment, "url": parsing.url, "location_text": parsing.location, "price_major": parsing.price,
    "currency": parsing.currency, "total_area_sqm": parsing.area, "rooms": parsing.rooms,
}


def path(field: str | None = None, index: Column | None = None) -> Column:
    """``$.listings[i]`` or ``$.listings[i].field``."""
    index = F.col("record_index") if index is None else index
    return F.concat(F.lit("$.listings["), index.cast("string"), F.lit("]" if field is None else f"].{field}"))


def normalized(raw: DataFrame) -> DataFrame:
    """Raw listings (null: the field is absent) with typed outcomes and, in ``issues``, all that is wrong with the record.

    Price and currency are parsed only where both are there or neither is. A record with issues has no canonical form;
    its outcomes mean nothing.
    """
    # Each raw text is read in a projection of its own, so that values, codes and states don't repeat the reading.
    read = raw.select("*", *[parser.read(F.col(field)).alias(f"_{field}") for field, parser in PARSERS.items()])
    parsed = read.select(*raw.columns, *[parser.result(F.col(field), F.col(f"_{field}")).alias(f"_{field}") for field, parser in PARSERS.items()])
    half = F.col("price_major").isNull() != F.col("currency").isNull()
    both = F.col("price_major").isNotNull() & F.col("currency").isNotNull()
    i = F.col("record_index")

    def wrong(field: str, when: Column) -> Column:
        return issue(i, path(field), "NORMALIZATION", F.when(when, F.col(f"_{field}.code")))

    there = lambda name: F.col(name).isNotNull()
    issues = F.array_compact(
        F.array(
            wrong("observed_at", F.lit(True)),
            wrong("url", F.lit(True)),
            wrong("location_text", there("location_text")),
            issue(i, path(), "NORMALIZATION", F.when(half, "incomplete_money")),
            wrong("price_major", both),
            wrong("currency", both),
            wrong("total_area_sqm", there("total_area_sqm")),
            wrong("rooms", there("rooms")),
        )
    )
    v = policies.RULE_VERSIONS
    unsupported = F.when(F.col("currency") != policies.SUPPORTED_CURRENCY, "unsupported_currency")

    def made(field: str, reason: Column | None = None) -> Column:
        return outcome(F.col(field), F.col(f"_{field}.value"), path(field), field, v[field], reason)

    return parsed.select(
        "record_index", "source_id", "publication_id",
        F.col("_observed_at.value").alias("observed_at"), F.col("observed_at").alias("observed_at_raw"),
        made("url").alias("source_url"),
        made("location_text").alias("location_text"),
        made("price_major").alias("price_amount"),
        made("currency", unsupported).alias("currency"),
        made("total_area_sqm").alias("total_area"),
        made("rooms").alias("rooms"),
        issues.alias("issues"),
    )


def repeated_references(listings: DataFrame) -> DataFrame:
    """Records whose reference an earlier record of the batch already has."""
    nth = F.row_number().over(Window.partitionBy("source_id", "publication_id").orderBy("record_index"))
    return listings.withColumn("occurrence", nth).where("occurrence > 1")


def collection(raw: DataFrame) -> Result:
    """Normalized listings, or the issues: those of normalization if there are any, else those of repeated references."""
    rows = normalized(raw)
    wrong = rows.where(F.size("issues") > 0).select(F.explode("issues").alias("i")).select("i.*")
    again = repeated_references(rows.where(F.size("issues") == 0)).select(
        issue(F.col("record_index"), path(), "COLLECTION_CONFLICT", "duplicate_publication_ref").alias("i")
    ).select("i.*")
    # The second kind counts only where the first is absent: an anti join against one flag row, no action.
    any_wrong = wrong.limit(1).select(F.lit(1).alias("flag"))
    again = again.join(F.broadcast(any_wrong), F.lit(1) == F.col("flag"), "left_anti")
    return Result(rows.drop("issues"), wrong.unionByName(again))
