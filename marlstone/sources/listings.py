"""Listings documents: strict JSON, every schema error reported, adapted to raw listings of the source.

The text goes through VARIANT, which keeps apart absent keys, nulls and other types, as ``from_json`` would not. Checking
and exploding are column expressions, so any number of documents are read in one job; ``document`` tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.functions import parsing
from marlstone.operators.atomic import Result, issue
from marlstone.operators.normalize import path

FIELDS = (*policies.REQUIRED_FIELDS, *policies.OPTIONAL_FIELDS)


class UnreadableInput(Exception):
    """An operational failure: the role of the input and the reason."""

    def __init__(self, role: str, reason: str):
        super().__init__(f"{role}/{reason}")
        self.role, self.reason = role, reason


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``document`` and ``text`` of whole files; text that isn't UTF-8 is an operational failure, told when it is read."""
    files = spark.read.format("binaryFile").load(paths)
    text = F.col("content").cast("string")
    checked = F.when(F.is_valid_utf8(text), text).otherwise(F.raise_error(F.lit("listings/invalid_utf8")).cast("string"))
    return files.select(F.col("path").alias("document"), checked.alias("text"))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID or a scalar's type."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0)


def _schema_issue(record: Column, at: Column, code: str) -> Column:
    return issue(record, at, "INPUT_SCHEMA", code)


def parsed(documents: DataFrame) -> DataFrame:
    """``document``, the root as VARIANT (null: no JSON) and its map of members (null: no object)."""
    v = F.when(~F.startswith("text", F.lit("﻿")), F.try_parse_json("text"))
    rows = documents.select("document", v.alias("root"))
    return rows.withColumn("members", F.when(_kind(F.col("root")) == "OBJECT", F.col("root").cast("map<string,variant>")))


def _root_issues() -> Column:
    none = F.lit(None).cast("int")
    members = F.col("members")
    at = lambda k: F.lit(f"$.{k}")
    has = lambda k: F.map_contains_key(members, F.lit(k))
    kind = lambda k: _kind(members[k])
    known = F.array(*[F.lit(x) for x in ("schema_version", "source", "listings")])
    version = members["schema_version"]
    fixed = [
        F.when(F.col("root").isNull(), issue(none, F.lit("$"), "INPUT_SYNTAX", "invalid_json")),
        F.when(F.col("root").isNotNull() & members.isNull(), _schema_issue(none, F.lit("$"), "wrong_type")),
        *[F.when(members.isNotNull() & ~has(k), _schema_issue(none, at(k), "missing_field")) for k in ("schema_version", "source", "listings")],
        F.when(
            has("schema_version") & ~((kind("schema_version") == "STRING") & (F.coalesce(version.cast("string"), F.lit("")) == policies.LISTINGS_VERSION)),
            _schema_issue(none, at("schema_version"), "unsupported_schema_version"),
        ),
        F.when(has("source") & (kind("source") != "STRING"), _schema_issue(none, at("source"), "wrong_type")),
        F.when(has("listings") & (kind("listings") != "ARRAY"), _schema_issue(none, at("listings"), "wrong_type")),
        F.when(
            has("listings") & (kind("listings") == "ARRAY") & (F.size(F.when(kind("listings") == "ARRAY", members["listings"].cast("array<variant>"))) == 0),
            _schema_issue(none, at("listings"), "invalid_value"),
        ),
    ]
    extra = F.transform(
        F.filter(F.coalesce(F.map_keys(members), F.array().cast("array<string>")), lambda k: ~F.array_contains(known, k)),
        lambda k: _schema_issue(none, F.concat(F.lit("$."), k), "extra_field"),
    )
    return F.array_compact(F.concat(F.array(*fixed), extra))


def _records(roots: DataFrame) -> DataFrame:
    listings = F.when(_kind(F.col("members")["listings"]) == "ARRAY", F.col("members")["listings"].cast("array<variant>"))
    rows = roots.select("document", "members", F.posexplode(listings).alias("record_index", "record"))
    return rows.withColumn("fields", F.when(_kind(F.col("record")) == "OBJECT", F.col("record").cast("map<string,variant>")))


def _record_issues() -> Column:
    i, fields = F.col("record_index"), F.col("fields")
    has = lambda k: F.map_contains_key(fields, F.lit(k))
    known = F.array(*[F.lit(x) for x in FIELDS])
    fixed = [F.when(fields.isNull(), _schema_issue(i, path(), "wrong_type"))]
    fixed += [F.when(fields.isNotNull() & ~has(k), _schema_issue(i, path(k), "missing_field")) for k in policies.REQUIRED_FIELDS]
    fixed += [F.when(has(k) & (_kind(fields[k]) != "STRING"), _schema_issue(i, path(k), "wrong_type")) for k in FIELDS]
    extra = F.transform(
        F.filter(F.coalesce(F.map_keys(fields), F.array().cast("array<string>")), lambda k: ~F.array_contains(known, k)),
        lambda k: _schema_issue(i, F.concat(path(), F.lit("."), k), "extra_field"),
    )
    return F.array_compact(F.concat(F.array(*fixed), extra))


def load(documents: DataFrame) -> Result:
    """Raw listings with the document's source, or every syntax and schema issue."""
    roots = parsed(documents)
    records = _records(roots)
    wrong = roots.select(F.explode(_root_issues()).alias("i")).unionByName(records.select(F.explode(_record_issues()).alias("i")))
    text = lambda k: F.when(_kind(F.col("fields")[k]) == "STRING", F.col("fields")[k].cast("string")).alias(k)
    source = F.when(_kind(F.col("members")["source"]) == "STRING", F.col("members")["source"].cast("string"))
    rows = records.select("document", "record_index", source.alias("source_id"), *[text(k) for k in FIELDS])
    return Result(rows, wrong.select("i.*").distinct())


def adapt(rows: DataFrame, source: str = policies.SOURCE_ID) -> Result:
    """Raw listings of the source, or what contradicts it: another source, bad ids, URLs that aren't the record's own."""
    i, pid = F.col("record_index"), F.col("publication_id")
    category = "SOURCE_ADAPTER"
    checks = F.array_compact(
        F.array(
            F.when(F.col("source_id") != source, issue(F.lit(None), F.lit("$.source"), category, "source_mismatch")),
            F.when(~parsing.full_match(pid, parsing.PUBLICATION_ID), issue(i, path("publication_id"), category, "inconsistent_record")),
            F.when(~parsing.source_url(F.col("url"), pid), issue(i, path("url"), category, "invalid_source_url")),
        )
    )
    return Result(rows, rows.select(F.explode(checks).alias("i")).select("i.*").distinct())
