"""Result documents: matches as JSON per row, the whole document as canonical bytes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.functions import parsing
from marlstone.functions.outcomes import MISSING, PRESENT, UNSUPPORTED
from marlstone.operators import normalize
from marlstone.operators.search import Criteria

def _provenance(path: Column, raw: Column, field: Column, version: Column) -> Column:
    """Where a value came from; keys in alphabetical order, an absent raw value left out by the JSON writer."""
    return F.struct(
        path.alias("input_path"), version.alias("normalization_rule_version"), parsing.rendered_moment(F.col("observed_at")).alias("observed_at"),
        F.col("publication_id"), raw.alias("raw_value"), field.alias("source_field"), F.col("source_id"),
    )


def _outcome(name: str, value: Column | None = None) -> Column:
    c = F.col(name)
    made = _provenance(c["input_path"], c["raw_value"], c["source_field"], c["rule_version"])
    return F.struct(
        made.alias("provenance"), c["reason_code"].alias("reason_code"), c["state"].alias("state"), (c["value"] if value is None else value).alias("value")
    ).alias(name)


def _traced(name: str, field: str, raw: Column, value: Column) -> Column:
    at = F.concat(F.lit("$.listings["), F.col("record_index").cast("string"), F.lit(f"].{field}"))
    made = _provenance(at, raw, F.lit(field), F.lit(policies.RULE_VERSIONS[field]))
    return F.struct(made.alias("provenance"), value.alias("value")).alias(name)


def _match() -> Column:
    url = F.col("source_url")
    ref = F.struct(F.col("publication_id"), F.col("source_id"))
    return F.struct(
        _outcome("currency"), _outcome("location_text"),
        _traced("observed_at", "observed_at", F.col("observed_at_raw"), parsing.rendered_moment(F.col("observed_at"))),
        _outcome("price_amount"), _traced("publication_ref", "publication_id", F.col("publication_id"), ref), _outcome("rooms"),
        _traced("source_url", "url", url["raw_value"], url["value"]),
        _outcome("total_area", F.when(F.col("total_area.value").isNotNull(), parsing.rendered_area(F.col("total_area.value")))),
    )


def documents(matches: DataFrame) -> DataFrame:
    """A column ``match`` of the fields of each match, in the order of the rows."""
    return matches.select(_match().alias("match"))


def breaks_contract() -> Column:
    """Would a match, rendered, not say what it is? Its texts must read back as its values, its paths name its own fields."""
    same = lambda parser, text, value: parser(text)["value"].eqNullSafe(value)
    fits = [
        parsing.full_match(F.col("publication_id"), parsing.PUBLICATION_ID),
        parsing.full_match(F.col("source_id"), parsing.SOURCE_ID),
        F.col("observed_at").isNotNull() & same(parsing.moment, parsing.rendered_moment(F.col("observed_at")), F.col("observed_at")),
    ]
    for name in ("currency", "location_text", "price_amount", "rooms", "total_area"):
        c = F.col(name)
        own = F.concat(normalize.path(), F.lit("."), c["source_field"])
        fits += [c["input_path"] == own, F.length(c["source_field"]) > 0, parsing.opaque_code(c["rule_version"])]
        states = {MISSING: c["raw_value"].isNull(), PRESENT: c["value"].isNotNull(), UNSUPPORTED: c["reason_code"].isNotNull()}
        fits += [c["state"].isin(*states), *((c["state"] == state) == told for state, told in states.items())]
    value = lambda name: F.col(name)["value"]
    there = lambda name, good: value(name).isNull() | good
    fits += [
        there("currency", value("currency") == policies.SUPPORTED_CURRENCY),
        there("price_amount", value("price_amount") >= 1),
        there("rooms", value("rooms").between(0, 99)),
        there("total_area", same(parsing.area, parsing.rendered_area(value("total_area")), value("total_area"))),
    ]
    bad = F.lit(False)
    for x in fits:
        bad = bad | ~F.coalesce(x, F.lit(False))
    return bad


def criteria_document(criteria: Criteria) -> dict:
    out: dict = {}
    if criteria.rooms is not None:
        out["allowed_rooms"] = sorted(criteria.rooms)
    if criteria.max_price is not None:
        out["maximum_price"] = {"amount_minor": criteria.max_price, "currency": criteria.price_currency}
    if criteria.min_area is not None:
        out["minimum_total_area"] = f"{criteria.min_area // 100}.{criteria.min_area % 100:02d}"
    return out


def json_rows(matches: DataFrame) -> DataFrame:
    """A match a row as JSON text: the form for results of any size."""
    return documents(matches).select(F.to_json("match").alias("value"))


def canonical_bytes(matches: DataFrame, criteria: Criteria) -> bytes | None:
    """The result as one document: sorted keys, no blanks, ASCII, one line break. None if a match breaks the contract.

    The document is one value by its contract, so its rows come to the driver, streamed partition by partition.
    """
    rows = matches.select(F.to_json(_match()).alias("text"), breaks_contract().alias("bad"))
    out = []
    for r in rows.toLocalIterator():
        if r.bad:
            return None
        out.append(json.loads(r.text))
    document = {"criteria": criteria_document(criteria), "matches": out, "schema_version": policies.RESULT_VERSION}
    return json.dumps(document, allow_nan=False, ensure_ascii=True, separators=(",", ":"), sort_keys=True).encode() + b"\n"
