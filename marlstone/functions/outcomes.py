"""Tagged field outcomes: ``struct<state, value, raw_value, reason_code, input_path, source_field, rule_version>``.

The state comes first, so that filters prune on it. The coordinates that all fields of a listing share (source,
publication, moment) stand once on the row and are repeated at the JSON sink only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESENT, MISSING, UNSUPPORTED = "present", "missing", "unsupported"


def outcome(raw: Column, value: Column, path: Column, field: str, version: str, reason: Column | None = None) -> Column:
    """Missing where there is no raw text, unsupported where there is a reason, present otherwise."""
    reason = F.lit(None).cast("string") if reason is None else reason
    state = F.when(raw.isNull(), MISSING).when(reason.isNotNull(), UNSUPPORTED).otherwise(PRESENT)
    return F.struct(
        state.alias("state"),
        F.when(raw.isNotNull() & reason.isNull(), value).alias("value"),
        raw.alias("raw_value"),
        F.when(raw.isNotNull(), reason).alias("reason_code"),
        path.alias("input_path"),
        F.lit(field).alias("source_field"),
        F.lit(version).alias("rule_version"),
    )


def is_present(c: Column) -> Column:
    return c["state"] == PRESENT


def canonical(c: Column) -> Column:
    """What two outcomes are compared by: provenance doesn't count."""
    return F.struct(c["state"].alias("state"), c["value"].alias("value"), c["reason_code"].alias("reason_code"))


def same_value(a: Column, b: Column) -> Column:
    """Both present and equal."""
    return is_present(a) & is_present(b) & (a["value"] == b["value"])


def delta_kind(before: Column, after: Column) -> Column:
    """How a field changed, by the first thing that differs: its value, its raw text, where it came from; null if nothing."""
    origin = lambda c: F.struct(c["input_path"].alias("p"), c["source_field"].alias("f"), c["rule_version"].alias("v"))
    return (
        F.when(~canonical(before).eqNullSafe(canonical(after)), "SUBSTANTIVE")
        .when(~before["raw_value"].eqNullSafe(after["raw_value"]), "SOURCE_REPRESENTATION_ONLY")
        .when(~origin(before).eqNullSafe(origin(after)), "PROVENANCE_REFRESH")
    )
