"""The search from two files to canonical bytes: load, adapt, normalize, collect, search, render, with a gate at each."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators import atomic, normalize, search
from marlstone.plans import render
from marlstone.sources import criteria as criteria_source
from marlstone.sources import listings
from marlstone.sources.listings import UnreadableInput

Issue = tuple[str, int, str, str, str]


@dataclass(frozen=True)
class Outcome:
    """Bytes, or issues as (document, record or -1, path, category, code) in canonical order."""

    data: bytes | None
    issues: tuple[Issue, ...] = ()


def _text(path: str | Path, role: str) -> str:
    try:
        return Path(path).read_bytes().decode("utf-8")
    except UnicodeDecodeError:
        raise UnreadableInput(role, "invalid_utf8") from None
    except OSError:
        raise UnreadableInput(role, "unreadable_input") from None


def _collected(issues: DataFrame) -> list[Issue]:
    return [(r.document, -1 if r.record_index is None else r.record_index, r.json_path, r.category, r.code) for r in atomic.ordered_issues(issues).collect()]


def _sorted(issues: list[Issue]) -> tuple[Issue, ...]:
    return tuple(sorted(issues, key=lambda x: ({"listings": 0, "criteria": 1}[x[0]], *x[1:])))


def run(spark: SparkSession, listings_path: str | Path, criteria_path: str | Path) -> Outcome:
    """Both inputs are checked whatever the other is like; after that, the first stage with issues ends the run."""
    text, asked_text = _text(listings_path, "listings"), _text(criteria_path, "criteria")
    loaded = listings.load(spark.createDataFrame([(str(listings_path), text)], "document string, text string"))
    asked, issues = criteria_source.load(asked_text)
    issues = _collected(loaded.conflicts) + issues
    if issues or asked is None:
        return Outcome(None, _sorted(issues))
    adapted = listings.adapt(loaded.rows)
    if issues := _collected(adapted.conflicts):
        return Outcome(None, _sorted(issues))
    collected = normalize.collection(adapted.rows)
    kept = collected.rows.cache()
    try:
        if issues := _collected(collected.conflicts):
            return Outcome(None, _sorted(issues))
        data = render.canonical_bytes(search.search(kept, asked), asked)
    finally:
        kept.unpersist()
    if data is None:
        return Outcome(None, (("criteria", -1, "$", "OUTPUT_CONTRACT", "invalid_result_document"),))
    return Outcome(data)
