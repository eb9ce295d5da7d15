"""Observation histories: what changed between neighbours, and atomic, idempotent appends of whole batches.

An observation is a row: source_id, publication_id, observed_at, is_available, listing (struct of field outcomes, null if
unavailable) and evidence (struct, null if available). Histories are rows too, never arrays; each publication's rows are
in order of observed_at. The append of a batch is a few joins on (publication, moment) instead of a fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.functions.outcomes import delta_kind
from marlstone.operators.atomic import Result

REF = ("source_id", "publication_id")
KEY = (*REF, "observed_at")
CONTENT = ("is_available", "listing", "evidence")
CATEGORY = "OBSERVATION_CONFLICT"


def _stream() -> Window:
    return Window.partitionBy(*REF).orderBy("observed_at")


def available(listings: DataFrame) -> DataFrame:
    """Normalized listings as available observations."""
    fields = F.struct(*policies.CHANGE_FIELDS, "record_index")
    evidence = F.lit(None).cast("struct<kind:string,raw_source_state:string,source_field:string,adapter_rule_version:string,source_reported_cause:string,outcome_code:string,check_rule_version:string>")
    return listings.select(*KEY, F.lit(True).alias("is_available"), fields.alias("listing"), evidence.alias("evidence"))


def field_deltas(before: Column, after: Column, fields: tuple[str, ...] = policies.CHANGE_FIELDS) -> Column:
    """An array of (field, kind, before, after) in policy order, of the fields that differ."""
    one = lambda f: F.when(
        delta_kind(before[f], after[f]).isNotNull(),
        F.struct(F.lit(f).alias("field"), delta_kind(before[f], after[f]).alias("kind"), F.to_json(before[f]).alias("before"), F.to_json(after[f]).alias("after")),
    )
    return F.array_compact(F.array(*[one(f) for f in fields]))


def _with_previous(observations: DataFrame, spread: str | None) -> DataFrame:
    """Rows with ``prev``, the publication's observation before.

    ``spread`` (a unit such as month) is for publications with very many observations: the window then runs within a
    unit of time, and what precedes a unit's first row comes from a table of the units' last rows. So one publication's
    history is spread over as many tasks as it has units, at the price of one more exchange.
    """
    now = F.struct("observed_at", *CONTENT)
    if spread is None:
        return observations.withColumn("prev", F.lag(now).over(_stream()))
    rows = observations.withColumn("_unit", F.date_trunc(spread, "observed_at"))
    within = Window.partitionBy(*REF, "_unit").orderBy("observed_at")
    rows = rows.withColumn("_prev", F.lag(now).over(within))
    last = rows.groupBy(*REF, "_unit").agg(F.max_by(now, "observed_at").alias("_last"))
    before = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(*REF).orderBy("_unit")))
    return rows.join(before, [*REF, "_unit"]).withColumn("prev", F.coalesce("_prev", "_last")).drop("_unit", "_prev", "_last")


def changes(observations: DataFrame, fields: tuple[str, ...] = policies.CHANGE_FIELDS, spread: str | None = None) -> DataFrame:
    """A change set for every observation but each publication's first; transitions carry no deltas, and a set may be empty."""
    rows = _with_previous(observations, spread).where(F.col("prev").isNotNull())
    was, is_ = F.col("prev.is_available"), F.col("is_available")
    transition = F.when(was & ~is_, "confirmed_unavailable").when(~was & is_, "reappeared")
    return rows.select(
        *REF, F.col("prev.observed_at").alias("from_at"), F.col("observed_at").alias("to_at"), F.lit(policies.CHANGE_POLICY).alias("policy_version"),
        transition.alias("transition"),
        F.when(was & is_, field_deltas(F.col("prev.listing"), F.col("listing"), fields)).otherwise(F.array()).alias("deltas"),
        (~was & ~is_ & ~F.col("prev.evidence").eqNullSafe(F.col("evidence"))).alias("evidence_changed"),
    )


def heads(observations: DataFrame) -> DataFrame:
    """The latest observation of each publication: an aggregate with map-side combine, no window."""
    rest = [c for c in observations.columns if c not in REF]
    latest = F.max_by(F.struct(*rest), "observed_at").alias("h")
    return observations.groupBy(*REF).agg(latest).select(*REF, "h.*")


def current_available(observations: DataFrame) -> DataFrame:
    """Heads that are available: the input of candidate generation."""
    return heads(observations).where("is_available")


def out_of_order(observations: DataFrame) -> DataFrame:
    """Rows whose arrival order (``ordinal``) isn't their order in time, within a publication."""
    arrival = Window.partitionBy(*REF).orderBy("ordinal")
    return observations.withColumn("previous_at", F.lag("observed_at").over(arrival)).where("previous_at >= observed_at")


@dataclass(frozen=True)
class Append(Result):
    """Rows of the new histories; ``outcomes`` has the disposition of each candidate, ``change_sets`` those of appended ones."""

    outcomes: DataFrame
    change_sets: DataFrame


def _conflict(code: str, subject: Column, at: Column) -> list[Column]:
    return [F.lit(CATEGORY).alias("category"), F.lit(code).alias("code"), subject.alias("subject"), *REF, at.alias("observed_at")]


def append(history: DataFrame, candidates: DataFrame, policies_of: DataFrame | None = None, policy: str = policies.CHANGE_POLICY, fields: tuple[str, ...] = policies.CHANGE_FIELDS) -> Append:
    """Append a batch to histories, or nothing if there is any conflict.

    ``policies_of``: source_id, publication_id and policy_version of every supplied history, empty ones included. An exact
    repeat within the batch counts once, one of the history is replayed; the same key with another content, a moment
    before the history's latest, or a history under another policy is a conflict.
    """
    # Equality of content is that of the whole struct. Candidates' distinct contents by key:
    variants = candidates.select(*KEY, *CONTENT).distinct()
    by_key = Window.partitionBy(*KEY)
    counted = variants.withColumn("contents", F.count(F.lit(1)).over(by_key))
    several = counted.where("contents > 1").select(*KEY).distinct()
    single = counted.where("contents = 1").drop("contents")
    known = history.select(*KEY, *CONTENT)
    moment = F.col("observed_at")
    found = [several.select(*_conflict("timestamp_content_conflict", F.lit("observation"), moment))]
    if policies_of is not None:
        other = policies_of.where(F.col("policy_version") != policy).select(*REF).distinct()
        found.append(other.select(*_conflict("comparison_policy_mismatch", F.lit("publication"), F.lit(None).cast("timestamp"))))
        single = single.join(other, list(REF), "left_anti")
    # The latest moment is a pre-aggregated table; the equal key joins on the whole key, which spreads long histories.
    latest = known.groupBy(*REF).agg(F.max("observed_at").alias("latest"))
    old = known.select(*KEY, F.struct(*CONTENT).alias("old"))
    judged = single.join(latest, list(REF), "left").join(old, list(KEY), "left")
    same = F.col("old").eqNullSafe(F.struct(*CONTENT))
    disposition = (
        F.when(F.col("old").isNotNull() & same, "REPLAYED")
        .when(F.col("old").isNotNull(), "timestamp_content_conflict")
        .when(F.col("observed_at") < F.col("latest"), "out_of_order_observation")
        .otherwise("APPENDED")
    )
    judged = judged.withColumn("disposition", disposition)
    for code in ("timestamp_content_conflict", "out_of_order_observation"):
        found.append(judged.where(F.col("disposition") == code).select(*_conflict(code, F.lit("observation"), moment)))
    conflicts = found[0]
    for more in found[1:]:
        conflicts = conflicts.unionByName(more)
    new = judged.where("disposition = 'APPENDED'").select(*KEY, *CONTENT)
    whole = known.unionByName(new)
    fresh = new.select(*REF, F.col("observed_at").alias("to_at"))
    touched = whole.join(new.select(*REF).distinct(), list(REF), "left_semi")
    sets = changes(touched, fields).join(fresh, [*REF, "to_at"], "left_semi")
    outcomes = judged.where(F.col("disposition").isin("APPENDED", "REPLAYED")).select(*KEY, "disposition")
    return Append(whole, conflicts.distinct(), outcomes, sets)


def append_one(history: DataFrame, reference: tuple[str, str], candidate: DataFrame, policies_of: DataFrame | None = None, policy: str = policies.CHANGE_POLICY, fields: tuple[str, ...] = policies.CHANGE_FIELDS) -> Append:
    """Append one observation to one history; one of another publication is a conflict of its own, unless the policy differs."""
    own = (F.col("source_id") == reference[0]) & (F.col("publication_id") == reference[1])
    done = append(history.where(own), candidate.where(own), None if policies_of is None else policies_of.where(own), policy, fields)
    foreign = candidate.where(~own).select(*_conflict("stream_reference_mismatch", F.lit("observation"), F.col("observed_at")))
    if policies_of is not None:
        mismatch = policies_of.where(own & (F.col("policy_version") != policy)).limit(1)
        foreign = foreign.join(F.broadcast(mismatch.select(F.lit(CATEGORY).alias("category"))), "category", "left_anti").select(foreign.columns)
    return Append(done.rows, done.conflicts.unionByName(foreign), done.outcomes, done.change_sets)


def ordered_conflicts(conflicts: DataFrame) -> DataFrame:
    """Publications before their observations, by reference and moment, then code."""
    return conflicts.orderBy(*REF, F.col("observed_at").asc_nulls_first(), "category", "code")
