"""Exact quality and coverage of policies on labelled pairs: counts in one pass, ratios as integer pairs, no doubles.

A control case: the pair (PAIR columns), policy_version, result (success or not_assessed), outcome of a success, its
keys (left_at, right_at), label. A metric is a struct of numerator, denominator and the reason why there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.functions.outcomes import same_value
from marlstone.operators import blocking
from marlstone.operators.atomic import Result
from marlstone.operators.blocking import BLOCK, IDENTITY
from marlstone.operators.history import REF
from marlstone.sources.tables import written

PAIR = IDENTITY[:4]
CONFIRMED, REJECTED, INCONCLUSIVE = policies.LABELS
_METRIC = "struct<numerator:bigint,denominator:bigint,unavailable_reason:string>"


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _ratio(numerator: Column, denominator: Column, *reasons: tuple[Column, str]) -> Column:
    """numerator of denominator, unless a reason holds; the first one counts."""
    why = F.lit(None).cast("string")
    for when, reason in reversed(reasons):
        why = F.when(when, reason).otherwise(why)
    return F.struct(F.when(why.isNull(), numerator), F.when(why.isNull(), denominator), why).cast(_METRIC)


def control_errors(cases: DataFrame, policy: str = policies.ASSESSMENT_POLICY) -> DataFrame:
    """What keeps cases from being a control set: a row per code, empty if nothing does."""
    ref = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in REF])
    seen = cases.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    checks = cases.agg(
        _count(~F.col("label").isin(*policies.LABELS) | F.col("label").isNull()).alias("unsupported_label"),
        _count(~F.col("result").isin("success", "not_assessed") | F.col("result").isNull()).alias("unsupported_result"),
        _count(~F.col("policy_version").eqNullSafe(F.lit(policy))).alias("policy_version_mismatch"),
        _count(~(ref("left") < ref("right"))).alias("pair_binding_mismatch"),
        (F.count(F.lit(1)) == 0).cast("long").alias("empty_control_set"),
    )
    names = checks.columns
    rows = checks.select(F.explode(F.array(*[F.struct(F.lit(n).alias("code"), F.col(n).alias("n")) for n in names])).alias("c")).select("c.*")
    repeated = seen.where("n > 1").select(F.lit("duplicate_pair").alias("code"), F.col("n").cast("long")).groupBy("code").agg(F.sum("n").alias("n"))
    return rows.where("n > 0").unionByName(repeated)


def case_order() -> list[str]:
    """Control cases are in order of their pairs."""
    return list(PAIR)


def quality(cases: DataFrame) -> DataFrame:
    """One row: counts, assessment coverage, precision, recall and the share of pairs to review."""
    label, done = F.col("label"), F.col("result") == "success"
    review = done & F.col("outcome").isin(*policies.REVIEW_REQUIRED)
    candidate, conflicting = policies.REVIEW_REQUIRED
    n = cases.agg(
        F.count(F.lit(1)).alias("population"), _count(done).alias("assessed"), _count(F.col("result") == "not_assessed").alias("not_assessed"),
        _count(done & (F.col("outcome") == candidate)).alias("candidate"), _count(done & (F.col("outcome") == conflicting)).alias("conflicting"),
        _count(done & (F.col("outcome") == policies.INSUFFICIENT)).alias("insufficient"),
        _count(label == CONFIRMED).alias("confirmed"), _count(label == REJECTED).alias("rejected"), _count(label == INCONCLUSIVE).alias("inconclusive"),
        _count(review).alias("review_required"), _count(review & (label == CONFIRMED)).alias("review_confirmed"),
        _count(review & (label == INCONCLUSIVE)).alias("review_inconclusive"),
    )
    c = F.col
    precision = _ratio(c("review_confirmed"), c("review_required"), (c("review_required") == 0, "no_predicted_positive"), (c("review_inconclusive") > 0, "incomplete_predicted_positive_labels"))
    recall = _ratio(c("review_confirmed"), c("confirmed"), (c("inconclusive") > 0, "incomplete_population_labels"), (c("confirmed") == 0, "no_confirmed_relationship_labels"))
    return n.select(
        "*", precision.alias("precision"), recall.alias("recall"), _ratio(c("assessed"), c("population")).alias("assessment_coverage"),
        _ratio(c("review_required"), c("population")).alias("review_load"),
    )


def shared_keys(left: Column, right: Column) -> Column:
    """The blocking keys that two listings share, in order of the passes."""
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    key = lambda r, rooms, text: F.struct(F.lit(r.position).alias("rule_pos"), left["total_area"]["value"].alias("total_area"), rooms.alias("rooms"), text.alias("location_text"))
    first, second = policies.BLOCKING_RULES
    area = same_value(left["total_area"], right["total_area"])
    by_rooms = F.when(area & same_value(left["rooms"], right["rooms"]), key(first, left["rooms"]["value"], none_text))
    by_text = F.when(area & same_value(left["location_text"], right["location_text"]), key(second, none_int, left["location_text"]["value"]))
    return F.array_compact(F.array(by_rooms, by_text))


@dataclass(frozen=True)
class Coverage(Result):
    """One row of counts and the coverage; conflicts are pairs that the generation should have had."""

    classes: DataFrame


def coverage(cases: DataFrame, generation: blocking.Generation) -> Coverage:
    """How many confirmed pairs a generation has as candidates, and why it hasn't the others.

    ``cases`` also have ``left`` and ``right`` (listings as assessed). Each confirmed case is of the first class that
    holds: not assessed, outside the input, stale keys, covered, no shared key, all shared keys in buckets left out.
    Anything else contradicts the generation.
    """
    rows = cases
    for s in ("left", "right"):
        now = generation.input_keys.select(*[F.col(c).alias(f"{s}_{c}") for c in REF], F.col("observed_at").alias(f"_{s}_now"))
        rows = rows.join(now, [f"{s}_{c}" for c in REF], "left")
    rows = rows.join(generation.rows.select(*IDENTITY, F.lit(True).alias("_candidate")), list(IDENTITY), "left")
    # Written, since it is needed twice: the keys that are shared, in place of the listings they come from.
    rows = written(rows.withColumn("_shared", shared_keys(F.col("left"), F.col("right"))).select(*IDENTITY, "label", "result", "_left_now", "_right_now", "_candidate", "_shared"))
    # A case's shared keys against the buckets left out; members share the key by construction, so the key decides.
    over = generation.oversized.select(*[F.col(k).alias(f"o_{k}") for k in BLOCK])
    exploded = rows.where(F.col("_candidate").isNull() & (F.size("_shared") > 0)).select(*PAIR, F.explode("_shared").alias("k"))
    match = F.lit(True)
    for k in BLOCK:
        match = match & F.col(f"k.{k}").eqNullSafe(F.col(f"o_{k}"))
    left_out = exploded.join(over, match).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_left_out"))
    rows = rows.join(left_out, list(PAIR), "left")
    current = F.col("_left_now").eqNullSafe(F.col("left_at")) & F.col("_right_now").eqNullSafe(F.col("right_at"))
    kind = (
        F.when(F.col("label") != CONFIRMED, F.lower("label"))
        .when(F.col("result") != "success", "pair_not_assessed")
        .when(F.col("_left_now").isNull() | F.col("_right_now").isNull(), "outside_generation_input")
        .when(~current, "stale_or_mismatched_keys")
        .when(F.col("_candidate"), "covered")
        .when(F.size("_shared") == 0, "no_shared_key")
        .when(F.coalesce("_left_out", F.lit(0)) == F.size("_shared"), "oversized_bucket")
        .otherwise("generation_result_inconsistent")
    )
    classes = rows.select(*IDENTITY, "label", "result", kind.alias("kind"))
    k = F.col("kind")
    eligible = k.isin("covered", "no_shared_key", "oversized_bucket", "generation_result_inconsistent")
    n = classes.agg(
        F.count(F.lit(1)).alias("population"), _count(F.col("result") == "not_assessed").alias("not_assessed"), _count(F.col("label") == REJECTED).alias("rejected"),
        _count(F.col("label") == INCONCLUSIVE).alias("inconclusive"), _count(F.col("label") == CONFIRMED).alias("confirmed"),
        _count(k == "pair_not_assessed").alias("confirmed_not_assessed"), _count(k == "outside_generation_input").alias("outside_input"),
        _count(k == "stale_or_mismatched_keys").alias("stale"), _count(eligible).alias("eligible"), _count(k == "covered").alias("covered"),
        _count(k == "no_shared_key").alias("no_shared_key"), _count(k == "oversized_bucket").alias("oversized"),
    )
    ratio = _ratio(F.col("covered"), F.col("eligible"), (F.col("inconclusive") > 0, "inconclusive_control_labels"), (F.col("eligible") == 0, "no_eligible_confirmed_relationships"))
    conflicts = classes.where(k == "generation_result_inconsistent").select(
        F.lit("DUPLICATE_CANDIDATE_COVERAGE_CONFLICT").alias("category"), k.alias("code"), *IDENTITY
    ).orderBy(*IDENTITY)
    return Coverage(n.withColumn("coverage", ratio), conflicts, classes)
