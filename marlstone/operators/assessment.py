"""Evidence on pairs: four rules as expressions over both sides' outcomes, in one projection per pair.

A finding is a struct: rule_id, rule_version, kind (EVIDENCE or NON_COMPARISON), polarity, strength, compared fields, both
sides' snapshots and a reason. A batch is two equi joins of the candidates with the current observations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.functions.outcomes import is_present
from marlstone.operators import blocking
from marlstone.operators.atomic import Result
from marlstone.operators.blocking import IDENTITY
from marlstone.operators.history import KEY, REF

AREA, ROOMS, LOCATION, PRICE = policies.EVIDENCE_RULES
SUPPORTS, CONTRADICTS = "SUPPORTS", "CONTRADICTS"
MATERIAL, CORROBORATING, AUXILIARY = "MATERIAL", "CORROBORATING", "AUXILIARY"
COMPARED = ("total_area", "rooms", "location_text", "price_amount", "currency")


def _finding(rule: policies.Rule, left: Column, right: Column, verdict: Column) -> Column:
    """The verdict (polarity, strength, reason) with what it rests on; without a polarity it is no comparison."""
    sides = lambda side: F.to_json(F.struct(*[side[f].alias(f) for f in rule.fields]))
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.version).alias("rule_version"),
        F.when(verdict["polarity"].isNull(), "NON_COMPARISON").otherwise("EVIDENCE").alias("kind"),
        verdict["polarity"].alias("polarity"), verdict["strength"].alias("strength"),
        F.array(*[F.lit(f) for f in rule.fields]).alias("compared_fields"),
        sides(left).alias("left_snapshots"), sides(right).alias("right_snapshots"), verdict["reason"].alias("reason_code"),
    )


def _verdict(polarity: str | None, strength: str | None, reason: str) -> Column:
    return F.struct(F.lit(polarity).cast("string").alias("polarity"), F.lit(strength).cast("string").alias("strength"), F.lit(reason).alias("reason"))


def _neutral(reason: str) -> Column:
    return _verdict(None, None, reason)


def verdicts(left: Column, right: Column) -> list[Column]:
    """The verdicts of the four rules, in policy order."""
    both = lambda *fields: [is_present(s[f]) for s in (left, right) for f in fields]
    apart = lambda conditions: ~(conditions[0] & conditions[1] if len(conditions) == 2 else conditions[0] & conditions[1] & conditions[2] & conditions[3])
    equal = lambda f: left[f]["value"] == right[f]["value"]
    return [
        F.when(apart(both("total_area")), _neutral("not_comparable_total_area"))
        .when(equal("total_area"), _verdict(SUPPORTS, MATERIAL, "exact_total_area"))
        .otherwise(_verdict(CONTRADICTS, MATERIAL, "different_total_area")),
        F.when(apart(both("rooms")), _neutral("not_comparable_rooms"))
        .when(equal("rooms"), _verdict(SUPPORTS, CORROBORATING, "exact_room_count"))
        .otherwise(_verdict(CONTRADICTS, MATERIAL, "different_room_count")),
        F.when(apart(both("location_text")), _neutral("not_comparable_location_text"))
        .when(equal("location_text"), _verdict(SUPPORTS, CORROBORATING, "exact_location_text"))
        .otherwise(_neutral("free_text_mismatch_is_neutral")),
        F.when(apart(both("price_amount", "currency")), _neutral("not_comparable_price"))
        .when(~equal("currency"), _neutral("currency_difference_is_neutral"))
        .when(equal("price_amount"), _verdict(SUPPORTS, AUXILIARY, "exact_price_same_currency"))
        .otherwise(_neutral("price_difference_is_neutral")),
    ]


def findings(left: Column, right: Column) -> Column:
    return F.array(*[_finding(r, left, right, v) for r, v in zip(policies.EVIDENCE_RULES, verdicts(left, right), strict=True)])


def automatic_outcome(found: Column) -> Column:
    """What the evidence asks for: equal area and equal rooms or location first, then whether anything material contradicts."""
    area = F.exists(found, lambda f: (f["rule_id"] == AREA.rule_id) & (f["polarity"] == SUPPORTS) & (f["strength"] == MATERIAL))
    other = F.exists(found, lambda f: f["rule_id"].isin(ROOMS.rule_id, LOCATION.rule_id) & (f["polarity"] == SUPPORTS) & (f["strength"] == CORROBORATING))
    against = F.exists(found, lambda f: (f["polarity"] == CONTRADICTS) & (f["strength"] == MATERIAL))
    yes = lambda c: F.coalesce(c, F.lit(False))
    candidate, conflicting = policies.REVIEW_REQUIRED
    return F.when(~(yes(area) & yes(other)), policies.INSUFFICIENT).when(yes(against), conflicting).otherwise(candidate)


def assessed(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Pairs with both listings as structs, with evidence, non_comparisons and outcome."""
    found = pairs.withColumn("_found", findings(F.col(left), F.col(right)))
    # The outcome rests on the verdicts alone: where only it is asked for, no snapshot is made.
    bare = [F.struct(F.lit(r.rule_id).alias("rule_id"), v["polarity"].alias("polarity"), v["strength"].alias("strength")) for r, v in zip(policies.EVIDENCE_RULES, verdicts(F.col(left), F.col(right)), strict=True)]
    return (
        found.withColumn("evidence", F.filter("_found", lambda f: f["kind"] == "EVIDENCE"))
        .withColumn("non_comparisons", F.filter("_found", lambda f: f["kind"] == "NON_COMPARISON"))
        .withColumn("outcome", automatic_outcome(F.array(*bare)))
        .withColumn("assessment_policy", F.lit(policies.ASSESSMENT_POLICY))
        .drop("_found")
    )


def assess_pairs(pairs: DataFrame) -> DataFrame:
    """Any two observations a row, as structs ``first`` and ``second`` (key, is_available, listing), in either order.

    ``result`` is success, not_assessed (a side isn't available) or failure (one publication with itself).
    """
    ref = lambda c: F.struct(*[c[k] for k in REF])
    a, b = F.col("first"), F.col("second")
    rows = pairs.withColumn("_swap", ref(a) > ref(b))
    rows = rows.withColumn("_l", F.when(F.col("_swap"), b).otherwise(a)).withColumn("_r", F.when(F.col("_swap"), a).otherwise(b))
    result = F.when(ref(a) == ref(b), "failure").when(~(a["is_available"] & b["is_available"]), "not_assessed").otherwise("success")
    rows = assessed(rows.withColumn("left", F.col("_l.listing")).withColumn("right", F.col("_r.listing"))).withColumn("result", result)
    only = lambda c: F.when(F.col("result") == "success", F.col(c)).alias(c)
    reason = F.when(F.col("result") == "failure", "same_publication_ref").when(F.col("result") == "not_assessed", "side_not_available")
    sides = [F.col(f"_{s[0]}.{k}").alias(f"{s}_{'at' if k == 'observed_at' else k}") for s in ("left", "right") for k in KEY]
    return rows.select(*sides, "result", reason.alias("reason_code"), only("evidence"), only("non_comparisons"), only("outcome"), "assessment_policy")


def is_current(assessments: DataFrame, current_keys: DataFrame, policy: str = policies.ASSESSMENT_POLICY) -> DataFrame:
    """``is_current``: both sides' keys are the current ones and the policy is the current one; otherwise it is stale."""
    side = lambda s: current_keys.select(*[F.col(c).alias(f"{s}_{c}") for c in REF], F.col("observed_at").alias(f"_{s}_now"))
    rows = assessments
    for s in ("left", "right"):
        rows = rows.join(side(s), [f"{s}_{c}" for c in REF], "left")
    fits = F.col("left_at").eqNullSafe(F.col("_left_now")) & F.col("right_at").eqNullSafe(F.col("_right_now")) & (F.col("assessment_policy") == policy)
    return rows.withColumn("is_current", fits & F.col("left_at").isNotNull()).drop("_left_now", "_right_now")


# Batches

CATEGORY = "DUPLICATE_CANDIDATE_ASSESSMENT_BATCH_CONFLICT"
#: Conflict codes in their order.
BATCH_CODES = (
    "empty_current_observations", "observation_not_available", "observation_key_content_conflict", "duplicate_publication_ref",
    "unsupported_candidate_policy", "unsupported_assessment_policy", "generation_current_keys_mismatch", "candidate_binding_mismatch",
)


def key_mismatches(generation_keys: DataFrame, current_keys: DataFrame) -> DataFrame:
    """Publications whose key isn't the same on both sides of a full outer join, with what is wrong."""
    g = generation_keys.select(*REF, F.col("observed_at").alias("generation_at"))
    c = current_keys.select(*REF, F.col("observed_at").alias("current_at"))
    kind = (
        F.when(F.col("current_at").isNull(), "MISSING_GENERATION_KEY")
        .when(F.col("generation_at").isNull(), "EXTRA_CURRENT_KEY")
        .when(F.col("generation_at") != F.col("current_at"), "CURRENT_KEY_MISMATCH")
    )
    return g.join(c, list(REF), "full_outer").withColumn("kind", kind).where("kind IS NOT NULL")


def binding_mismatches(candidates: DataFrame, generation_keys: DataFrame, current_keys: DataFrame | None = None, policy: str = policies.CANDIDATE_POLICY) -> DataFrame:
    """What is wrong with supplied candidates (identity columns, policy_version, ordinal): a row for each kind.

    ``current_keys`` only where they are just the generation's; then a candidate's keys must be the current ones too.
    """
    key = lambda s: [f"{s}_{c}" for c in REF] + [f"{s}_at"]
    rows = candidates
    flags = []
    for s in ("left", "right"):
        known = generation_keys.select(*[F.col(c).alias(f"{s}_{c}") for c in REF], F.col("observed_at").alias(f"{s}_at"), F.lit(True).alias(f"_{s}_known"))
        rows = rows.join(known, key(s), "left")
        if current_keys is not None:
            now = current_keys.select(*[F.col(c).alias(f"{s}_{c}") for c in REF], F.col("observed_at").alias(f"_{s}_now"))
            rows = rows.join(now, [f"{s}_{c}" for c in REF], "left")
    outside = F.col("_left_known").isNull() | F.col("_right_known").isNull()
    ref = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in REF])
    bad_pair = ~(ref("left") < ref("right"))
    if current_keys is not None:
        both = F.col("_left_now").isNotNull() & F.col("_right_now").isNotNull()
        moved = (F.col("left_at") != F.col("_left_now")) | (F.col("right_at") != F.col("_right_now"))
        bad_pair = bad_pair | (both & moved)
        stale = ~(F.col("left_at").eqNullSafe(F.col("_left_now")) & F.col("right_at").eqNullSafe(F.col("_right_now")))
        flags.append(("CANDIDATE_KEY_OUTSIDE_CURRENT", stale))
    same = Window.partitionBy(*IDENTITY, "policy_version")
    rows = rows.withColumn("_times", F.count(F.lit(1)).over(same))
    # Neighbours in the supplied order: the neighbour's identity comes by a join on the ordinal, so no window holds all rows.
    order = F.struct(*IDENTITY, "policy_version")
    placed = rows.select("ordinal", order.alias("_own"))
    before = placed.select((F.col("ordinal") + 1).alias("ordinal"), F.col("_own").alias("_before"))
    after = placed.select((F.col("ordinal") - 1).alias("ordinal"), F.col("_own").alias("_after"))
    rows = rows.join(before, "ordinal", "left").join(after, "ordinal", "left")
    unordered = F.coalesce(order < F.col("_before"), F.lit(False)) | F.coalesce(F.col("_after") < order, F.lit(False))
    flags = [
        ("CANDIDATE_POLICY_MISMATCH", F.col("policy_version") != policy), ("CANDIDATE_PAIR_KEY_MISMATCH", bad_pair),
        ("CANDIDATE_KEY_OUTSIDE_GENERATION", outside), *flags, ("DUPLICATE_CANDIDATE_IDENTITY", F.col("_times") > 1),
        ("NON_CANONICAL_CANDIDATE_ORDER", unordered),
    ]
    kinds = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind_pos"), F.lit(n).alias("kind"))) for k, (n, c) in enumerate(flags)]))
    return rows.select(*IDENTITY, "policy_version", F.explode(kinds).alias("k")).select(*IDENTITY, "policy_version", "k.*").distinct()


@dataclass(frozen=True)
class Batch(Result):
    """Assessed candidates; ``key_conflicts`` and ``binding_conflicts`` have the subjects of those two codes."""

    key_conflicts: DataFrame
    binding_conflicts: DataFrame


def assess_batch(generation: blocking.Generation, current: DataFrame, policy: str = policies.ASSESSMENT_POLICY, supplied: DataFrame | None = None) -> Batch:
    """All candidates of a generation, assessed on the current observations, or every conflict of the preflight.

    ``supplied``: candidates that come from elsewhere, with policy_version and ordinal; they are checked against the
    generation. Its own need no such check. Joins of current observations with candidates run only past the gate.
    """
    spark = current.sparkSession
    conflicts = blocking.input_conflicts(current, "empty_current_observations", "current_observations")
    extra = [("unsupported_candidate_policy", generation.policy)] if generation.policy != policies.CANDIDATE_POLICY else []
    extra += [("unsupported_assessment_policy", policy)] if policy != policies.ASSESSMENT_POLICY else []
    conflicts = conflicts.unionByName(spark.createDataFrame([(*c, None, None, None, None) for c in extra], blocking._SHAPE))
    keys = key_mismatches(generation.input_keys, current.select(*KEY).distinct())
    none = F.lit(None)
    by_key = keys.select(
        F.lit("generation_current_keys_mismatch").alias("code"), F.col("kind").alias("subject"), *REF, F.col("generation_at").alias("observed_at"),
        F.array("generation_at", "current_at").alias("keys"),
    )
    conflicts = conflicts.unionByName(by_key)
    if supplied is None:
        bindings = generation.rows.limit(0).select(*IDENTITY, none.cast("string").alias("policy_version"), none.cast("int").alias("kind_pos"), none.cast("string").alias("kind"))
        pairs = generation.rows
    else:
        # Where the current keys are the generation's, and nothing is wrong with them, a candidate's must be the current ones too.
        held = blocking.input_conflicts(current, "empty_current_observations", "current_observations").isEmpty() and keys.isEmpty()
        bindings = binding_mismatches(supplied, generation.input_keys, current.select(*KEY).distinct() if held else None)
        conflicts = conflicts.unionByName(
            bindings.select(F.lit("candidate_binding_mismatch").alias("code"), F.col("kind").alias("subject"), F.col("left_source_id").alias("source_id"),
                            F.col("left_publication_id").alias("publication_id"), F.col("left_at").alias("observed_at"), F.array("left_at", "right_at").alias("keys"))
        )
        pairs = supplied.select(*IDENTITY)
    side = lambda s: current.select(*[F.col(c).alias(f"{s}_{c}") for c in REF], F.col("listing").alias(s))
    joined = pairs.join(side("left"), [f"left_{c}" for c in REF]).join(side("right"), [f"right_{c}" for c in REF])
    return Batch(assessed(joined), conflicts.withColumn("category", F.lit(CATEGORY)), keys, bindings)


def tampered(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored assessments whose findings or outcome aren't what the observations give: an integrity check before commits."""
    side = lambda s: current.select(*[F.col(c).alias(f"{s}_{c}") for c in REF], F.col("observed_at").alias(f"{s}_at"), F.col("listing").alias(f"_{s}"))
    key = lambda s: [f"{s}_{c}" for c in REF] + [f"{s}_at"]
    rows = stored.withColumnsRenamed({"evidence": "_e", "non_comparisons": "_n", "outcome": "_o"})
    rows = rows.join(side("left"), key("left"), "left").join(side("right"), key("right"), "left")
    again = assessed(rows, "_left", "_right")
    fits = F.col("_e").eqNullSafe(F.col("evidence")) & F.col("_n").eqNullSafe(F.col("non_comparisons")) & F.col("_o").eqNullSafe(F.col("outcome"))
    return again.where(~fits | F.col("_left").isNull() | F.col("_right").isNull()).select(*IDENTITY, F.col("_o").alias("stored"), F.col("outcome").alias("expected"))


