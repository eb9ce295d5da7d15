import itertools

import pytest
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.operators import assessment, blocking, metrics, review
from tests.engine.builders import at, listing, none, observations


def pairs(df):
    return {(r.left_publication_id, r.right_publication_id): [m.rule_pos for m in r.matches] for r in df.collect()}


def test_two_passes_and_reasons(spark):
    rows = observations(
        spark, listing("a"), listing("b"), listing("c", rooms=None), listing("d", area=None, rooms=None), listing("e", loc="there"), listing("f", area="51"), listing("a", source="t"),
    )
    g = blocking.generate(rows, 100)
    assert g.ok()
    got = pairs(g.rows)
    assert got["a", "b"] == [0, 1] and got["a", "c"] == [1] and got["a", "e"] == [0] and got["a", "a"] == [0, 1]
    assert ("a", "f") not in got and all("d" not in p for p in got)
    reasons = {(r.publication_id, r.rule_pos): [(x.field, x.state) for x in r.reasons] for r in g.non_participations.collect()}
    assert reasons == {("c", 0): [("rooms", "missing")], ("d", 0): [("total_area", "missing"), ("rooms", "missing")], ("d", 1): [("total_area", "missing")]}


@pytest.mark.parametrize(("limit", "left_out"), [(6, 0), (5, 2)])
def test_a_bucket_beyond_the_limit_goes_whole(spark, limit, left_out):
    g = blocking.generate(observations(spark, *[listing(p) for p in "abcd"], listing("e", area="9"), listing("f", area="9")), limit)
    assert [(r.members, r.pairs, r.reason_code) for r in g.oversized.collect()] == [(4, 6, policies.OVERSIZED)] * left_out
    assert len(pairs(g.rows)) == (1 if left_out else 7)


def test_generation_conflicts(spark):
    codes = lambda g: [(r.code, r.publication_id) for r in blocking.ordered_conflicts(g.conflicts).collect()]
    rows = observations(spark, listing("a"), listing("a"), listing("b", 1), listing("b", 2), listing("c"), listing("c", price="7"), gone=(("d", 1, "off"),))
    assert codes(blocking.generate(rows, 0)) == [
        ("observation_not_available", "d"), ("observation_key_content_conflict", "c"), ("duplicate_publication_ref", "a"), ("duplicate_publication_ref", "b"), ("invalid_bucket_pair_limit", None),
    ]
    assert codes(blocking.generate(none(spark), True, "other@1")) == [("empty_generation_input", None), ("unsupported_candidate_policy", None), ("invalid_bucket_pair_limit", None)]
    both = observations(spark, listing("c"), listing("c", price="7"), listing("c", 2))
    assert codes(blocking.generate(both, 5)) == [("observation_key_content_conflict", "c"), ("duplicate_publication_ref", "c")]
    assert [blocking.configuration_conflicts(policies.CANDIDATE_POLICY, x)[0][1] for x in (None, True, -1, 0.5, float("nan"), "9")] == ["none:none", "bool:true", "int:-1", "float:0x1.0000000000000p-1", "float:nan", "unsupported:unsupported"]


def test_pairs_come_from_equi_joins(spark):
    plan = blocking.generate(observations(spark, listing("a")), 5).rows._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


SIDES = {
    "area": [("50", "50", "exact_total_area"), ("50", "51", "different_total_area"), (None, "50", "not_comparable_total_area")],
    "rooms": [("2", "2", "exact_room_count"), ("2", "studio", "different_room_count"), ("2", None, "not_comparable_rooms")],
    "loc": [("x", " x ", "exact_location_text"), ("x", "y", "free_text_mismatch_is_neutral"), (None, None, "not_comparable_location_text")],
    "price": [(("1", "RUB"), ("1", "RUB"), "exact_price_same_currency"), (("1", "RUB"), ("2", "RUB"), "price_difference_is_neutral"), (("1", "RUB"), ("1", "USD"), "not_comparable_price"), ((None, None), ("1", "RUB"), "not_comparable_price")],
}


def test_rules_and_outcomes_on_every_combination_both_ways(spark):
    cases = list(itertools.product(*SIDES.values()))
    left, right, want = [], [], {}
    for k, (area, rooms, loc, price) in enumerate(cases):
        for out, side in ((left, 0), (right, 1)):
            out.append(listing(f"{'lr'[side]}{k}", area=area[side], rooms=rooms[side], loc=loc[side], price=price[side][0], cur=price[side][1]))
        enough = area[2] == "exact_total_area" and (rooms[2] == "exact_room_count" or loc[2] == "exact_location_text")
        against = area[2] == "different_total_area" or rooms[2] == "different_room_count"
        want[f"l{k}"] = ({area[2], rooms[2], loc[2], price[2]}, policies.REVIEW_REQUIRED[1 if against else 0] if enough else policies.INSUFFICIENT)
    key = F.substring("publication_id", 2, 9).alias("k")
    struct = lambda n: F.struct("source_id", "publication_id", "observed_at", "is_available", "listing").alias(n)
    a = observations(spark, *left).select(key, struct("first"))
    b = observations(spark, *right).select(key, struct("second"))
    swapped = a.withColumnRenamed("first", "second").join(b.withColumnRenamed("second", "first"), "k").select("k", "first", "second")
    for rows in (a.join(b, "k"), swapped):
        got = assessment.assess_pairs(rows).collect()
        assert {r.left_publication_id: ({f.reason_code for f in (*r.evidence, *r.non_comparisons)}, r.outcome) for r in got} == want
        assert all([f.rule_id for f in r.evidence] == sorted((f.rule_id for f in r.evidence), key=[x.rule_id for x in policies.EVIDENCE_RULES].index) for r in got)


def test_pairs_that_are_not_assessed(spark):
    rows = observations(spark, listing("a"), listing("b"), gone=(("c", 1, "off"),))
    struct = lambda n: F.struct("source_id", "publication_id", "observed_at", "is_available", "listing").alias(n)
    both = rows.select(struct("first")).crossJoin(rows.select(struct("second")))
    got = {(r.left_publication_id, r.right_publication_id): (r.result, r.reason_code, r.outcome is None) for r in assessment.assess_pairs(both).collect()}
    assert got["a", "b"] == ("success", None, False) and got["a", "a"] == ("failure", "same_publication_ref", True) and got["a", "c"] == ("not_assessed", "side_not_available", True)


def test_batch_preflight_and_currency(spark):
    now = observations(spark, listing("a"), listing("b"), listing("c", area="9"))
    g = blocking.generate(now, 10)
    batch = assessment.assess_batch(g, now)
    assert batch.ok() and [r.outcome for r in batch.rows.collect()] == [policies.REVIEW_REQUIRED[0]]
    moved = observations(spark, listing("a", 2), listing("b"), listing("d"))
    kinds = {(r.publication_id, r.kind) for r in assessment.assess_batch(g, moved).key_conflicts.collect()}
    assert kinds == {("a", "CURRENT_KEY_MISMATCH"), ("c", "MISSING_GENERATION_KEY"), ("d", "EXTRA_CURRENT_KEY")}
    assert not assessment.assess_batch(g, moved).ok()
    assert {r.code for r in assessment.assess_batch(g, now, "other@1").conflicts.collect()} == {"unsupported_assessment_policy"}
    rows = batch.rows
    assert [r.is_current for r in assessment.is_current(rows, now).collect()] == [True]
    assert [r.is_current for r in assessment.is_current(rows, moved).collect()] == [False]
    assert [r.is_current for r in assessment.is_current(rows, now.where("publication_id <> 'b'")).collect()] == [False]
    assert assessment.tampered(rows, now).count() == 0
    assert assessment.tampered(rows.withColumn("outcome", F.lit("x")), now).count() == 1


def test_supplied_candidates_are_checked(spark):
    now = observations(spark, listing("a"), listing("b"), listing("c"))
    keys = now.select("source_id", "publication_id", "observed_at")
    made = lambda *rows: spark.createDataFrame([("s", l, "s", r, at(ld), at(rd), p, k) for k, (l, r, ld, rd, p) in enumerate(rows)],  # noqa: E731, E741
        "left_source_id string, left_publication_id string, right_source_id string, right_publication_id string, left_at timestamp, right_at timestamp, policy_version string, ordinal int")
    ok = policies.CANDIDATE_POLICY
    kinds = lambda df, current=None: {(r.left_publication_id, r.right_publication_id, r.kind) for r in assessment.binding_mismatches(df, keys, current).collect()}
    assert kinds(made(("a", "b", 1, 1, ok), ("b", "c", 1, 1, ok)), keys) == set()
    assert kinds(made(("b", "c", 1, 1, ok), ("a", "b", 1, 1, ok))) == {("b", "c", "NON_CANONICAL_CANDIDATE_ORDER"), ("a", "b", "NON_CANONICAL_CANDIDATE_ORDER")}
    assert kinds(made(("a", "b", 1, 1, "x@1"), ("a", "b", 1, 1, "x@1"))) == {("a", "b", "CANDIDATE_POLICY_MISMATCH"), ("a", "b", "DUPLICATE_CANDIDATE_IDENTITY")}
    assert kinds(made(("b", "a", 1, 1, ok))) == {("b", "a", "CANDIDATE_PAIR_KEY_MISMATCH")}
    assert kinds(made(("a", "b", 1, 2, ok)), keys) == {("a", "b", "CANDIDATE_PAIR_KEY_MISMATCH"), ("a", "b", "CANDIDATE_KEY_OUTSIDE_GENERATION"), ("a", "b", "CANDIDATE_KEY_OUTSIDE_CURRENT")}
    # A batch looks at the current keys just where they are the generation's.
    g = blocking.generate(now, 10)
    told = lambda df, current: {r.kind for r in assessment.assess_batch(g, current, supplied=df).binding_conflicts.collect()}
    stale = made(("a", "b", 1, 2, ok))
    assert told(made(("a", "b", 1, 1, ok), ("b", "c", 1, 1, ok)), now) == set()
    assert told(stale, now) == {"CANDIDATE_PAIR_KEY_MISMATCH", "CANDIDATE_KEY_OUTSIDE_GENERATION", "CANDIDATE_KEY_OUTSIDE_CURRENT"}
    assert told(stale, observations(spark, listing("a"), listing("b", 2), listing("c"))) == {"CANDIDATE_KEY_OUTSIDE_GENERATION"}
    assert {r.code for r in assessment.assess_batch(g, now, supplied=stale).conflicts.collect()} == {"candidate_binding_mismatch"}


DRAFT = (
    "code string, revision long, left_source_id string, left_publication_id string, right_source_id string, right_publication_id string, left_at timestamp, right_at timestamp, assessment_policy string, "
    "reviewed_at timestamp, reviewer string, outcome string, rationale_codes array<string>, references array<struct<kind:string,ordinal:int,rule_id:string,rule_version:string,polarity:string>>, "
    "supersedes_code string, supersedes_revision long"
)
AREA = ("EVIDENCE", 0, "total-area-comparison", "duplicate-total-area@1", "SUPPORTS")


def draft(revision=1, pair=("a", "b"), day=1, references=(AREA,), supersedes=None, outcome="CONFIRMED", code="r"):
    before = supersedes or ((code, revision - 1) if revision > 1 else (None, None))
    return (code, revision, "s", pair[0], "s", pair[1], at(1), at(1), policies.ASSESSMENT_POLICY, at(day), "me", outcome, ["x"], list(references), *before)


@pytest.mark.parametrize(
    ("stored", "new", "decision"),
    [
        ([], draft(), "CREATED"),
        ([], draft(references=()), "CREATED"),
        ([], draft(pair=("a", "z")), "review_assessment_mismatch"),
        ([], draft(references=[("EVIDENCE", 9, *AREA[2:])]), "review_assessment_mismatch"),
        ([], draft(references=[(*AREA[:4], "CONTRADICTS")]), "review_assessment_mismatch"),
        ([], draft(references=[("NON_COMPARISON", 0, "price-exact", "duplicate-price@1", None)]), "review_assessment_mismatch"),
        ([draft()], draft(), "REPLAYED"),
        ([draft()], draft(outcome="REJECTED"), "review_identity_content_conflict"),
        ([], draft(2), "review_revision_mismatch"),
        ([], draft(1, supersedes=("r", 0)), "review_revision_mismatch"),
        ([draft()], draft(2, day=2), "CREATED"),
        ([draft()], draft(2, day=1), "review_revision_mismatch"),
        ([draft()], draft(3, day=2), "review_revision_mismatch"),
        ([draft()], draft(2, day=2, supersedes=("q", 1)), "review_revision_mismatch"),
        ([draft()], draft(2, pair=("a", "c"), day=2), "review_assessment_mismatch"),
        ([draft(), draft(2, day=2)], draft(1), "review_revision_mismatch"),
    ],
)
def test_reviews(spark, stored, new, decision):
    now = observations(spark, *[listing(p) for p in "abc"])
    rows = assessment.assess_batch(blocking.generate(now, 10), now).rows
    got = review.create(spark.createDataFrame([new], DRAFT), rows, spark.createDataFrame(stored, DRAFT)).collect()
    assert [r.decision for r in got] == [decision]


def test_chains_and_supersessions(spark):
    rows = spark.createDataFrame([draft(), draft(2, day=2), draft(1, code="q"), draft(3, code="q")], DRAFT)
    assert {r.code: r.revision for r in review.chain_heads(rows).collect()} == {"r": 2, "q": 3}
    assert [(r.code, r.revision, r.expected) for r in review.broken_chains(rows).collect()] == [("q", 3, 2)]
    ident = lambda p, d: ("s", p[0], "s", p[1], at(d), at(d), policies.ASSESSMENT_POLICY)
    cols = [f"{s}_{c}" for s in ("previous", "replacement") for c in review.ASSESSMENT]
    links = spark.createDataFrame([(*ident("ab", 1), *ident("ab", 2)), (*ident("ab", 1), *ident("ab", 1)), (*ident("ab", 1), *ident("ac", 2))], cols)
    assert review.bad_supersessions(links).count() == 2


CASE = "left_source_id string, left_publication_id string, right_source_id string, right_publication_id string, left_at timestamp, right_at timestamp, policy_version string, result string, outcome string, label string"
YES, CONFLICT, NO = *policies.REVIEW_REQUIRED, policies.INSUFFICIENT
C, R, I = policies.LABELS  # noqa: E741


def cases(spark, *rows):
    return spark.createDataFrame([("s", f"l{k}", "s", f"r{k}", at(1), at(1), policies.ASSESSMENT_POLICY, "not_assessed" if o is None else "success", o, lab) for k, (o, lab) in enumerate(rows)], CASE)


@pytest.mark.parametrize(
    ("rows", "precision", "recall"),
    [
        ([(YES, C), (CONFLICT, R), (NO, C), (None, C)], (1, 2, None), (1, 3, None)),
        ([(NO, C), (None, R)], (None, None, "no_predicted_positive"), (0, 1, None)),
        ([(YES, I), (YES, C)], (None, None, "incomplete_predicted_positive_labels"), (None, None, "incomplete_population_labels")),
        ([(YES, C), (NO, I)], (1, 1, None), (None, None, "incomplete_population_labels")),
        ([(YES, R)], (0, 1, None), (None, None, "no_confirmed_relationship_labels")),
        ([(YES, C), (YES, C), (YES, R), (YES, R)], (2, 4, None), (2, 2, None)),
    ],
)
def test_quality(spark, rows, precision, recall):
    q = metrics.quality(cases(spark, *rows)).first()
    assert tuple(q.precision) == precision and tuple(q.recall) == recall
    assert tuple(q.review_load)[:2] == (sum(o in policies.REVIEW_REQUIRED for o, _ in rows), len(rows))
    assert q.assessed + q.not_assessed == q.population == len(rows)


def test_control_sets(spark):
    assert metrics.control_errors(cases(spark, (YES, C))).collect() == []
    assert {r.code for r in metrics.control_errors(cases(spark, (YES, C)).limit(0)).collect()} == {"empty_control_set"}
    bad = cases(spark, (YES, C), (YES, "MAYBE")).unionByName(cases(spark, (YES, R))).withColumn("policy_version", F.lit("x@1"))
    assert {r.code for r in metrics.control_errors(bad).collect()} == {"unsupported_label", "duplicate_pair", "policy_version_mismatch"}


def test_coverage_classes(spark):
    now = observations(
        spark, listing("a"), listing("b"), listing("c", area="9", rooms="3", loc="c"), listing("d", area="8", rooms="3", loc="d"),
        *[listing(f"o{k}", area="77", rooms=None, loc="big") for k in range(5)], listing("m", 2, area="60"), listing("n", area="60"),
    )
    stale = observations(spark, listing("m", 1, area="60"), listing("z", area="60"))
    g = blocking.generate(now, 6)
    everyone = now.unionByName(stale.where("publication_id <> 'm'"))
    struct = lambda n: F.struct("source_id", "publication_id", "observed_at", "is_available", "listing").alias(n)
    wanted = [("a", "b", C, True), ("c", "d", C, True), ("o0", "o1", C, True), ("m", "n", C, True), ("n", "z", C, True), ("a", "c", R, True), ("b", "d", C, False)]
    keys = spark.createDataFrame(wanted, "p string, q string, label string, ok boolean")
    first = everyone.where("publication_id <> 'm'").unionByName(stale.where("publication_id = 'm'"))
    rows = keys.join(first.select(F.col("publication_id").alias("p"), struct("first")), "p").join(first.select(F.col("publication_id").alias("q"), struct("second")), "q")
    rows = rows.withColumn("first", F.col("first").withField("is_available", F.col("ok")))
    done = assessment.assess_pairs(rows).withColumnRenamed("assessment_policy", "policy_version")
    side = rows.select(F.col("p").alias("left_publication_id"), F.col("q").alias("right_publication_id"), "label", F.col("first.listing").alias("left"), F.col("second.listing").alias("right"))
    labelled = done.join(side, ["left_publication_id", "right_publication_id"])
    c = metrics.coverage(labelled, g)
    assert {(r.left_publication_id, r.right_publication_id): r.kind for r in c.classes.collect()} == {
        ("a", "b"): "covered", ("c", "d"): "no_shared_key", ("o0", "o1"): "oversized_bucket", ("m", "n"): "stale_or_mismatched_keys", ("n", "z"): "outside_generation_input",
        ("a", "c"): "rejected_relationship", ("b", "d"): "pair_not_assessed",
    }
    assert c.ok() and tuple(c.rows.first().coverage) == (1, 3, None)
    lacking = blocking.Generation(g.rows.limit(0), g.conflicts, g.members, g.non_participations, g.oversized, g.input_keys, g.limit)
    assert [r.code for r in metrics.coverage(labelled, lacking).conflicts.collect()] == ["generation_result_inconsistent"]
    assert metrics.coverage(labelled.withColumn("label", F.lit(I)), g).rows.first().coverage.unavailable_reason == "inconclusive_control_labels"
    assert metrics.coverage(labelled.withColumn("label", F.lit(R)), g).rows.first().coverage.unavailable_reason == "no_eligible_confirmed_relationships"
