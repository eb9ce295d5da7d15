"""Manual reviews: append-only chains of revisions, bound to assessments, decided by one ordered CASE per draft.

A draft or review row: code, revision, the assessment's identity (IDENTITY columns and assessment_policy), reviewed_at,
reviewer, outcome, rationale_codes, references (array of kind, ordinal, rule_id, rule_version, polarity), supersedes_code
and supersedes_revision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.blocking import IDENTITY

CATEGORY = "MANUAL_REVIEW_CONFLICT"
ASSESSMENT = (*IDENTITY, "assessment_policy")
PAIR = IDENTITY[:4]
CONTENT = (*ASSESSMENT, "reviewed_at", "reviewer", "outcome", "rationale_codes", "references", "supersedes_code", "supersedes_revision")


def reference_fits(reference: Column, evidence: Column, non_comparisons: Column) -> Column:
    """Does a reference name a finding that is there, with its rule, version and polarity?"""
    at = reference["ordinal"] + 1
    fits = lambda found, polarity: (
        (at >= 1) & (at <= F.size(found)) & (F.try_element_at(found, at)["rule_id"] == reference["rule_id"])
        & (F.try_element_at(found, at)["rule_version"] == reference["rule_version"]) & polarity(F.try_element_at(found, at))
    )
    good = F.when(reference["kind"] == "EVIDENCE", fits(evidence, lambda f: f["polarity"].eqNullSafe(reference["polarity"]))).otherwise(
        fits(non_comparisons, lambda f: reference["polarity"].isNull())
    )
    return F.coalesce(good, F.lit(False))


def create(drafts: DataFrame, assessments: DataFrame, reviews: DataFrame) -> DataFrame:
    """``decision`` for each draft: CREATED, REPLAYED or the conflict's code.

    ``reviews`` are the stored ones; a draft's previous review is the chain's head. In order: the assessment and every
    referenced finding must be there; the head's identity again is a replay or a conflict of content; the first revision
    stands alone; a later one supersedes just the one before, at a later moment, on the same pair.
    """
    bound = assessments.select(*ASSESSMENT, F.lit(True).alias("_bound"), F.col("evidence").alias("_evidence"), F.col("non_comparisons").alias("_non"))
    rest = F.struct("revision", *CONTENT)
    head = reviews.groupBy("code").agg(F.max_by(rest, "revision").alias("_head"))
    rows = drafts.join(bound, list(ASSESSMENT), "left").join(head, "code", "left")
    mismatch = F.col("_bound").isNull() | F.exists("references", lambda r: ~reference_fits(r, F.col("_evidence"), F.col("_non")))
    h = F.col("_head")
    again = h.isNotNull() & (h["revision"] == F.col("revision"))
    equal = F.struct(*[h[c].alias(c) for c in CONTENT]).eqNullSafe(F.struct(*CONTENT))
    alone = F.col("supersedes_code").isNull() & F.col("supersedes_revision").isNull()
    follows = (
        F.col("supersedes_code").eqNullSafe(F.col("code")) & F.col("supersedes_revision").eqNullSafe(F.col("revision") - 1)
        & h.isNotNull() & (h["revision"] == F.col("revision") - 1) & (F.col("reviewed_at") > h["reviewed_at"])
    )
    pair = F.struct(*[h[c].alias(c) for c in PAIR]).eqNullSafe(F.struct(*PAIR))
    decision = (
        F.when(F.coalesce(mismatch, F.lit(True)), "review_assessment_mismatch")
        .when(again & equal, "REPLAYED")
        .when(again, "review_identity_content_conflict")
        .when((F.col("revision") == 1) & (~alone | h.isNotNull()), "review_revision_mismatch")
        .when((F.col("revision") > 1) & ~F.coalesce(follows, F.lit(False)), "review_revision_mismatch")
        .when((F.col("revision") > 1) & ~pair, "review_assessment_mismatch")
        .otherwise("CREATED")
    )
    return rows.withColumn("decision", decision).drop("_bound", "_evidence", "_non", "_head")


def chain_heads(reviews: DataFrame) -> DataFrame:
    """The latest revision of each chain: an aggregate."""
    rest = [c for c in reviews.columns if c != "code"]
    return reviews.groupBy("code").agg(F.max_by(F.struct(*rest), "revision").alias("h")).select("code", "h.*")


def broken_chains(reviews: DataFrame) -> DataFrame:
    """Revisions that don't run 1, 2, 3 and on without a gap or repeat."""
    w = Window.partitionBy("code").orderBy("revision")
    return reviews.withColumn("expected", F.row_number().over(w)).where("expected <> revision")


def bad_supersessions(links: DataFrame) -> DataFrame:
    """Links from an assessment to its replacement that join different pairs or an assessment with itself.

    Columns: previous_ and replacement_ before each column of ASSESSMENT.
    """
    part = lambda s, cols: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in cols])
    same = part("previous", ASSESSMENT).eqNullSafe(part("replacement", ASSESSMENT))
    other = ~part("previous", PAIR).eqNullSafe(part("replacement", PAIR))
    return links.where(same | other)
