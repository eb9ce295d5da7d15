"""Duplicate candidates by exact blocking: two passes, whole buckets left out where they would make too many pairs.

Buckets are counted before anything is paired, so a large one costs a count; no plan here has a product. Input: source_id, publication_id,
observed_at and the outcomes total_area, rooms and location_text, one row per current available publication.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.functions.outcomes import is_present
from marlstone.operators.atomic import Result
from marlstone.operators.history import KEY, REF

CATEGORY = "DUPLICATE_CANDIDATE_GENERATION_CONFLICT"
BLOCK = ("rule_pos", "total_area", "rooms", "location_text")
IDENTITY = ("left_source_id", "left_publication_id", "right_source_id", "right_publication_id", "left_at", "right_at")


def _reasons(rule: policies.Rule) -> Column:
    """The components that keep an observation out of a pass, in the rule's order."""
    one = lambda f: F.when(
        ~is_present(F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f)["state"].alias("state"), F.col(f)["reason_code"].alias("reason_code"))
    )
    return F.array_compact(F.array(*[one(f) for f in rule.fields]))


def projected(current: DataFrame) -> DataFrame:
    """Each observation under each rule: its blocking key, or the reasons for having none. One scan for both passes."""
    one = lambda r: F.struct(
        F.lit(r.position).alias("rule_pos"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("rule_version"),
        F.col("total_area.value").alias("total_area"),
        (F.col("rooms.value") if "rooms" in r.fields else F.lit(None).cast("int")).alias("rooms"),
        (F.col("location_text.value") if "location_text" in r.fields else F.lit(None).cast("string")).alias("location_text"),
        _reasons(r).alias("reasons"),
    )
    return current.select(*KEY, F.explode(F.array(*[one(r) for r in policies.BLOCKING_RULES])).alias("p")).select(*KEY, "p.*")


def memberships(current: DataFrame) -> DataFrame:
    return projected(current).where(F.size("reasons") == 0).drop("reasons")


def non_participations(current: DataFrame) -> DataFrame:
    return projected(current).where(F.size("reasons") > 0).select(*KEY, "rule_pos", "rule_id", "rule_version", "reasons")


def buckets(members: DataFrame) -> DataFrame:
    """Blocking keys with their number of members and of pairs."""
    counted = members.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("members"))
    return counted.withColumn("pairs", F.shiftright(F.col("members") * (F.col("members") - 1), 1))


def oversized(members: DataFrame, limit: int) -> DataFrame:
    """Buckets with more pairs than the limit: left out whole, never cut."""
    return buckets(members).where(F.col("pairs") > limit).withColumn("reason_code", F.lit(policies.OVERSIZED))


def _keyed(members: DataFrame) -> DataFrame:
    """Members with join columns that are never null: a pass leaves one component out, and rule_pos tells the passes apart.

    Plain equality keeps one hash partitioning through the count, the semi join and the self join.
    """
    return members.withColumns({"_rooms": F.coalesce("rooms", F.lit(-1)), "_text": F.coalesce("location_text", F.lit(""))})


_JOIN = ("rule_pos", "total_area", "_rooms", "_text")


def candidates(members: DataFrame, limit: int) -> DataFrame:
    """Pairs that share a bucket within the limit, each once, with the keys that they share in order of the passes.

    A bucket of the limit L has at most (1 + sqrt(1 + 8 L)) / 2 members, so its members fit in one value, and pairing
    them needs no self join: members are shuffled once by key, pairs once by identity.
    """
    keyed = _keyed(members)
    n = F.col("members")
    usable = keyed.groupBy(*_JOIN).agg(F.count(F.lit(1)).alias("members")).where((n > 1) & (F.shiftright(n * (n - 1), 1) <= limit)).select(*_JOIN)
    kept = keyed.join(usable, list(_JOIN), "left_semi")
    member = F.struct(F.struct(*REF).alias("ref"), F.col("observed_at").alias("at"))
    lists = kept.groupBy(*_JOIN).agg(F.sort_array(F.collect_list(member)).alias("all"))
    left = lists.select("*", F.posexplode("all").alias("i", "l"))
    both = left.select("*", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("r")).where("l.ref < r.ref")
    match = F.struct(
        F.col("rule_pos"), F.col("total_area"), F.when(F.col("rule_pos") == 0, F.col("_rooms")).alias("rooms"), F.when(F.col("rule_pos") == 1, F.col("_text")).alias("location_text")
    )
    pairs = both.select(
        F.col("l.ref.source_id").alias("left_source_id"), F.col("l.ref.publication_id").alias("left_publication_id"),
        F.col("r.ref.source_id").alias("right_source_id"), F.col("r.ref.publication_id").alias("right_publication_id"),
        F.col("l.at").alias("left_at"), F.col("r.at").alias("right_at"), match.alias("match"),
    )
    return pairs.groupBy(*IDENTITY).agg(F.sort_array(F.collect_set("match")).alias("matches"))


def _subject(limit: Any) -> tuple[str, str]:
    """A limit that isn't one, as a type and a text that are safe to show."""
    if limit is None:
        return "none", "none"
    if type(limit) is bool:
        return "bool", str(limit).lower()
    if type(limit) is int:
        return "int", str(limit)
    if type(limit) is float:
        return "float", limit.hex() if limit == limit else "nan"
    return "unsupported", "unsupported"


def configuration_conflicts(policy: str, limit: Any) -> list[tuple[str, str]]:
    """(code, subject) of what is wrong with the parameters."""
    out = [] if policy == policies.CANDIDATE_POLICY else [("unsupported_candidate_policy", policy)]
    if type(limit) is not int or limit <= 0:
        out.append(("invalid_bucket_pair_limit", ":".join(_subject(limit))))
    return out


#: Conflict codes in their order.
CONFLICT_CODES = (
    "empty_generation_input", "observation_not_available", "observation_key_content_conflict", "duplicate_publication_ref",
    "unsupported_candidate_policy", "invalid_bucket_pair_limit",
)
_SHAPE = "code string, subject string, source_id string, publication_id string, observed_at timestamp, keys array<timestamp>"


def input_conflicts(observations: DataFrame, empty_code: str = "empty_generation_input", empty_subject: str = "generation_input") -> DataFrame:
    """What is wrong with supposed current observations (rows with is_available, listing, evidence).

    Unavailable ones; a key with several contents; a publication with several rows, unless they are one key whose
    contents differ, which is told already. Exact repeats are repeats here.
    """
    spark = observations.sparkSession
    none = F.lit(None)
    keys = none.cast("array<timestamp>")
    away = observations.where(~F.col("is_available")).select(F.lit("observation_not_available").alias("code"), F.lit("observation").alias("subject"), *KEY, keys.alias("keys"))
    there = observations.where("is_available")
    contents = there.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_json(F.struct("listing", "evidence"), {"ignoreNullFields": "false"})).alias("contents"))
    clash = contents.where("contents > 1").select(F.lit("observation_key_content_conflict").alias("code"), F.lit("observation").alias("subject"), *KEY, keys.alias("keys"))
    by_ref = contents.groupBy(*REF).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("moments"), F.max(F.col("contents")).alias("contents"),
        F.sort_array(F.flatten(F.collect_list(F.array_repeat("observed_at", F.col("n").cast("int"))))).alias("keys"),
    )
    repeated = by_ref.where((F.col("n") > 1) & ~((F.col("moments") == 1) & (F.col("contents") > 1))).select(
        F.lit("duplicate_publication_ref").alias("code"), F.lit("publication").alias("subject"), *REF, none.cast("timestamp").alias("observed_at"), "keys"
    )
    empty = spark.createDataFrame([(empty_code, empty_subject)], "code string, subject string").select(
        "code", "subject", none.cast("string").alias("source_id"), none.cast("string").alias("publication_id"), none.cast("timestamp").alias("observed_at"), keys.alias("keys")
    )
    empty = empty.join(F.broadcast(observations.limit(1).select(F.lit(empty_code).alias("code"))), "code", "left_anti").select(empty.columns)
    return away.distinct().unionByName(clash).unionByName(repeated).unionByName(empty)


@dataclass(frozen=True)
class Generation(Result):
    """Candidates as rows, with what took part in no pass and the buckets left out."""

    members: DataFrame
    non_participations: DataFrame
    oversized: DataFrame
    input_keys: DataFrame
    limit: int
    policy: str = policies.CANDIDATE_POLICY


def generate(observations: DataFrame, limit: Any, policy: str = policies.CANDIDATE_POLICY) -> Generation:
    """Candidates of current available observations, or every conflict of input and parameters together."""
    spark = observations.sparkSession
    bad = configuration_conflicts(policy, limit)
    conflicts = input_conflicts(observations).unionByName(spark.createDataFrame([(*c, None, None, None, None) for c in bad], _SHAPE))
    usable = limit if not bad else 1
    current = observations.select(*KEY, "listing.total_area", "listing.rooms", "listing.location_text")
    members = memberships(current)
    return Generation(
        candidates(members, usable), conflicts.withColumn("category", F.lit(CATEGORY)), members, non_participations(current),
        oversized(members, usable), observations.select(*KEY), usable, policy,
    )


def ordered_conflicts(conflicts: DataFrame, codes: tuple[str, ...] = CONFLICT_CODES) -> DataFrame:
    """By the code's place, then the subject."""
    place = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("code"))
    return conflicts.orderBy(place, *REF, "observed_at", "keys", "subject")


def candidate_order() -> list[str]:
    """Candidates are in order of both references, then of both moments."""
    return list(IDENTITY)


def non_participation_order() -> list[str]:
    """Observations in order of their keys, each under the passes in turn."""
    return [*KEY, "rule_pos"]
