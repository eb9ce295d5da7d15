import itertools
import random

import pytest

from marlstone.operators import history
from tests.engine.builders import at, listing, none, observations


def sets(df):
    return {(r.publication_id, r.from_at.day, r.to_at.day): (r.transition, [(d.field, d.kind) for d in r.deltas], r.evidence_changed) for r in df.collect()}


def test_changes_between_neighbours(spark):
    rows = observations(
        spark, listing("a", 1), listing("a", 2, loc="  here "), listing("a", 3, price="200", rooms="studio", cur="USD"), listing("a", 6), listing("b", 1), listing("b", 2, url="https://h/y", area=None),
        gone=(("a", 4, "off"), ("a", 5, "removed"), ("b", 3, "off"), ("b", 4, "off")),
    )
    assert sets(history.changes(rows)) == {
        ("a", 1, 2): (None, [("location_text", "SOURCE_REPRESENTATION_ONLY")], False),
        ("a", 2, 3): (None, [("location_text", "SOURCE_REPRESENTATION_ONLY"), ("price_amount", "SUBSTANTIVE"), ("currency", "SUBSTANTIVE"), ("rooms", "SUBSTANTIVE")], False),
        ("a", 3, 4): ("confirmed_unavailable", [], False), ("a", 4, 5): (None, [], True), ("a", 5, 6): ("reappeared", [], False),
        ("b", 1, 2): (None, [("source_url", "SUBSTANTIVE"), ("total_area", "SUBSTANTIVE")], False),
        ("b", 2, 3): ("confirmed_unavailable", [], False), ("b", 3, 4): (None, [], False),
    }


@pytest.mark.parametrize("unit", ["hour", "week", "year"])
def test_long_histories_may_be_spread_over_tasks(spark, unit):
    rows = observations(spark, *[listing(p, d, price=str(1 + d % 3)) for p in "ab" for d in range(1, 29, 2 if p == "a" else 5)], gone=(("a", 8, "off"), ("a", 10, "on"), ("c", 4, "off")))
    assert sets(history.changes(rows, spread=unit)) == sets(history.changes(rows))


def test_a_changed_record_index_is_a_refresh_of_provenance(spark):
    rows = observations(spark, listing("a", 1), listing("a", 2) | {"record_index": 7})
    deltas = sets(history.changes(rows))["a", 1, 2][1]
    assert deltas == [(f, "PROVENANCE_REFRESH") for f in ("source_url", "location_text", "price_amount", "currency", "total_area", "rooms")]


def test_heads_and_order(spark):
    rows = observations(spark, listing("a", 1), listing("a", 3), listing("b", 2), gone=(("b", 5, "off"),))
    assert {r.publication_id: (r.observed_at.day, r.is_available) for r in history.heads(rows).collect()} == {"a": (3, True), "b": (5, False)}
    assert [r.publication_id for r in history.current_available(rows).collect()] == ["a"]
    arrived = spark.createDataFrame([("s", "a", at(2), 0), ("s", "a", at(1), 1), ("s", "a", at(3), 2), ("s", "b", at(1), 3), ("s", "b", at(1), 4)], "source_id string, publication_id string, observed_at timestamp, ordinal int")
    assert {r.ordinal for r in history.out_of_order(arrived).collect()} == {1, 4}


def outcome(done):
    conflicts = {(r.code, r.publication_id, r.observed_at and r.observed_at.day) for r in done.conflicts.collect()}
    return conflicts or {(r.publication_id, r.observed_at.day): r.disposition for r in done.outcomes.collect()}


def test_append_replay_and_conflicts(spark):
    old = observations(spark, listing("a", 2), listing("a", 5), listing("b", 1))
    assert outcome(history.append(old, observations(spark, listing("a", 7), listing("a", 6), listing("a", 6), listing("a", 5), listing("c", 1)))) == {
        ("a", 7): "APPENDED", ("a", 6): "APPENDED", ("a", 5): "REPLAYED", ("c", 1): "APPENDED",
    }
    assert outcome(history.append(old, observations(spark, listing("a", 5, price="7"), listing("a", 3), listing("b", 4)))) == {
        ("timestamp_content_conflict", "a", 5), ("out_of_order_observation", "a", 3),
    }
    assert outcome(history.append(old, observations(spark, listing("c", 1), listing("c", 1, price="7")))) == {("timestamp_content_conflict", "c", 1)}
    versions = spark.createDataFrame([("s", "a", "old@1"), ("s", "z", "old@1"), ("s", "b", "publication-change-policy@1")], "source_id string, publication_id string, policy_version string")
    assert outcome(history.append(old, observations(spark, listing("a", 3), listing("b", 9)), versions)) == {("comparison_policy_mismatch", "a", None), ("comparison_policy_mismatch", "z", None)}


def test_change_sets_of_a_batch_span_history_and_batch(spark):
    old = observations(spark, listing("a", 2), listing("b", 1))
    done = history.append(old, observations(spark, listing("a", 4, price="9"), listing("a", 3), listing("c", 1), listing("a", 2)))
    assert sets(done.change_sets) == {("a", 2, 3): (None, [], False), ("a", 3, 4): (None, [("price_amount", "SUBSTANTIVE")], False)}
    assert done.rows.count() == 5


def test_single_append_of_another_publication(spark):
    old = observations(spark, listing("a", 2))
    versions = spark.createDataFrame([("s", "a", "old@1")], "source_id string, publication_id string, policy_version string")
    assert outcome(history.append_one(old, ("s", "a"), observations(spark, listing("b", 3)))) == {("stream_reference_mismatch", "b", 3)}
    assert outcome(history.append_one(old, ("s", "a"), observations(spark, listing("b", 3)), versions)) == {("comparison_policy_mismatch", "a", None)}
    assert outcome(history.append_one(old, ("s", "a"), observations(spark, listing("a", 3)))) == {("a", 3): "APPENDED"}


def fold(old, batch):
    """The append as a fold over sorted keys, one observation at a time."""
    streams, by_key, found = {}, {}, set()
    for p, d, c in old:
        streams.setdefault(p, []).append((d, c))
    for p, d, c in batch:
        by_key.setdefault((p, d), set()).add(c)
    out = {}
    for (p, d), contents in sorted(by_key.items()):
        own = streams.setdefault(p, [])
        if len(contents) > 1:
            found.add(("timestamp_content_conflict", p, d))
            continue
        c = next(iter(contents))
        if (same := dict(own).get(d)) is not None:
            if same == c:
                out[p, d] = "REPLAYED"
            else:
                found.add(("timestamp_content_conflict", p, d))
        elif own and d < own[-1][0]:
            found.add(("out_of_order_observation", p, d))
        else:
            own.append((d, c))
            out[p, d] = "APPENDED"
    return found or out


@pytest.mark.parametrize("seed", range(4))
def test_joins_equal_the_fold_in_any_order_of_rows(spark, seed):
    rng = random.Random(seed)
    old, batch = [], []
    for p in "abcdef":
        days = sorted(rng.sample(range(1, 20), rng.randrange(0, 5)))
        old += [(p, d, str(rng.randrange(1, 3))) for d in days]
    for p, _ in itertools.product("abcdef", range(3)):
        batch.append((p, rng.randrange(1 if seed % 2 else 20, 25), str(rng.randrange(1, 3))))
    batch += rng.sample(old, min(3, len(old)))
    rng.shuffle(batch)
    make = lambda rows: observations(spark, *[listing(p, d, price=c) for p, d, c in rows]) if rows else none(spark)
    assert outcome(history.append(make(old), make(batch).repartition(3))) == fold(sorted(old), batch)
