import shutil
import time

import pytest
from pyspark.sql import functions as F

from marlstone.operators import assessment, blocking, history, review
from marlstone.operators.history import REF
from marlstone.sources.store import Commit, Store, StoreFailure
from marlstone.streaming import observations as stream
from tests.engine.builders import at, listing, observations
from tests.engine.test_duplicates import DRAFT, draft


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def expect(rows, *known):
    """Expected head revisions: (publication, revision or None)."""
    return rows.sparkSession.createDataFrame([("s", p, r) for p, r in known], "source_id string, publication_id string, revision long")


def codes(outcome):
    return sorted({r.code for r in outcome.conflicts.collect()})


def test_histories_commit_replay_and_conflicts(spark, store):
    first = observations(spark, listing("a", 1), listing("b", 1))
    none = first.limit(0)
    prepared = history.append(none, first)
    assert store.load_histories(first.select(*REF)).where("revision is not null").count() == 0
    done = store.commit_histories("c1", first, prepared, expect(first, ("a", None), ("b", None)))
    assert (done.disposition, done.revision) == ("COMMITTED", 1)
    # The same again, with any expectation, is a replay; other content under the name is a conflict.
    assert store.commit_histories("c1", first, prepared, expect(first, ("a", 9), ("b", 9))).disposition == "REPLAYED"
    other = observations(spark, listing("a", 1, price="7"))
    assert codes(store.commit_histories("c1", other, history.append(none, other), expect(first, ("a", None)))) == ["commit_identity_content_conflict"]
    # Stale heads: all of them are told, nothing is written.
    more = observations(spark, listing("a", 2), listing("b", 2))
    ready = history.append(first, more)
    stale = store.commit_histories("c2", more, ready, expect(first, ("a", None), ("b", 7)))
    assert codes(stale) == ["expected_revision_mismatch"] and stale.conflicts.count() == 2
    assert store.commit_histories("c2", more, ready, expect(first, ("a", 1), ("b", 1))).revision == 2
    assert {r.publication_id: r.revision for r in store.heads().collect()} == {"a": 2, "b": 2}
    assert store.observations().count() == 4
    loaded = store.load_histories(spark.createDataFrame([("s", "a"), ("s", "z")], "source_id string, publication_id string"))
    assert sorted((r.publication_id, r.revision, r.observed_at and r.observed_at.day) for r in loaded.collect() if r.publication_id == "a") == [("a", 2, 1), ("a", 2, 2)]


def test_prepared_histories_must_follow_from_what_is_committed(spark, store):
    first = observations(spark, listing("a", 3))
    store.commit_histories("c1", first, history.append(first.limit(0), first), expect(first, ("a", None)))
    late = observations(spark, listing("a", 2))
    wrong = history.append(first.limit(0), late)  # prepared without the committed history
    assert codes(store.commit_histories("c2", late, wrong, expect(first, ("a", 1)))) == ["prepared_history_mismatch", "unsupported_out_of_order_commit"]
    new = observations(spark, listing("a", 5))
    assert codes(store.commit_histories("c2", new, history.append(first.limit(0), new), expect(first, ("a", 1)))) == ["prepared_history_mismatch"]
    assert store.commit_histories("c2", new, history.append(first, new), expect(first, ("a", 1))).ok()


def test_lookups_by_key_are_all_or_nothing(spark, store):
    first = observations(spark, listing("a", 1), listing("b", 1))
    store.commit_histories("c1", first, history.append(first.limit(0), first), expect(first, ("a", None), ("b", None)))
    key = lambda *k: spark.createDataFrame([("s", p, at(d)) for p, d in k], "source_id string, publication_id string, observed_at timestamp")
    rows, missing = store.load_observations(key(("a", 1), ("b", 1)))
    assert rows.count() == 2 and missing.count() == 0
    rows, missing = store.load_observations(key(("a", 1), ("b", 2)))
    assert rows is None and [(r.publication_id, r.observed_at.day) for r in missing.collect()] == [("b", 2)]


@pytest.fixture
def batch(spark):
    now = observations(spark, *[listing(p) for p in "abc"])
    g = blocking.generate(now, 10)
    return g, assessment.assess_batch(g, now).rows, now


def test_generations_and_batches(spark, store, batch):
    g, items, now = batch
    assert store.load_generation(g.input_keys, 10) is None
    assert codes(store.commit_generation(g, expected=4)) == ["expected_revision_mismatch"]
    assert store.commit_generation(g).disposition == "COMMITTED"
    assert store.commit_generation(g, expected=77).disposition == "REPLAYED"
    changed = blocking.Generation(g.rows.limit(1), g.conflicts, g.members, g.non_participations, g.oversized, g.input_keys, g.limit)
    assert codes(store.commit_generation(changed)) == ["generation_identity_content_conflict"]
    tables, revision = store.load_generation(g.input_keys, 10)
    assert tables["candidates"].count() == 3 and revision == 1
    assert codes(store.commit_batch(g, items, None, None)) == ["expected_revision_mismatch"]
    assert store.commit_batch(g, items, 1, None).ok()
    assert store.commit_batch(g, items, 5, 5).disposition == "REPLAYED"
    assert codes(store.commit_batch(g, items.withColumn("outcome", F.lit("x")), 1, 2)) == ["batch_identity_content_conflict", "item_identity_content_conflict"]
    assert codes(store.commit_batch(changed, items, 1, None)) == ["generation_dependency_content_conflict"]
    assert store.load_batch(g)[0].count() == 3
    assert store.check_assessments(now).count() == 0


def test_a_batch_brings_its_generation(spark, store, batch):
    g, items, _ = batch
    done = store.commit_batch(g, items)
    assert done.ok() and store.load_generation(g.input_keys, 10) is not None and store.commit_generation(g).disposition == "REPLAYED"


def test_supersessions_reviews_and_audits(spark, store, batch):
    g, items, _ = batch
    store.commit_batch(g, items)
    one = items.where("left_publication_id = 'a' and right_publication_id = 'b'").first().asDict()
    key = {k: one[k] for k in review.ASSESSMENT}
    later = key | {"left_at": at(9)}
    assert codes(store.commit_supersession(key, later)) == ["assessment_dependency_not_found"]
    with pytest.raises(ValueError):
        store.commit_supersession(key, key)
    row = lambda *a, **k: spark.createDataFrame([draft(*a, **k)], DRAFT)
    assert codes(store.commit_review(row(pair=("a", "z")))) == ["review_assessment_mismatch"]
    assert codes(store.commit_review(row(), expected=3)) == ["expected_revision_mismatch"]
    head = store.commit_review(row()).revision
    assert store.commit_review(row(), expected=99).disposition == "REPLAYED"
    assert codes(store.commit_review(row(outcome="REJECTED"))) == ["review_identity_content_conflict", "review_revision_fork"]
    assert codes(store.commit_review(row(3, day=3), head)) == ["review_revision_mismatch"]
    second = store.commit_review(row(2, day=2), head).revision
    assert codes(store.commit_review(row(3, day=3, supersedes=("r", 1)), second)) == ["review_revision_fork"]
    chain, committed = store.load_review_chain("r")
    assert [r.revision for r in chain.collect()] == [1, 2] and committed == second
    cases = spark.createDataFrame([("x", 1)], "pair string, label int")
    assert codes(store.commit_audit("q", 2, cases)) == ["audit_revision_fork"]
    first = store.commit_audit("q", 1, cases).revision
    assert store.commit_audit("q", 1, cases, 8).disposition == "REPLAYED"
    assert codes(store.commit_audit("q", 1, cases.withColumn("label", F.lit(2)))) == ["audit_identity_content_conflict", "audit_revision_fork"]
    assert codes(store.commit_audit("q", 2, cases)) == ["expected_revision_mismatch"]
    assert store.commit_audit("q", 2, cases, first).ok() and store.load_audit("q", 2)[0].count() == 1


def test_a_taken_number_is_never_replaced(spark, store, batch):
    g, _, _ = batch
    store.commit_generation(g)
    commit = store.commits()[0]
    assert store._publish(commit) is False and len(store.commits()) == 1


def test_stream_commits_each_batch_whole_and_once(spark, store, tmp_path):
    source, rejected = tmp_path / "in", []
    rows = observations(spark, listing("a", 1), listing("b", 1))
    rows.coalesce(1).write.mode("append").parquet(str(source))
    feed = lambda: spark.readStream.schema(rows.schema).parquet(str(source))
    run = lambda: stream.start(feed(), store, str(tmp_path / "ck"), on_conflict=lambda n, c: rejected.append((n, codes_of(c))), available_now=True).awaitTermination()
    codes_of = lambda c: sorted({r.code for r in c.collect()})
    run()
    assert store.observations().count() == 2
    observations(spark, listing("a", 3), listing("a", 2), listing("a", 1)).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert store.observations().count() == 4 and rejected == []
    # A late observation rejects its whole batch: nothing is dropped silently, nothing is kept in part.
    observations(spark, listing("b", 5), listing("a", 2, price="7")).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert store.observations().count() == 4 and [c for _, c in rejected] == [["timestamp_content_conflict"]]
    assert stream.append_batch(store, "observations-0", rows).disposition == "REPLAYED"


def test_a_batch_and_its_generation_are_there_together_or_not_at_all(spark, store, batch, monkeypatch):
    g, items, _ = batch
    for stop in ("before", "after"):
        real = Store._publish

        def crash(self, commit, real=real, stop=stop):
            if stop == "after":
                real(self, commit)
            raise StoreFailure("outcome_unknown", commit.kind)

        monkeypatch.setattr(Store, "_publish", crash)
        with pytest.raises(StoreFailure):
            store.commit_batch(g, items)
        monkeypatch.setattr(Store, "_publish", real)
        there = stop == "after"
        assert (store.load_batch(g) is not None, store.load_generation(g.input_keys, 10) is not None) == (there, there)
    # The same commit again tells what has become of it, and nothing is there twice.
    assert store.commit_batch(g, items).disposition == "REPLAYED" and store.commit_generation(g).disposition == "REPLAYED"
    assert [c.kind for c in store.commits()] == ["batch", "generation"] and store.load_generation(g.input_keys, 10)[1] == store.load_batch(g)[1] == 1


def test_a_review_binds_the_assessment_as_it_is_stored(spark, store, batch):
    g, items, _ = batch
    store.commit_batch(g, items)
    own = items.where("left_publication_id = 'a' and right_publication_id = 'b'").select(*review.ASSESSMENT, "evidence", "non_comparisons", "outcome")
    row = spark.createDataFrame([draft()], DRAFT)
    assert codes(store.commit_review(row, bound=own.withColumn("outcome", F.lit("other")))) == ["review_assessment_mismatch"]
    assert codes(store.commit_review(row, bound=own.limit(0))) == ["review_assessment_mismatch"]
    assert store.commit_review(row, bound=own).ok()


def test_failures_of_the_file_system_and_of_manifests(spark, store, batch, tmp_path):
    g, _, _ = batch
    store.commit_generation(g)
    other = Store(spark, store.root)
    (tmp_path / "store" / "_commits" / "000000000002.json").write_text("{")
    for s in (store, other):
        with pytest.raises(StoreFailure) as e:
            s.commits()
        assert e.value.code == "integrity_violation"
    (tmp_path / "store" / "_commits").rename(tmp_path / "away")
    with pytest.raises(StoreFailure) as e:
        store.commits()
    assert e.value.code == "temporarily_unavailable"


def test_thousands_of_commits_are_one_scan(spark, store, tmp_path):
    rows = observations(spark, listing("a", 1), listing("b", 1))
    done = store.commit_histories("c0", rows, history.append(rows.limit(0), rows), expect(rows, ("a", None), ("b", None)))
    first = store.commits()[0]
    for n in range(2, 2001):  # copies of a small table: what is measured is the planning
        shutil.copytree(tmp_path / "store" / first.tables["touched"], tmp_path / "store" / "data" / f"n{n}" / "touched")
        store._publish(Commit(n, "histories", {"code": f"c{n}", "policy": first.identity["policy"]}, {"touched": f"data/n{n}/touched"}))
    began = time.time()
    again = Store(spark, store.root)
    assert len(again.commits()) == 2000 and done.revision == 1
    took = time.time() - began
    began = time.time()
    assert again.observations().count() == 2 and {r.revision for r in again.heads().collect()} == {2000}
    assert len(again.commits()) == 2000 and time.time() - began < 60 and took < 60
    plan = again.heads()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_only_commits_that_touched_a_publication_are_read(spark, store):
    known = None
    for day, name in enumerate("abc", 1):
        rows = observations(spark, listing(name, day))
        known = rows if known is None else known.unionByName(rows)
        store.commit_histories(f"c{day}", rows, history.append(rows.limit(0), rows), expect(rows, (name, None)))
    own = store.observations(expect(known, ("b", None)))
    assert [(r.publication_id, r.revision) for r in own.collect()] == [("b", 2)]
    assert len(own.inputFiles()) < len(store.observations().inputFiles())
    assert store.observations(expect(known, ("z", None))).count() == 0


def test_what_a_losing_writer_wrote_is_removed(spark, store, batch, tmp_path, monkeypatch):
    g, _, _ = batch
    real, lost = Store._publish, []

    def late(self, commit):
        if not lost:
            lost.append(commit)
            return False
        return real(self, commit)

    monkeypatch.setattr(Store, "_publish", late)
    assert store.commit_generation(g).ok()
    kept = {p.split("/")[1] for p in store.commits()[0].tables.values()}
    assert {p.name for p in (tmp_path / "store" / "data").iterdir()} == kept
