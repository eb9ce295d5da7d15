"""A versioned store on plain Parquet: compare-and-commit of several tables at once, idempotent replay, exact lookups.

A commit writes its tables under ``data/`` and then publishes one manifest ``_commits/<number>.json`` by exclusive
creation. Readers see manifested files only, so a commit is there whole or not at all; what is committed together (a batch
and its generation) is named by one manifest. The number is the revision of everything in the commit: it only grows, and
comes from no clock or hash. If another writer publishes the number first, the decision is made again on what is there then,
and what was written in vain is removed. Nothing committed is ever rewritten, so manifests are read once; a table over any
number of commits is one scan, and heads and chains are views.

A file system that fails before anything is published makes the store ``temporarily_unavailable``, one that fails while the
manifest is published leaves ``outcome_unknown`` (the same commit again tells), and a manifest that can't be read is an
``integrity_violation``.

Every commit is decided in the same order: a replay (equal identity and content) succeeds whatever revision is expected;
equal identity with other content is a conflict; then expected revisions; then writing.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.operators import assessment, blocking, history, review
from marlstone.operators.blocking import IDENTITY
from marlstone.operators.history import CONTENT, KEY, REF

COMMITTED, REPLAYED = "COMMITTED", "REPLAYED"
_CONFLICT = "category string, code string, subject string"
HISTORY, GENERATION, ASSESSMENT, REVIEW, AUDIT = (
    "OBSERVATION_PERSISTENCE_CONFLICT", "DUPLICATE_GENERATION_PERSISTENCE_CONFLICT", "DUPLICATE_ASSESSMENT_PERSISTENCE_CONFLICT",
    "MANUAL_REVIEW_PERSISTENCE_CONFLICT", "DUPLICATE_QUALITY_PERSISTENCE_CONFLICT",
)


class StoreFailure(Exception):
    """An operational failure: temporarily_unavailable, integrity_violation or outcome_unknown."""

    def __init__(self, code: str, operation: str):
        super().__init__(f"{operation}: {code}")
        self.code, self.operation = code, operation


@dataclass(frozen=True)
class Commit:
    """A published commit."""

    number: int
    kind: str
    identity: dict
    tables: dict[str, str]
    meta: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Outcome:
    """What became of a commit; ``conflicts`` (category, code, subject) is None where it succeeded."""

    disposition: str | None
    revision: int | None
    conflicts: DataFrame | None = None

    def ok(self) -> bool:
        return self.disposition is not None


def equal_rows(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, as often, whatever their order."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        self._local = str(self._fs.getUri()).startswith("file:")
        self._read: dict[str, list[Commit]] = {}

    # Manifests

    def commits(self, kind: str | None = None) -> list[Commit]:
        """What is published, in order. Manifests are small and one per batch; their rows stay in Parquet."""
        try:
            names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/_commits"))]
            for name in sorted(n for n in names if n.endswith(".json") and n not in self._read):
                stream = self._fs.open(self._path(f"{self.root}/_commits/{name}"))
                try:
                    text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                self._read[name] = self._named(text)
        except (Py4JError, OSError) as e:
            raise StoreFailure("temporarily_unavailable", "commits") from e
        found = [c for own in self._read.values() for c in own if kind in (None, c.kind)]
        return sorted(found, key=lambda c: c.number)

    def _named(self, text: str) -> list[Commit]:
        """What a manifest names: its own commit, and what was committed with it."""
        try:
            own = Commit(**json.loads(text))
        except (ValueError, TypeError) as e:
            raise StoreFailure("integrity_violation", "commits") from e
        prefix = lambda kind: f"{kind}_"
        more = [Commit(own.number, x["kind"], x["identity"], {k.removeprefix(prefix(x["kind"])): v for k, v in own.tables.items() if k.startswith(prefix(x["kind"]))}) for x in own.meta.get("with", ())]
        return [own, *more]

    def _publish(self, commit: Commit) -> bool:
        """Create the manifest, unless its number is taken."""
        text = json.dumps(commit.__dict__, sort_keys=True)
        target = f"{self.root}/_commits/{commit.number:012d}.json"
        draft = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        try:
            stream = self._fs.create(draft, False)
            stream.write(bytearray(text.encode()))
            stream.close()
        except (Py4JError, OSError) as e:
            raise StoreFailure("temporarily_unavailable", commit.kind) from e
        try:
            if self._local:  # a hard link fails where the name is taken; a local rename would replace it
                try:
                    os.link(draft.toUri().getPath(), self._path(target).toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return bool(self._fs.rename(draft, self._path(target)))
        except (Py4JError, OSError) as e:
            raise StoreFailure("outcome_unknown", commit.kind) from e
        finally:
            with contextlib.suppress(Py4JError, OSError):
                self._fs.delete(draft, False)

    def _write(self, decide: Callable[[], Outcome | None], kind: str, identity: dict, tables: Callable[[], dict[str, DataFrame]], meta: dict | None = None) -> Outcome:
        """Decide, write and publish; again from the start if another commit came between."""
        while True:
            seen = self.commits()
            if (done := decide()) is not None:
                return done
            paths = {}
            for name, df in tables().items():
                paths[name] = f"data/{uuid.uuid4().hex}/{name}"
                df.write.parquet(f"{self.root}/{paths[name]}")
            number = (seen[-1].number if seen else 0) + 1
            if self._publish(Commit(number, kind, identity, paths, meta or {})):
                return Outcome(COMMITTED, number)
            for path in paths.values():
                self._fs.delete(self._path(f"{self.root}/{path.rpartition('/')[0]}"), True)

    def _table(self, commits: list[Commit], name: str) -> DataFrame | None:
        """One table over commits, with the ``revision`` of each row's commit: one scan, whatever their number."""
        own = {c.tables[name].split("/")[1]: c for c in commits if name in c.tables}
        if not own:
            return None
        paths = [f"{self.root}/{c.tables[name]}" for c in own.values()]
        first = self.spark.read.parquet(paths[0])
        if len(own) == 1:
            return first.withColumn("revision", F.lit(next(iter(own.values())).number).cast("bigint"))
        numbers = self.spark.createDataFrame([(k, c.number) for k, c in own.items()], "_folder string, revision bigint")
        folder = F.element_at(F.split("_metadata.file_path", "/"), -3)
        rows = self.spark.read.schema(first.schema).parquet(*paths).select("*", folder.alias("_folder"))
        return rows.join(F.broadcast(numbers), "_folder").drop("_folder")

    def _conflicts(self, category: str, found: list[tuple[str, Any]]) -> Outcome:
        rows = [(category, code, subject if isinstance(subject, str) else json.dumps(subject, default=str, sort_keys=True)) for code, subject in found]
        return Outcome(None, None, self.spark.createDataFrame(rows, _CONFLICT))

    def _one(self, kind: str, identity: dict) -> Commit | None:
        found = [c for c in self.commits(kind) if c.identity == identity]
        return found[-1] if found else None

    # Observations

    def heads(self) -> DataFrame | None:
        """The revision of every committed publication's history."""
        touched = self._table(self.commits("histories"), "touched")
        return None if touched is None else touched.groupBy(*REF).agg(F.max("revision").alias("revision"))

    def observations(self, references: DataFrame | None = None) -> DataFrame | None:
        """Committed observations; of given publications, those of the commits that touched them are all that is read."""
        commits = self.commits("histories")
        if references is None or len(commits) < 2:
            return self._table(commits, "observations")
        touched = self._table(commits, "touched").join(references.select(*REF).distinct(), list(REF), "left_semi")
        numbers = {r.revision for r in touched.select("revision").distinct().toLocalIterator()}
        rows = self._table([c for c in commits if c.number in numbers] or commits[:1], "observations")
        return rows.join(references.select(*REF).distinct(), list(REF), "left_semi")

    def load_histories(self, references: DataFrame) -> DataFrame:
        """Requested publications with their head revision (null: none) and, a row each, their observations."""
        heads, rows = self.heads(), self.observations(references)
        if heads is None or rows is None:
            return references.select(*REF).distinct().withColumn("revision", F.lit(None).cast("bigint"))
        wanted = references.select(*REF).distinct()
        return wanted.join(heads, list(REF), "left").join(rows.drop("revision"), list(REF), "left")

    def load_observations(self, keys: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """All requested observations, or none and the keys that are missing."""
        wanted = keys.select(*KEY).distinct()
        rows = self.observations(wanted)
        if rows is None:
            return None, wanted
        missing = wanted.join(rows, list(KEY), "left_anti")
        return (None if not missing.isEmpty() else rows.drop("revision").join(wanted, list(KEY), "left_semi")), missing

    def commit_histories(self, code: str, candidates: DataFrame, prepared: history.Append, expected: DataFrame, policy: str = policies.CHANGE_POLICY) -> Outcome:
        """Commit a prepared append. ``expected``: source_id, publication_id and revision (null: none yet) of every touched history."""
        identity = {"code": code, "policy": policy}
        offered, outcomes = candidates.select(*KEY, *CONTENT).distinct().cache(), prepared.outcomes.select(*KEY, "disposition").cache()

        def decide() -> Outcome | None:
            old = self._one("histories", identity)
            if old is not None:
                same = equal_rows(self._table([old], "candidates").drop("revision"), offered) and equal_rows(self._table([old], "outcomes").drop("revision"), outcomes)
                return Outcome(REPLAYED, old.number) if same else self._conflicts(HISTORY, [("commit_identity_content_conflict", identity)])
            heads = self.heads()
            wanted = expected.select(*REF, F.col("revision").cast("bigint").alias("expected"))
            if heads is not None:
                wanted = wanted.join(heads.withColumnRenamed("revision", "actual"), list(REF), "left")
            else:
                wanted = wanted.withColumn("actual", F.lit(None).cast("bigint"))
            subject = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias("subject")
            made = lambda df, code, *c: df.select(F.lit(HISTORY).alias("category"), F.lit(code).alias("code"), subject(*c))
            stale = made(wanted.where(~F.col("expected").eqNullSafe(F.col("actual"))), "expected_revision_mismatch", *REF, "expected", "actual")
            if not stale.isEmpty():
                return Outcome(None, None, stale)
            return self._lineage(offered, outcomes, prepared, wanted, policy, made)

        def tables() -> dict[str, DataFrame]:
            new = outcomes.where("disposition = 'APPENDED'").select(*KEY)
            return {
                "observations": offered.join(new, list(KEY), "left_semi"), "candidates": offered, "outcomes": outcomes,
                "touched": expected.select(*REF).distinct(),
            }

        return self._write(decide, "histories", identity, tables)

    def _lineage(self, offered: DataFrame, outcomes: DataFrame, prepared: history.Append, touched: DataFrame, policy: str, made: Callable) -> Outcome | None:
        """Derive the append again from what is committed: it must come to the prepared one."""
        committed = self.observations(touched)
        known = offered.limit(0) if committed is None else committed.drop("revision").select(*KEY, *CONTENT).join(touched.select(*REF), list(REF), "left_semi")
        latest = known.groupBy(*REF).agg(F.max("observed_at").alias("latest"))
        old = known.select(*KEY, F.struct(*CONTENT).alias("old"))
        rows = offered.join(latest, list(REF), "left").join(old, list(KEY), "left").join(outcomes, list(KEY), "left")
        there = F.col("old").isNotNull()
        late = ~there & (F.col("observed_at") <= F.col("latest"))
        wrong = (
            F.when(there, ~F.col("old").eqNullSafe(F.struct(*CONTENT)) | ~F.col("disposition").eqNullSafe(F.lit("REPLAYED")))
            .when(late, True)
            .otherwise(~F.col("disposition").eqNullSafe(F.lit("APPENDED")))
        )
        rows = rows.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("wrong", F.coalesce(wrong, F.lit(True)))
        whole = known.unionByName(offered.join(known, list(KEY), "left_anti"))
        ready = prepared.rows.select(*KEY, *CONTENT).join(touched.select(*REF), list(REF), "left_semi")
        uneven = whole.exceptAll(ready).unionByName(ready.exceptAll(whole)).select(*REF)
        other = [c for c in self.commits("histories") if c.identity["policy"] != policy]
        foreign = self._table(other, "touched")
        bad = rows.where("wrong").select(*REF).unionByName(uneven)
        if foreign is not None:
            bad = bad.unionByName(foreign.select(*REF).join(touched.select(*REF), list(REF), "left_semi"))
        conflicts = made(rows.where("late"), "unsupported_out_of_order_commit", *KEY).unionByName(made(bad.distinct(), "prepared_history_mismatch", *REF))
        return None if conflicts.isEmpty() else Outcome(None, None, conflicts)

    # Generations and assessment batches

    def _generation_identity(self, generation: blocking.Generation) -> dict:
        keys = generation.input_keys
        n = keys.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*KEY)).alias("x")).first()
        # The checksum only finds the rows to compare; what decides is the table of keys.
        return {"policy": generation.policy, "limit": generation.limit, "keys": n.n, "check": n.x}

    def _generation_tables(self, generation: blocking.Generation) -> dict[str, DataFrame]:
        return {"candidates": generation.rows, "non_participations": generation.non_participations, "oversized": generation.oversized, "input_keys": generation.input_keys}

    def _same(self, commit: Commit, tables: dict[str, DataFrame]) -> bool:
        return all(equal_rows(self._table([commit], n).drop("revision"), df) for n, df in tables.items())

    def _generation(self, generation: blocking.Generation) -> tuple[dict, Commit | None, bool]:
        """Identity, its commit if there is one, and whether the content is equal."""
        identity = self._generation_identity(generation)
        old = self._one("generation", identity)
        if old is None:
            return identity, None, False
        if not equal_rows(self._table([old], "input_keys").drop("revision"), generation.input_keys):
            raise StoreFailure("integrity_violation", "generation")
        return identity, old, self._same(old, self._generation_tables(generation))

    def load_generation(self, generation_keys: DataFrame, limit: int, policy: str = policies.CANDIDATE_POLICY) -> tuple[dict[str, DataFrame], int] | None:
        n = generation_keys.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*KEY)).alias("x")).first()
        c = self._one("generation", {"policy": policy, "limit": limit, "keys": n.n, "check": n.x})
        return None if c is None else ({t: self._table([c], t).drop("revision") for t in c.tables}, c.number)

    def commit_generation(self, generation: blocking.Generation, expected: int | None = None) -> Outcome:
        def decide() -> Outcome | None:
            identity, old, same = self._generation(generation)
            if old is not None:
                return Outcome(REPLAYED, old.number) if same else self._conflicts(GENERATION, [("generation_identity_content_conflict", identity)])
            return None if expected is None else self._conflicts(GENERATION, [("expected_revision_mismatch", {"identity": identity, "expected": expected, "actual": None})])

        return self._write(decide, "generation", self._generation_identity(generation), lambda: self._generation_tables(generation))

    def assessments(self) -> DataFrame | None:
        return self._table(self.commits("batch"), "items")

    def load_batch(self, generation: blocking.Generation, policy: str = policies.ASSESSMENT_POLICY) -> tuple[DataFrame, int] | None:
        c = self._one("batch", {"generation": self._generation_identity(generation), "policy": policy})
        return None if c is None else (self._table([c], "items").drop("revision"), c.number)

    def _assessment(self, identity: dict) -> DataFrame | None:
        rows = self.assessments()
        if rows is None:
            return None
        for k in (*IDENTITY, "assessment_policy"):
            rows = rows.where(F.col(k) == F.lit(identity[k]))
        return rows.drop("revision").limit(1)

    def load_assessment(self, identity: dict) -> Row | None:
        """One assessment by its whole identity."""
        rows = self._assessment(identity)
        return None if rows is None else rows.first()

    def commit_batch(self, generation: blocking.Generation, items: DataFrame, expected_generation: int | None = None, expected_batch: int | None = None, policy: str = policies.ASSESSMENT_POLICY) -> Outcome:
        """Commit a generation, if it isn't there, and the assessments of its candidates, by one manifest.

        ``items``: the identity columns, assessment_policy, evidence, non_comparisons and outcome.
        """
        key = [*IDENTITY, "assessment_policy"]
        items = items.select(*key, "evidence", "non_comparisons", "outcome").cache()
        batch_identity = {"generation": self._generation_identity(generation), "policy": policy}
        meta: dict[str, Any] = {}

        def decide() -> Outcome | None:
            identity, old_generation, same = self._generation(generation)
            old = self._one("batch", batch_identity)
            equal = old is not None and equal_rows(self._table([old], "items").drop("revision"), items)
            if equal and same:
                return Outcome(REPLAYED, old.number)
            found: list[tuple[str, Any]] = []
            if old_generation is not None and not same:
                found.append(("generation_dependency_content_conflict", identity))
            if old is not None and not equal:
                found.append(("batch_identity_content_conflict", batch_identity))
            if (stored := self.assessments()) is not None:
                content = F.struct("evidence", "non_comparisons", "outcome")
                clash = items.select(*key, content.alias("new")).join(stored.select(*key, content.alias("old")), key).where(~F.col("new").eqNullSafe(F.col("old")))
                found += [("item_identity_content_conflict", r.asDict()) for r in clash.select(*key).distinct().toLocalIterator()]
            if found:
                return self._conflicts(ASSESSMENT, found)
            actual = {"generation": old_generation and old_generation.number, "batch": old and old.number}
            wanted = {"generation": expected_generation, "batch": expected_batch}
            found = [("expected_revision_mismatch", {"slot": k, "expected": wanted[k], "actual": actual[k]}) for k in actual if actual[k] != wanted[k]]
            if found:
                return self._conflicts(ASSESSMENT, found)
            meta["with"] = [] if old_generation is not None else [{"kind": "generation", "identity": identity}]
            return None

        def tables() -> dict[str, DataFrame]:
            return {"items": items} | ({f"generation_{k}": v for k, v in self._generation_tables(generation).items()} if meta["with"] else {})

        return self._write(decide, "batch", batch_identity, tables, meta)

    # Supersessions, reviews, audits

    def commit_supersession(self, previous: dict, replacement: dict) -> Outcome:
        """Link an assessment (identity columns and assessment_policy) to the one of the same pair that replaces it."""
        key = (*IDENTITY, "assessment_policy")
        plain = lambda d: {k: str(d[k]) for k in key}
        if plain(previous) == plain(replacement) or any(previous[k] != replacement[k] for k in review.PAIR):
            raise ValueError("a supersession joins two assessments of one pair")

        def decide() -> Outcome | None:
            old = self._one("supersession", plain(previous))
            if old is not None and old.meta["replacement"] == plain(replacement):
                return Outcome(REPLAYED, old.number)
            found: list[tuple[str, Any]] = [] if old is None else [("assessment_supersession_conflict", {"previous": plain(previous), "replacement": plain(replacement)})]
            found += [("assessment_dependency_not_found", plain(x)) for x in (previous, replacement) if self.load_assessment(x) is None]
            return self._conflicts(ASSESSMENT, found) if found else None

        return self._write(decide, "supersession", plain(previous), dict, {"replacement": plain(replacement)})

    def load_review_chain(self, code: str) -> tuple[DataFrame | None, int | None]:
        """A chain's revisions in order, and the commit that wrote its head."""
        own = [c for c in self.commits("review") if c.identity["code"] == code]
        rows = self._table(own, "review")
        return (None, None) if rows is None else (rows.withColumnRenamed("revision", "committed").withColumnRenamed("review_revision", "revision").orderBy("revision"), own[-1].number)

    def commit_review(self, made: DataFrame, expected: int | None = None, bound: DataFrame | None = None) -> Outcome:
        """Commit one review (a row as ``review.create`` takes it).

        ``bound``: the assessment as the reviewer had it (a row as ``commit_batch`` takes it); it must be the stored one, content and all.
        """
        row = made.first()
        identity = {"code": row.code, "revision": row.revision}
        supersedes = None if row.supersedes_code is None else {"code": row.supersedes_code, "revision": row.supersedes_revision}
        stored = made.withColumnRenamed("revision", "review_revision")

        def decide() -> Outcome | None:
            known = self._assessment({k: row[k] for k in review.ASSESSMENT})
            if known is None or known.isEmpty() or (bound is not None and not equal_rows(known, bound.select(known.columns))):
                return self._conflicts(REVIEW, [("review_assessment_mismatch", identity)])
            if (old := self._one("review", identity)) is not None:
                if equal_rows(self._table([old], "review").drop("revision"), stored):
                    return Outcome(REPLAYED, old.number)
                return self._conflicts(REVIEW, [("review_identity_content_conflict", identity), ("review_revision_fork", identity)])
            chain = [c for c in self.commits("review") if c.identity["code"] == row.code]
            head = chain[-1] if chain else None
            found: list[tuple[str, Any]] = []
            if (head and head.number) != expected:
                found.append(("expected_revision_mismatch", {"code": row.code, "expected": expected, "actual": head and head.number}))
            if row.revision != (head.identity["revision"] + 1 if head else 1) or supersedes != (head.identity if head else None):
                fork = supersedes is not None and any(c.identity == supersedes for c in chain)
                found.append(("review_revision_fork" if fork else "review_revision_mismatch", identity))
            return self._conflicts(REVIEW, found) if found else None

        return self._write(decide, "review", identity, lambda: {"review": stored})

    def load_audit(self, code: str, revision: int) -> tuple[DataFrame, int] | None:
        c = self._one("audit", {"code": code, "revision": revision})
        return None if c is None else (self._table([c], "cases").drop("revision"), c.number)

    def commit_audit(self, code: str, revision: int, cases: DataFrame, expected: int | None = None) -> Outcome:
        """Commit the control set of a quality audit."""
        identity = {"code": code, "revision": revision}

        def decide() -> Outcome | None:
            if (old := self._one("audit", identity)) is not None:
                if equal_rows(self._table([old], "cases").drop("revision"), cases):
                    return Outcome(REPLAYED, old.number)
                return self._conflicts(AUDIT, [("audit_identity_content_conflict", identity), ("audit_revision_fork", identity)])
            chain = [c for c in self.commits("audit") if c.identity["code"] == code]
            head = chain[-1] if chain else None
            found: list[tuple[str, Any]] = []
            if (head and head.number) != expected:
                found.append(("expected_revision_mismatch", {"code": code, "expected": expected, "actual": head and head.number}))
            if revision != (head.identity["revision"] + 1 if head else 1):
                found.append(("audit_revision_fork", identity))
            return self._conflicts(AUDIT, found) if found else None

        return self._write(decide, "audit", identity, lambda: {"cases": cases})

    def check_assessments(self, current: DataFrame) -> DataFrame:
        """Stored assessments that don't follow from the observations given."""
        rows = self.assessments()
        return current.limit(0).select() if rows is None else assessment.tampered(rows.drop("revision"), current)
