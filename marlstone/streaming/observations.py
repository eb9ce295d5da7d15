"""Structured Streaming over the batch append: a micro-batch is a unit that is committed whole or not at all.

Late observations are conflicts of their batch, so no watermark may drop them; state is the store's heads. A batch that
was committed before a failure is recognised by its number and replayed without effect: exactly once, from at-least-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone import policies
from marlstone.operators import history
from marlstone.operators.history import CONTENT, KEY, REF
from marlstone.sources.store import Outcome, Store

#: Tries of a batch whose histories another writer changed meanwhile.
TRIES = 5


class BatchRejected(Exception):
    """A micro-batch had conflicts; nothing of it was committed."""

    def __init__(self, code: str, conflicts: DataFrame):
        super().__init__(code)
        self.conflicts = conflicts


def append_batch(store: Store, code: str, batch: DataFrame, fields: tuple[str, ...] = policies.CHANGE_FIELDS) -> Outcome:
    """Load the touched histories, append, commit; if a history moved on meanwhile, load and append again."""
    rows = batch.select(*KEY, *CONTENT).distinct().cache()
    try:
        if rows.isEmpty():
            return Outcome("EMPTY", None)
        touched = rows.select(*REF).distinct()
        for _ in range(TRIES):
            if (done := store._one("histories", {"code": code, "policy": policies.CHANGE_POLICY})) is not None:
                return Outcome("REPLAYED", done.number)
            committed, heads = store.observations(touched), store.heads()
            known = rows.limit(0) if committed is None else committed.select(*KEY, *CONTENT).join(touched, list(REF), "left_semi")
            prepared = history.append(known, rows, fields=fields)
            if not prepared.ok():
                return Outcome(None, None, prepared.conflicts)
            none = F.lit(None).cast("bigint").alias("revision")
            expected = touched.select(*REF, none) if heads is None else touched.join(heads, list(REF), "left")
            found = store.commit_histories(code, rows, prepared, expected)
            if found.ok() or found.conflicts.where("code <> 'expected_revision_mismatch'").limit(1).count():
                return found
        return found
    finally:
        rows.unpersist()


def start(stream: DataFrame, store: Store, checkpoint: str, name: str = "observations", on_conflict: Callable[[str, DataFrame], None] | None = None, fields: tuple[str, ...] = policies.CHANGE_FIELDS, available_now: bool = False) -> StreamingQuery:
    """Feed a stream of observations into the store. Conflicts stop the query, unless ``on_conflict`` takes them."""

    def each(batch: DataFrame, number: int) -> None:
        done = append_batch(store, f"{name}-{number}", batch, fields)
        if not done.ok():
            if on_conflict is None:
                raise BatchRejected(f"{name}-{number}", done.conflicts)
            on_conflict(f"{name}-{number}", done.conflicts)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
