"""Search: filters on present values, and a total order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.outcomes import MISSING, PRESENT
from marlstone.operators.ordering import placed


@dataclass(frozen=True)
class Criteria:
    """What is asked for; None doesn't constrain. Amounts in minor units, areas in hundredths."""

    max_price: int | None = None
    price_currency: str = "RUB"
    min_area: int | None = None
    rooms: frozenset[int] | None = None


def matches(criteria: Criteria) -> Column | None:
    """The conjunction of the criteria that are there. A field that isn't present never matches; nor is it an error."""
    parts = []
    if criteria.max_price is not None:
        parts += [
            F.col("price_amount.state") == PRESENT, F.col("currency.state") == PRESENT,
            F.col("currency.value") == criteria.price_currency, F.col("price_amount.value") <= criteria.max_price,
        ]
    if criteria.min_area is not None:
        parts += [F.col("total_area.state") == PRESENT, F.col("total_area.value") >= criteria.min_area]
    if criteria.rooms is not None:
        parts += [F.col("rooms.state") == PRESENT, F.col("rooms.value").isin(sorted(criteria.rooms))]
    return reduce(lambda a, b: a & b, parts) if parts else None


def money_order() -> list[Column]:
    """Known money first, by currency and amount; then missing; then unsupported."""
    state = (
        F.when((F.col("price_amount.state") == PRESENT) & (F.col("currency.state") == PRESENT), 0)
        .when((F.col("price_amount.state") == MISSING) & (F.col("currency.state") == MISSING), 1)
        .otherwise(2)
    )
    known = state == 0
    return [state, F.when(known, F.col("currency.value")).otherwise(""), F.when(known, F.col("price_amount.value")).otherwise(F.lit(0).cast("bigint"))]


def result_order() -> list[Column]:
    return [*money_order(), F.col("source_id"), F.col("publication_id"), F.col("observed_at"), F.col("source_url.value")]


def search(listings: DataFrame, criteria: Criteria) -> DataFrame:
    """Matching listings in the result's order: a range-partitioned sort, no single task."""
    wanted = matches(criteria)
    return (listings if wanted is None else listings.where(wanted)).orderBy(*result_order())


def ranked(listings: DataFrame, criteria: Criteria) -> DataFrame:
    """The result with its place (``rank``, from 1)."""
    wanted = matches(criteria)
    return placed(listings if wanted is None else listings.where(wanted), *result_order())
