"""Versioned policies as data. The operators turn them into column expressions."""

from __future__ import annotations

from dataclasses import dataclass

# Identifiers, versions and codes of the data contract.
MAX_INTEGER = 9_223_372_036_854_775_807
SOURCE_ID = "fixture_portal"
SOURCE_HOST = "listings.fixture.example"
LISTINGS_VERSION = "fixture-source-batch@1"
CRITERIA_VERSION = "search-criteria@1"
RESULT_VERSION = "search-result@1"
SUPPORTED_CURRENCY = "RUB"
RULE_VERSIONS = {
    "publication_id": "fixture-publication-id@1",
    "url": "fixture-source-url@1",
    "observed_at": "fixture-observed-at@1",
    "location_text": "fixture-location-text@1",
    "price_major": "fixture-price-major@1",
    "currency": "fixture-currency@1",
    "total_area_sqm": "fixture-total-area-sqm@1",
    "rooms": "fixture-rooms@1",
}
REQUIRED_FIELDS = ("publication_id", "url", "observed_at")
OPTIONAL_FIELDS = ("location_text", "price_major", "currency", "total_area_sqm", "rooms")
CHANGE_POLICY = "publication-change-policy@1"
#: Compared fields, in the policy's order.
CHANGE_FIELDS = ("source_url", "location_text", "price_amount", "currency", "total_area", "rooms")
CANDIDATE_POLICY = "publication-duplicate-candidate-policy@1"
ASSESSMENT_POLICY = "publication-duplicate-policy@1"
OVERSIZED = "prospective_pair_count_exceeds_limit"
REVIEW_REQUIRED = ("CANDIDATE_REQUIRES_MANUAL_REVIEW", "CONFLICTING_EVIDENCE_REQUIRES_MANUAL_REVIEW")
INSUFFICIENT = "INSUFFICIENT_EVIDENCE_NO_CANDIDATE"
LABELS = ("CONFIRMED_RELATIONSHIP", "REJECTED_RELATIONSHIP", "INCONCLUSIVE")


@dataclass(frozen=True)
class Rule:
    """A rule of a policy: its place in it, and the fields that it looks at."""

    position: int
    rule_id: str
    version: str
    fields: tuple[str, ...]


BLOCKING_RULES = (
    Rule(0, "area-rooms-exact-block", "candidate-area-rooms@1", ("total_area", "rooms")),
    Rule(1, "area-location-text-exact-block", "candidate-area-location-text@1", ("total_area", "location_text")),
)
EVIDENCE_RULES = (
    Rule(0, "total-area-comparison", "duplicate-total-area@1", ("total_area",)),
    Rule(1, "rooms-comparison", "duplicate-rooms@1", ("rooms",)),
    Rule(2, "location-text-exact", "duplicate-location-text@1", ("location_text",)),
    Rule(3, "price-exact", "duplicate-price@1", ("price_amount", "currency")),
)
