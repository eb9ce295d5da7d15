"""Criteria documents: one small JSON file, a parameter of a query, checked on the driver with every issue reported."""

from __future__ import annotations

import json
import re
from typing import Any

from marlstone import policies
from marlstone.operators.search import Criteria

Issue = tuple[str, int, str, str, str]

_AREA = re.compile(r"([0-9]+)(?:\.([0-9]+))?", re.ASCII)


def _issue(at: str, code: str, category: str = "INPUT_SCHEMA") -> Issue:
    return ("criteria", -1, f"$.{at}" if at else "$", category, code)


def hundredths(text: str) -> int | None:
    """A positive decimal as exact hundredths; None where there are none or they don't fit a long."""
    m = _AREA.fullmatch(text)
    if m is None or (m[2] or "")[2:].strip("0"):
        return None
    value = int(m[1]) * 100 + int((m[2] or "")[:2].ljust(2, "0"))
    return value if 1 <= value <= policies.MAX_INTEGER else None


def _not_standard(name: str) -> None:
    raise ValueError(name)


def _members(value: dict, at: str, required: tuple[str, ...], known: tuple[str, ...]) -> list[Issue]:
    dot = f"{at}." if at else ""
    return [_issue(f"{dot}{k}", "missing_field") for k in required if k not in value] + [_issue(f"{dot}{k}", "extra_field") for k in value if k not in known]


def _price(value: Any) -> list[Issue]:
    at = "criteria.maximum_price"
    if not isinstance(value, dict):
        return [_issue(at, "wrong_type")]
    out = _members(value, at, ("amount_minor", "currency"), ("amount_minor", "currency"))
    if "amount_minor" in value:
        amount = value["amount_minor"]
        if type(amount) is not int:
            out.append(_issue(f"{at}.amount_minor", "wrong_type"))
        elif not 1 <= amount <= policies.MAX_INTEGER:
            out.append(_issue(f"{at}.amount_minor", "invalid_criterion"))
    if "currency" in value:
        if not isinstance(value["currency"], str):
            out.append(_issue(f"{at}.currency", "wrong_type"))
        elif value["currency"] != policies.SUPPORTED_CURRENCY:
            out.append(_issue(f"{at}.currency", "invalid_criterion"))
    return out


def _rooms(value: Any) -> list[Issue]:
    at = "criteria.allowed_rooms"
    if not isinstance(value, list):
        return [_issue(at, "wrong_type")]
    out, seen = [_issue(at, "invalid_criterion")] if not value else [], set()
    for k, room in enumerate(value):
        if type(room) is not int:
            out.append(_issue(f"{at}[{k}]", "wrong_type"))
            continue
        if room in seen or not 0 <= room <= 99:
            out.append(_issue(f"{at}[{k}]", "invalid_criterion"))
        seen.add(room)
    return out


def _area(value: Any) -> list[Issue]:
    at = "criteria.minimum_total_area"
    if not isinstance(value, str):
        return [_issue(at, "wrong_type")]
    return [] if hundredths(value) is not None else [_issue(at, "invalid_criterion")]


def check(document: Any) -> list[Issue]:
    """Every issue of a parsed document, in canonical order."""
    if not isinstance(document, dict):
        return [_issue("", "wrong_type")]
    out = _members(document, "", ("schema_version", "criteria"), ("schema_version", "criteria"))
    if "schema_version" in document:
        version = document["schema_version"]
        if not isinstance(version, str):
            out.append(_issue("schema_version", "wrong_type"))
        elif version != policies.CRITERIA_VERSION:
            out.append(_issue("schema_version", "unsupported_schema_version"))
    if "criteria" in document:
        criteria = document["criteria"]
        if not isinstance(criteria, dict):
            out.append(_issue("criteria", "wrong_type"))
        else:
            checks = {"maximum_price": _price, "minimum_total_area": _area, "allowed_rooms": _rooms}
            out += _members(criteria, "criteria", (), tuple(checks))
            for k, f in checks.items():
                if k in criteria:
                    out += f(criteria[k])
    return sorted(out)


def load(text: str) -> tuple[Criteria | None, list[Issue]]:
    """The criteria, or the issues of the text."""
    try:
        document = json.loads(text, parse_constant=_not_standard)
    except (ValueError, RecursionError):
        return None, [_issue("", "invalid_json", "INPUT_SYNTAX")]
    if issues := check(document):
        return None, issues
    c = document["criteria"]
    price = c.get("maximum_price", {})
    rooms = frozenset(c["allowed_rooms"]) if "allowed_rooms" in c else None
    return Criteria(price.get("amount_minor"), price.get("currency", policies.SUPPORTED_CURRENCY), hundredths(c["minimum_total_area"]) if "minimum_total_area" in c else None, rooms), []
