"""Raw text to typed values, as columns of ``struct<value, code>``: one of the two is null.

Everything is a built-in expression, so parsing stays in generated code and beside the scan. A parser looks at the raw text
once (``read``: one pattern at most), and what it has found is told apart into value and code by plain comparisons
(``result``). Where both are columns of projections of their own, the optimizer doesn't repeat the reading. Patterns are
anchored with ``\\A`` and ``\\z``, since ``$`` also matches before a line break, and nothing is cast that a pattern hasn't checked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone import policies

#: White space as Unicode-aware splitting sees it; the regex class of the JVM differs.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
# What the data contract takes as identifiers and codes.
PUBLICATION_ID = r"[A-Za-z0-9._:-]{1,128}"
SOURCE_ID = r"[a-z0-9][a-z0-9_-]{0,63}"
OPAQUE_CODE = r"[\x21-\x7E]{1,128}"

_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]"
_MOMENT = rf"\A(?!0000)[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_CLOCK}:[0-5][0-9](?:\.[0-9]{{1,6}})?(?:Z|[+-]{_CLOCK})\z"
_PRICE = r"\A-?[0-9]+(?:\.[0-9]{1,2})?\z"
_AREA = r"\A-?[0-9]+(?:\.[0-9]+)?\z"
#: ASCII but white space, less what ends a host.
_HOST = r"[\x00-\x08\x0e-\x1b\x21-\x7f&&[^/?#:@\[\]]]"
_PORT = r"0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])?"
_URL = rf"\A[\x00-\x08\x0e-\x1b]*(?i:https)://(?:{_HOST}+|\[[0-9A-Fa-f:.]+\])(?::{_PORT})?(?:[/?][\x00-\x08\x0e-\x1b\x21\x22\x24-\x7f]*)?#?\z"
#: What a number that was read stands for, if it isn't a value.
_WRONG = {-1: "invalid_value", -2: "out_of_range", -3: "precision_loss"}


@dataclass(frozen=True)
class Parser:
    """``read``: what the raw text holds, by one look at it; ``result``: raw text and what was read as ``struct<value, code>``."""

    read: Callable[[Column], Column]
    result: Callable[[Column, Column], Column]

    def __call__(self, raw: Column) -> Column:
        return self.result(raw, self.read(raw))


def _result(value: Column, code: Column) -> Column:
    return F.struct(F.when(code.isNull(), value).alias("value"), code.alias("code"))


def _number(raw: Column, read: Column) -> Column:
    code = F.lit(None).cast("string")
    for k, name in _WRONG.items():
        code = F.when(read == k, name).otherwise(code)
    return _result(read, code)


def _as_it_is(raw: Column, good: Column) -> Column:
    return _result(raw, F.when(~F.coalesce(good, F.lit(False)), "invalid_value"))


def full_match(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def opaque_code(c: Column) -> Column:
    """Is it a code: 1 to 128 printable ASCII characters without blanks?"""
    return full_match(c, OPAQUE_CODE)


def _read_moment(c: Column) -> Column:
    zulu = c.endswith("Z")
    local = F.when(zulu, c).otherwise(F.concat(F.left(c, F.length(c) - 6), F.lit("Z"))).try_cast("timestamp")
    minutes = F.substring(c, -5, 2).try_cast("int") * 60 + F.substring(c, -2, 2).try_cast("int")
    shift = F.when(zulu, 0).when(F.substring(c, -6, 1) == "-", minutes).otherwise(-minutes)
    return F.when(c.rlike(_MOMENT), F.timestamp_micros(F.unix_micros(local) + shift * F.lit(60_000_000).cast("bigint")))


def _moment(raw: Column, read: Column) -> Column:
    # Beyond year 9999 or before year 1 there is no canonical moment.
    kept = (read >= F.lit("0001-01-01 00:00:00").cast("timestamp")) & (read < F.lit("+10000-01-01 00:00:00").cast("timestamp"))
    return _result(read, F.when(~F.coalesce(kept, F.lit(False)), "invalid_value"))


#: RFC 3339 with a zone and at most six fraction digits, as a UTC timestamp.
moment = Parser(_read_moment, _moment)


def rendered_moment(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _fraction(c: Column) -> Column:
    """What follows the dot; empty without one."""
    return F.substring_index(F.substring_index(F.concat(c, F.lit(".")), ".", 2), ".", -1)


def _hundredths(c: Column) -> Column:
    """A checked number times 100 as a positive long; null if it isn't positive or doesn't fit."""
    digits = F.concat(F.substring_index(c, ".", 1), F.rpad(F.substring(_fraction(c), 1, 2), 2, "0"))
    return F.when(~c.startswith("-"), F.ltrim(digits, F.lit("0")).try_cast("bigint"))


def _read_price(c: Column) -> Column:
    return F.when(~c.rlike(_PRICE), F.lit(-1).cast("bigint")).otherwise(F.coalesce(_hundredths(c), F.lit(-2).cast("bigint")))


def _read_area(c: Column) -> Column:
    lost = F.length(F.rtrim(F.substring(_fraction(c), 3, 1 << 30), F.lit("0"))) > 0
    return F.when(~c.rlike(_AREA), F.lit(-1).cast("bigint")).when(lost, F.lit(-3).cast("bigint")).otherwise(F.coalesce(_hundredths(c), F.lit(-2).cast("bigint")))


def _read_rooms(c: Column) -> Column:
    digits = F.ltrim(c, F.lit("0"))
    some = F.when(digits == "", -1).when(F.length(digits) > 2, -2).otherwise(digits.try_cast("int"))
    return F.when(c == "studio", 0).when(~full_match(c, "[0-9]+"), -1).otherwise(some)


#: Major units with at most two fraction digits, as minor units.
price = Parser(_read_price, _number)
#: Square metres as hundredths; digits beyond them must be zeros, which is told before sign and range.
area = Parser(_read_area, _number)
#: ``studio`` is 0; otherwise 1 to 99, leading zeros allowed.
rooms = Parser(_read_rooms, _number)
#: Three capitals; whether they are supported is a state of the outcome, no error.
currency = Parser(lambda c: full_match(c, "[A-Z]{3}"), _as_it_is)
#: White space collapsed; 1 to 500 characters.
location = Parser(lambda c: F.trim(F.regexp_replace(c, f"{SPACE}+", " ")), lambda raw, read: _result(read, F.when(~F.char_length(read).between(1, 500), "invalid_value")))
#: An absolute https URL: ASCII, at most 2048 characters, no blanks, user, password or fragment, a possible port.
url = Parser(lambda c: (F.length(c) <= 2048) & c.rlike(_URL), _as_it_is)


def source_url(c: Column, publication_id: Column) -> Column:
    """Is it the source's own URL of this publication (of any, if the id itself isn't valid)?"""
    cleaned = F.regexp_replace(F.regexp_replace(c, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")
    host = policies.SOURCE_HOST.replace(".", r"\.")
    pattern = rf"\A(?i:https)://{host}/offers/({PUBLICATION_ID})\z"
    same = ~full_match(publication_id, PUBLICATION_ID) | (F.regexp_extract(cleaned, pattern, 1) == publication_id)
    return F.coalesce(c.rlike(r"\A[\x00-\x7f]*\z") & ~c.rlike("[?#]") & cleaned.rlike(pattern) & same, F.lit(False))


def rendered_area(c: Column) -> Column:
    """Hundredths as metres with two fraction digits, by digits: division would go through doubles."""
    digits = F.lpad(c.cast("string"), F.greatest(F.length(c.cast("string")), F.lit(3)), F.lit("0"))
    return F.concat(F.left(digits, F.length(digits) - 2), F.lit("."), F.right(digits, F.lit(2)))
