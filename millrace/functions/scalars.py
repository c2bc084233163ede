"""Scalar functions with exact formats: time stamps, coercions, output ids, index names, retry delays."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def stamp(text: Column) -> Column:
    """RFC 3339 text as a timestamp (microseconds); null if it isn't one."""
    return F.when(text.rlike(STAMP), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))


def rfc3339(at: Column) -> Column:
    """UTC timestamp as text with as many fractional digits as needed."""
    text = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z"))


def to_long(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def to_double(text: Column) -> Column:
    """Decimal and hexadecimal floating-point texts."""
    decimal, hexadecimal = r"(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", r"0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+"
    value = F.when(text.rlike(f"^[+-]?({decimal}|{hexadecimal})$"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def to_boolean(text: Column) -> Column:
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def coerced(text: Column, kind: str) -> Column:
    """The text as the declared type of a promoted field; null where it isn't of that type."""
    made = {"keyword": lambda t: t, "long": to_long, "double": to_double, "boolean": to_boolean, "date": stamp}
    return made[kind](text)


SPARK_TYPES = {"keyword": "string", "long": "bigint", "double": "double", "boolean": "boolean", "date": "timestamp"}


def output_id(rule_id: Column, key: Column, first_observed: Column) -> Column:
    """Deterministic document id."""
    return F.sha2(F.concat_ws(":", rule_id, key, rfc3339(first_observed)), 256)


PLACEHOLDERS = {"yyyy": "yyyy", "MM": "MM", "dd": "dd"}


class IndexPatternError(ValueError):
    """An index pattern that can't be resolved."""


def check_index(pattern: str) -> None:
    """Rejects unknown, unterminated and unmatched placeholders."""
    rest = pattern
    while "{" in rest:
        rest = rest[rest.index("{") + 1 :]
        name, brace, rest = rest.partition("}")
        if not brace:
            raise IndexPatternError(f"index pattern {pattern!r} has an unterminated placeholder")
        if name not in PLACEHOLDERS:
            raise IndexPatternError(f"index pattern {pattern!r} contains unknown placeholder {{{name}}}")
    if "}" in re.sub(r"\{[^}]*\}", "", pattern):
        raise IndexPatternError(f"index pattern {pattern!r} has an unmatched closing brace")


def index_name(pattern: str, at: Column, fallback: Column) -> Column:
    """The pattern with the date of `at`, else of `fallback`, in UTC."""
    out, when = F.lit(pattern), F.coalesce(at, fallback)
    for name, form in PLACEHOLDERS.items():
        if f"{{{name}}}" in pattern:
            out = F.replace(out, F.lit(f"{{{name}}}"), F.date_format(when, form))
    return out


def index_wildcard(pattern: str) -> str:
    """Wildcard that matches all names of a pattern."""
    out = re.sub("|".join(rf"\{{{p}\}}" for p in PLACEHOLDERS), "*", pattern)
    while (shorter := re.sub(r"\*[.\-_]\*", "*", out)) != out:
        out = shorter
    return out


#: First delay, cap, and the least delay at the cap (2**8 first delays).
BASE_DELAY_MS, MAXIMUM_DELAY_MS, LEAST_AT_CAP_MS = 1000, 300_000, 256_000


def retry_delay_ms(output: Column, attempt: Column) -> Column:
    """Delay before the next attempt, in ms: doubling from 1 s with 75 to 100 % of it by a hash; at the cap of 5 min, between the
    largest doubling below it (256 s) and the cap."""
    raw = F.lit(float(BASE_DELAY_MS)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30)))

    def fraction(of: Column) -> Column:
        return F.conv(F.substring(F.sha2(of, 256), 1, 4), 16, 10).cast("double") / 65535

    capped = F.lit(float(LEAST_AT_CAP_MS)) + (MAXIMUM_DELAY_MS - LEAST_AT_CAP_MS) * fraction(F.concat(output, F.lit(":cap")))
    spread = raw * (0.75 + fraction(F.concat(output, F.lit(":"), attempt.cast("string"))) * 0.25)
    return F.when(raw >= MAXIMUM_DELAY_MS, capped).otherwise(spread)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
