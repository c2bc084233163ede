"""Path language: `$.a.b[0]["c.d"]`, compiled once on the driver into steps, and from there into a Spark column."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


class PathError(ValueError):
    """A malformed path expression."""


@dataclass(frozen=True)
class Path:
    """A selector of one scalar. Steps are keys (str) and indices (int, negative from the end). No steps: selects nothing."""

    expression: str = ""
    steps: tuple[str | int, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.steps)

    def resolve(self, doc: object) -> str | None:
        """The selected scalar as text, or None."""
        if not self.steps:
            return None
        for step in self.steps:
            if isinstance(step, str):
                if not isinstance(doc, dict) or step not in doc:
                    return None
            elif not isinstance(doc, list) or not -len(doc) <= step < len(doc):
                return None
            doc = doc[step]
        return scalar_text(doc)

    def canonical(self) -> str:
        """One spelling for all expressions that select the same."""
        out = "$"
        for step in self.steps:
            if isinstance(step, int):
                out += f"[{step}]"
            elif not step or step.isdecimal() or "." in step or "[" in step:
                out += '["' + step.replace("\\", "\\\\").replace('"', '\\"') + '"]'
            else:
                out += "." + step
        return out

    def last_segment(self) -> str:
        """Name for a field that holds the selected value: the last key."""
        return next((s for s in reversed(self.steps) if isinstance(s, str)), "")

    def sql(self, doc: str) -> str:
        """The selected scalar of a variant, given as SQL text, as SQL text for a string; null if there is none."""
        if not self.steps:
            return "CAST(NULL AS STRING)"
        plain = "$"
        for step in self.steps:
            if isinstance(step, int) and step >= 0:
                plain += f"[{step}]"
            elif isinstance(step, str) and re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", step):
                plain += f".{step}"
            else:  # what the variant's own paths can't say
                doc, plain = _got(doc, plain), "$"
                doc = f"try_element_at(TRY_CAST({doc} AS ARRAY<VARIANT>), {step})" if isinstance(step, int) else f"try_element_at(TRY_CAST({doc} AS MAP<STRING, VARIANT>), {literal(step)})"
        return variant_text(_got(doc, plain))

    def column(self, doc: str = "doc", raw: str | None = None) -> Column:
        """The selected scalar of a variant (a column's name or SQL text) as text. raw: the JSON text that the variant was read from,
        in which most scalars are found more cheaply."""
        return F.expr(self.sql(doc) if raw is None else self.sql_of_text(raw, doc))

    def sql_of_text(self, raw: str, doc: str | None = None) -> str:
        """sql() of JSON text. What the text holds is taken as it stands where it begins with a letter (only strings and booleans do) or is a
        short whole number; other values are read as a variant."""
        slow = self.sql(doc or f"parse_json({raw})")
        if not self.steps or not all(isinstance(s, str) and re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", s) for s in self.steps):
            return slow
        quick = f"get_json_object({raw}, '$.{'.'.join(self.steps)}')"
        return f"CASE WHEN {quick} RLIKE '^([A-Za-z_]|(0|-?[1-9][0-9]{{0,14}})$)' THEN {quick} WHEN {quick} IS NOT NULL THEN {slow} END"


def _got(doc: str, path: str) -> str:
    return doc if path == "$" else f"try_variant_get({doc}, '{path}', 'variant')"


def literal(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def compile_path(expression: str) -> Path:
    """Parses an expression; PathError names what is wrong."""

    def fail(why: str) -> PathError:
        return PathError(f"path {expression!r} ({expression}): {why}")

    if not expression.startswith("$."):
        raise fail("must start with $.")
    steps: list[str | int] = []
    at, n = 2, len(expression)
    expect_key = True
    while at < n or expect_key:
        if expect_key:
            end = at
            while end < n and expression[end] not in ".[":
                end += 1
            if end == at:
                raise fail("empty segment")
            steps.append(expression[at:end])
            at, expect_key = end, False
        elif expression[at] == ".":
            at, expect_key = at + 1, True
        elif expression[at] == "[":
            if expression[at + 1 : at + 2] == '"':
                key, at = "", at + 2
                while True:
                    if at >= n:
                        raise fail("unterminated quoted key")
                    c = expression[at]
                    if c == '"':
                        break
                    if c == "\\":
                        at += 1
                        if expression[at : at + 1] not in ('"', "\\"):
                            raise fail("unknown escape")
                        c = expression[at]
                    key += c
                    at += 1
                if expression[at + 1 : at + 2] != "]":
                    raise fail("quoted key must end with ]")
                steps.append(key)
                at += 2
            else:
                end = expression.find("]", at)
                digits = expression[at + 1 : end] if end > 0 else ""
                if not digits.removeprefix("-").isdecimal() or not digits.isascii():
                    raise fail("index must be an integer")
                steps.append(int(digits))
                at = end + 1
        else:
            raise fail("expected . or [")
    return Path(expression, tuple(steps))


def number_text(value: float) -> str:
    """Shortest decimal form of a double, never with an exponent."""
    text = format(Decimal(repr(value)), "f")
    return text.removesuffix(".0")


def scalar_text(value: object) -> str | None:
    """Text of a JSON scalar; None for null, objects and arrays. Numbers are doubles."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        try:
            return number_text(float(value))
        except (OverflowError, ValueError, ArithmeticError):
            return None
    return None


def _bound(value: str, name: str, out: str) -> str:
    """SQL text of `out`, in which `name` stands for the value: computed once."""
    return f"get(transform(array({value}), {name} -> {out}), 0)"


def variant_text(value: str) -> str:
    """scalar_text of a variant as SQL text. Integers up to 2**53 are taken as they are, other numbers through double."""
    number = double_text("try_variant_get(v, '$', 'double')")
    return _bound(
        value,
        "v",
        f"""CASE WHEN schema_of_variant(v) IN ('STRING', 'BOOLEAN') THEN try_variant_get(v, '$', 'string')
        WHEN schema_of_variant(v) = 'BIGINT' AND try_variant_get(v, '$', 'bigint') BETWEEN -{1 << 53} AND {1 << 53} THEN try_variant_get(v, '$', 'string')
        WHEN schema_of_variant(v) IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith(schema_of_variant(v), 'DECIMAL') THEN {number} END""",
    )


def double_text(value: str) -> str:
    """number_text of a double as SQL text: Spark's shortest form, whose point is moved only where it has an exponent."""
    text = _bound("CAST(x AS STRING)", "t", rf"CASE WHEN contains(t, 'E') THEN {_WITHOUT_EXPONENT} ELSE regexp_replace(t, '\\.0$', '') END")
    return _bound(value, "x", f"CASE WHEN NOT isnan(x) AND abs(x) < double('infinity') THEN {text} END")


#: t is sign, one digit, point, digits, E and power; its digits without the point, and the point's new place, give the plain form.
_WITHOUT_EXPONENT = _bound(
    r"named_struct('sign', regexp_extract(t, '^-?', 0), 'digits', concat(regexp_extract(t, '^-?(\\d)', 1), regexp_replace(regexp_extract(t, '\\.(\\d+)', 1), '^0$', '')), 'point', 1 + CAST(regexp_extract(t, 'E(-?\\d+)$', 1) AS INT))",
    "n",
    """CASE WHEN n.point <= 0 THEN concat(n.sign, '0.', repeat('0', -n.point), n.digits)
    WHEN n.point >= length(n.digits) THEN concat(n.sign, rpad(n.digits, n.point, '0'))
    ELSE concat(n.sign, left(n.digits, n.point), '.', substring(n.digits, n.point + 1)) END""",
)


def canonical_json(doc: object) -> str:
    """Text that is equal for equal documents: keys sorted, all numbers as doubles."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return float(x)
        return x

    return json.dumps(plain(doc), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def stored_bytes(doc: object) -> int:
    """Bytes of a document as stored JSON: sorted keys, doubles without needless fractions, <, >, & and line separators escaped."""
    if isinstance(doc, dict):
        return 2 + max(0, len(doc) - 1) + sum(stored_bytes(k) + 1 + stored_bytes(v) for k, v in doc.items())
    if isinstance(doc, list):
        return 2 + max(0, len(doc) - 1) + sum(map(stored_bytes, doc))
    if isinstance(doc, bool) or doc is None:
        return 5 if doc is False else 4
    if isinstance(doc, str):
        extra = sum(5 * doc.count(c) for c in "<>&") + sum(3 * doc.count(c) for c in "\u2028\u2029")
        return len(json.dumps(doc, ensure_ascii=False).encode("utf-8", "surrogatepass")) + extra
    x = float(doc)
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        return len(number_text(x))
    mantissa, _, exponent = repr(x).partition("e")
    return len(f"{mantissa.removesuffix('.0')}e{exponent[0]}{exponent[1:].zfill(2) if exponent[0] == '+' else exponent[1:].lstrip('0')}")
