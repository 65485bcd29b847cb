"""Field tests of detection rules as non-null boolean columns.

A test is checked when it is created, on the driver, so that an unusable rule is refused before
any job starts; ``column`` then only builds expressions. Every result is true or false, never NULL,
so that negation keeps its two-valued meaning.
"""

from __future__ import annotations

import dataclasses
import ipaddress
import operator
import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchspan.functions.network import in_network


class RuleError(ValueError):
    """A rule that cannot be used; the message says why."""


# The modifiers a field name may carry.
MODIFIERS = ["contains", "startswith", "endswith", "all", "re", "cidr", "lt", "lte", "gt", "gte",
             "exists"]
COMPARISONS = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
NUMBER = r"(?i)\A\s*[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?)\s*\z"


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(operator.or_, tests, F.lit(False))


def all_of(tests: Iterable[Column]) -> Column:
    return reduce(operator.and_, tests, F.lit(True))


def _certain(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def text_of(value: Any) -> str:
    """How a rule value is compared: booleans in lower case, everything else as printed."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def has_wildcard(text: str) -> bool:
    return "*" in text or "?" in text


# A backslash before a wildcard makes it literal; two of them are one backslash and a wildcard.
_WILDCARD_PIECES = re.compile(r"\\(?P<literal>[*?])|(?P<backslash>\\\\)(?=[*?])|(?P<many>\*)|(?P<one>\?)|.",
                              re.S)


def wildcard_pattern(text: str) -> str:
    """``*`` and ``?`` as a regular expression body."""
    def piece(found: re.Match) -> str:
        if found["many"]:
            return ".*"
        if found["one"]:
            return "."
        if found["backslash"]:
            return re.escape("\\")
        return re.escape(found["literal"] or found[0])
    return _WILDCARD_PIECES.sub(piece, text)


# Pieces of a Python pattern: an escaped character, the ends of a class, and what Java reads in another way.
_PATTERN_PIECES = re.compile(r"\\(?P<escaped>.)|(?P<upto>\{,(?=\d*\}))|\(\?P=(?P<again>\w+)\)|(?P<named>\(\?P<\w+>)|(?P<open>\[\^?\]?)|.", re.S)


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java: dot matches all, Unicode classes, only ``\\n`` ends a line.

    Inside a class Java nests brackets and intersects at ``&&``; both are plain characters in Python. ``{,n}`` and
    ``\\Z`` are written in other ways, and named groups become plain ones, as Java allows fewer names.
    """
    numbers = re.compile(pattern).groupindex
    inside = False

    def piece(found: re.Match) -> str:
        nonlocal inside
        if found["escaped"]:
            return r"\z" if found["escaped"] == "Z" and not inside else found[0]
        if inside:
            inside = found[0][-1] != "]"
            return "".join(rf"\{c}" if c in "[&" else c for c in found[0])
        if found["open"]:
            inside = True
            return found[0].replace("]", r"\]")
        if found["upto"]:
            return "{0,"
        if found["again"]:
            return rf"(?:\{numbers[found['again']]})"
        return "(" if found["named"] else found[0]

    return "(?sdU)" + _PATTERN_PIECES.sub(piece, pattern)


@dataclasses.dataclass(frozen=True)
class TextColumns:
    """The text under test and the same text in lower case."""

    text: Column
    lower: Column


def _regex(value: Any) -> str:
    try:
        return java_pattern(str(value))
    except re.error as fault:
        raise RuleError(f"not a pattern: {value!r} ({fault})") from fault


def _network(value: Any) -> str:
    try:
        return str(ipaddress.ip_network(str(value), strict=False))
    except ValueError as fault:
        raise RuleError(f"not a network: {value!r}") from fault


def _number(value: Any) -> float:
    try:
        return float(value)
    except (TypeError, ValueError) as fault:
        raise RuleError(f"not a number to compare with: {value!r}") from fault


def _needle(value: Any) -> str:
    return text_of(value).lower()


def _empty(field: TextColumns) -> Column:
    return F.coalesce(field.text, F.lit("")) == ""


def _matching(before: str, after: str, plain: Callable[[Column, Column], Column]) -> Callable[[TextColumns, str], Column]:
    """``plain`` for a needle without wildcards, else a pattern between ``before`` and ``after``."""
    return lambda field, needle: (field.lower.rlike(f"(?s){before}{wildcard_pattern(needle)}{after}") if has_wildcard(needle)
                                  else plain(field.lower, F.lit(needle)))


def _comparing(compare: Callable[[Any, Any], Any]) -> Callable[[TextColumns, float], Column]:
    def build(field: TextColumns, limit: float) -> Column:
        digits = F.regexp_replace(F.trim(field.text), "_", "")
        return compare(F.when(field.text.rlike(NUMBER), digits.try_cast("double")), F.lit(limit))
    return build


@dataclasses.dataclass(frozen=True)
class Kind:
    """A way to compare: ``read`` makes the operand of a rule's value or refuses it, ``build`` the expression."""

    read: Callable[[Any], Any]
    build: Callable[[TextColumns, Any], Column]


#: The first of these that a field name carries decides; a name without any is compared whole.
KINDS = {
    "exists": Kind(bool, lambda field, given: _empty(field) != given),
    "re": Kind(_regex, lambda field, pattern: field.text.rlike(pattern)),
    "cidr": Kind(_network, lambda field, network: in_network(field.text, network)),
    **{name: Kind(_number, _comparing(compare)) for name, compare in COMPARISONS.items()},
    "contains": Kind(_needle, _matching("", "", F.contains)),
    "startswith": Kind(_needle, lambda field, needle: F.startswith(field.lower, F.lit(needle))),
    "endswith": Kind(_needle, lambda field, needle: F.endswith(field.lower, F.lit(needle))),
}
WHOLE = Kind(_needle, _matching(r"\A", r"\z", operator.eq))


@dataclasses.dataclass(frozen=True)
class FieldTest:
    """One line of a rule. ``name`` is NULL for the raw line; an operand of None asks for an empty field."""

    name: str | None
    kind: Kind
    operands: tuple[Any, ...]
    every: bool = False

    @classmethod
    def of(cls, name: str | None, kind: Kind, values: Iterable[Any], every: bool = False) -> FieldTest:
        return cls(name, kind, tuple(None if v is None and kind.read is not bool else kind.read(v) for v in values), every)

    @property
    def patterns(self) -> list[str]:
        """Regular expressions that Java still has to accept."""
        return [p for p in self.operands if p is not None] if self.kind is KINDS["re"] else []

    def column(self, field: TextColumns) -> Column:
        tests = [_empty(field) if v is None else _certain(self.kind.build(field, v)) for v in self.operands]
        return all_of(tests) if self.every else any_of(tests)


def field_test(key: str, expected: Any) -> FieldTest:
    """``field|modifiers`` and the value or values it is compared with."""
    name, *carried = key.split("|")
    if strange := sorted(set(carried) - set(MODIFIERS)):
        raise RuleError(f"field {name!r} has modifiers that do not exist: {', '.join(strange)}")
    kind = next((k for m, k in KINDS.items() if m in carried), WHOLE)
    values = expected if isinstance(expected, list) and "exists" not in carried else [expected]
    return FieldTest.of(name, kind, values, every="all" in carried)


Lookup = Callable[[str | None], TextColumns]


@dataclasses.dataclass(frozen=True)
class Selection:
    """Alternatives, each a list of tests that must all hold."""

    alternatives: tuple[tuple[FieldTest, ...], ...]

    @property
    def tests(self) -> list[FieldTest]:
        return [test for tests in self.alternatives for test in tests]

    def column(self, lookup: Lookup) -> Column:
        return any_of(all_of(test.column(lookup(test.name)) for test in tests)
                      for tests in self.alternatives)


def selection(spec: Any) -> Selection:
    """A map (all fields), a list of maps (any map) or a list of words (any word in the raw line)."""
    items = spec if isinstance(spec, list) else [spec]
    maps = [isinstance(item, dict) for item in items]
    if all(maps):
        return Selection(tuple(tuple(field_test(str(k), v) for k, v in item.items()) for item in items))
    if isinstance(spec, list) and not any(m or isinstance(item, list) for m, item in zip(maps, items)):
        return Selection(((FieldTest.of(None, KINDS["contains"], items),),))
    raise RuleError(f"a selection is a map, a list of maps or a list of words, not {spec!r}")
