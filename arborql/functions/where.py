"""Conditions on captures. Logic has two values: an unbound capture makes its condition false, ``not`` or not."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from typing import NamedTuple

BLANK = " \t\n\r\f\x0b\x85\xa0"
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity)")
SIGNS: dict[str, Callable] = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}


class Bound(NamedTuple):
    """What a metavariable stands for: a node, or (``variadic``) the text of ``count`` nodes, or text between two tokens."""

    text: str
    node: int | None = None
    kind: str | None = None
    start: int | None = None
    end: int | None = None
    variadic: bool = False
    count: int = 1


def number(text: str) -> float | None:
    """A capture as a number, None if it's none."""
    trimmed = text.strip(BLANK)
    return float(trimmed) if NUMBER.fullmatch(trimmed) else None


def line_count(text: str) -> int:
    return text.count("\n") + 1 if text else 0


VALUES: dict[str, Callable[[Bound], float | None]] = {
    "number": lambda b: number(b.text),
    "length": lambda b: len(b.text),
    "lines": lambda b: line_count(b.text),
    "count": lambda b: b.count if b.variadic else 1,
}


def holds(check, bound: dict[str, Bound], exists: Callable) -> bool:
    """Whether a condition (plans.compile.Check) holds; ``exists(check, capture)`` answers an ``is``."""
    if check.op == "any":
        return any(holds(x, bound, exists) for x in check.parts)
    if check.op == "all":
        return all(holds(x, bound, exists) for x in check.parts)
    b = bound.get(check.var)
    if b is None:
        return False
    if check.op == "is":
        return exists(check, b) != check.negated
    if check.op == "matches":
        return (check.search.search(b.text) is not None) != check.negated
    if check.op == "in":
        return (b.text in check.value) != check.negated
    if check.op == "kind_in":
        return (b.kind in check.value) != check.negated
    if check.op in ("eq_var", "ne_var"):
        other = bound.get(check.value)
        return other is not None and SIGNS[check.op[:2]](b.text, other.text)
    if check.op in ("eq_text", "ne_text"):
        return SIGNS[check.op[:2]](b.text, check.value)
    what, sign = check.op.split("_")
    value = VALUES[what](b)
    return value is not None and SIGNS[sign](value, check.value)
