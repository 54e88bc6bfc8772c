"""What a rule file says."""

from __future__ import annotations

from dataclasses import dataclass, field


class RuleError(ValueError):
    """A rule that can't be read or compiled."""


@dataclass
class Predicate:
    """A condition on a capture. ``op``: a name of functions.where.LEAVES, ``is``, or ``any`` and ``all`` with parts."""

    op: str
    var: str = ""
    value: object = None
    negated: bool = False
    parts: list[Predicate] = field(default_factory=list)
    matcher: Matcher | None = None


@dataclass
class Matcher:
    """``kind``: pattern, query, any, all or not."""

    kind: str
    body: str = ""
    parts: list[Matcher] = field(default_factory=list)
    where: list[Predicate] = field(default_factory=list)


@dataclass
class Relation:
    """``name``: inside, has, precedes or follows."""

    name: str
    matcher: Matcher
    negated: bool = False
    directly: bool = False


@dataclass
class Case:
    expect: str
    code: str
    count: int = -1
    fixed: str | None = None


@dataclass
class Rule:
    id: str
    file: str = ""
    message: str = ""
    note: str = ""
    url: str = ""
    severity: str = ""
    languages: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    match: Matcher | None = None
    relations: list[Relation] = field(default_factory=list)
    where: list[Predicate] = field(default_factory=list)
    report: str = ""
    fix: str | None = None
    cases: list[Case] = field(default_factory=list)
