"""A rule in a language, ready to run in any task: patterns, queries and regular expressions are compiled and checked once."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from re import Pattern as Regex

from ..functions.regex import compiled as regex
from ..langs import LANGUAGES, Language, language
from ..rules.model import Matcher, Predicate, Rule, RuleError
from .pattern import Pattern, compile_pattern
from .query import Query, compile_query


#: Texts that a file is searched for before it's parsed.
NEEDED = 8


@dataclass(eq=False)
class Step:
    """A matcher. ``names``: what it may capture; ``wins``: its captures replace what is bound, as those of queries do."""

    kind: str
    parts: list[Step] = field(default_factory=list)
    where: list[Check] = field(default_factory=list)
    pattern: Pattern | None = None
    query: Query | None = None

    @cached_property
    def names(self) -> list[str]:
        own = self.pattern.names if self.pattern else self.query.names if self.query else []
        return own if own or self.kind == "not" else list(dict.fromkeys(n for p in self.parts for n in p.names))

    @cached_property
    def wins(self) -> bool:
        return self.query is not None or self.kind != "not" and any(p.wins for p in self.parts)

    @cached_property
    def finds(self) -> bool:
        """Whether it names nodes by itself, as opposed to ruling some out."""
        return self.kind in ("pattern", "query") or self.kind != "not" and any(p.finds for p in self.parts)


@dataclass(eq=False)
class Check:
    """A condition. ``op`` is as in a Predicate."""

    op: str
    var: str
    value: object
    negated: bool
    parts: list[Check]
    step: Step | None
    search: Regex | None


@dataclass(eq=False)
class Near:
    """A relation: inside, has, precedes or follows."""

    name: str
    directly: bool
    negated: bool
    step: Step


class Compiled:
    """A rule whose patterns and queries are known to fit the language."""

    def __init__(self, rule: Rule, lang: Language):
        self.rule, self.lang = rule, lang
        self.match = self._step(rule.match) if rule.match is not None else None
        if self.match is None or not self.match.finds:
            raise RuleError(f"rule {rule.id!r} needs a positive matcher")
        self.near = [Near(r.name, r.directly, r.negated, self._step(r.matcher)) for r in rule.relations]
        self.where = [self._check(p) for p in rule.where]
        if rule.report and rule.report != "match" and rule.report not in {*self.match.names, *(n for r in self.near if not r.negated for n in r.step.names)}:
            raise RuleError(f"rule {rule.id!r}: report names ${rule.report}, which nothing captures")

    def _step(self, m: Matcher) -> Step:
        if m.kind == "pattern":
            return Step("pattern", pattern=compile_pattern(m.body, self.lang))
        if m.kind == "query":
            return Step("query", query=compile_query(m.body))
        return Step(m.kind, [self._step(p) for p in m.parts], [self._check(p) for p in m.where])

    def _check(self, p: Predicate) -> Check:
        search = regex(p.value) if p.op == "matches" else None
        return Check(p.op, p.var, p.value, p.negated, [self._check(x) for x in p.parts], self._step(p.matcher) if p.matcher is not None else None, search)

    @cached_property
    def anchor(self) -> str:
        """A word that every matching file contains; empty if none is known."""
        return max((self._anchor(self.match), *(self._anchor(r.step) for r in self.near if not r.negated)), key=len)

    @cached_property
    def needs(self) -> list[str]:
        """Texts that every matching file contains, the longest ones if there are many; those in the anchor are left out."""
        found = self._texts(self.match).union(*(self._texts(r.step) for r in self.near if not r.negated))
        return sorted((t for t in found if t not in self.anchor), key=lambda t: (-len(t), t))[:NEEDED]

    def _texts(self, step: Step) -> frozenset[str]:
        if step.pattern is not None:
            return step.pattern.texts
        if step.kind == "any" and step.parts:
            return frozenset.intersection(*map(self._texts, step.parts))
        return frozenset().union(*map(self._texts, step.parts)) if step.kind == "all" else frozenset()

    def _anchor(self, step: Step) -> str:
        if step.pattern is not None:
            return step.pattern.anchor
        return max(map(self._anchor, step.parts), key=len, default="") if step.kind == "all" else ""


def compile_rule(rule: Rule) -> list[Compiled]:
    """The rule for each of its languages. Named ones must all compile; without names, those that aren't explicit-only and do."""
    if rule.languages:
        found = []
        for name in rule.languages:
            try:
                lang = language(name)
            except KeyError:
                raise RuleError(f"rule {rule.id!r}: unknown language {name!r}") from None
            found.append(Compiled(rule, lang))
        return found
    found, why = [], "no language is open to rules that name none"
    for lang in LANGUAGES:
        if not lang.explicit:
            try:
                found.append(Compiled(rule, lang))
            except RuleError as e:
                why = str(e)
    if not found:
        raise RuleError(f"rule {rule.id!r} fits no language: {why}")
    return found
