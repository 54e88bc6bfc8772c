"""Queries: S-expressions over node kinds, fields and captures, against a syntax tree.

Supported: named kinds, ``_``, ``(_ ...)``, tokens in quotes, fields and ``!field``, nesting, ``[ ... ]`` of alternatives, the
anchor ``.``, the quantifiers ``? * +``, captures, and #eq?, #not-eq?, #match?, #not-match?, #any-of?. Children keep their
order, others may stand between. An optional child captures nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions import regex
from ..langs.index import Tree
from ..rules.model import RuleError
from .match import Captures, Match, node_bound

TOKEN = re.compile(r"\s+|;[^\n]*|(?P<string>\"(?:\\.|[^\"\\])*\")|(?P<field>[A-Za-z_][\w.-]*):|(?P<not>![A-Za-z_]\w*)|(?P<capture>@[\w.-]+)|(?P<test>#[\w.-]+[?!])|(?P<name>[A-Za-z_][\w.-]*)|(?P<sign>[()\[\].?*+])")
TESTS = {"#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?"}


@dataclass
class Part:
    kind: str | None = None  # None: any
    named: bool = True
    anything: bool = False  # tokens too
    choices: list[Part] = field(default_factory=list)
    kids: list[Part] = field(default_factory=list)
    label: str | None = None
    absent: list[str] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    follows: bool = False  # an anchor stands before it
    last: bool = False
    optional: bool = False


class _Parser:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        while at < len(source):
            m = TOKEN.match(source, at)
            if m is None:
                raise RuleError(f"query: unexpected {source[at]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.at, self.tests = 0, []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def top(self) -> list[Part]:
        parts = []
        while self.peek()[0] != "end":
            parts.append(self.part())
        if not parts:
            raise RuleError("query: nothing to match")
        return parts

    def part(self) -> Part:
        kind, text = self.next()
        if kind == "field":
            part = self.part()
            part.label = text
            return part
        if kind == "string":
            part = Part(re.sub(r"\\(.)", r"\1", text[1:-1]), named=False)
        elif kind == "name" and text == "_":
            part = Part(anything=True)
        elif (kind, text) == ("sign", "["):
            part = Part()
            while self.peek() != ("sign", "]"):
                if self.peek()[0] == "end":
                    raise RuleError("query: missing ]")
                part.choices.append(self.part())
            self.next()
        elif (kind, text) == ("sign", "("):
            part = self.inside()
        else:
            raise RuleError(f"query: unexpected {text or 'end'!r}")
        while True:
            kind, text = self.peek()
            if kind == "capture":
                part.captures.append(self.next()[1][1:])
            elif (kind, text) in (("sign", "?"), ("sign", "*")):
                self.next()
                part.optional = True
            elif (kind, text) == ("sign", "+"):
                self.next()
            else:
                return part

    def inside(self) -> Part:
        if self.peek()[0] in ("sign", "string") and self.peek()[1] != ")":
            part = self.part()  # a group of one
            if self.next() != ("sign", ")"):
                self.at -= 1
                self.test_list()
            return part
        kind, text = self.next()
        if kind != "name":
            raise RuleError(f"query: expected a kind, got {text or 'end'!r}")
        part = Part(None if text == "_" else text)
        anchored = False
        while True:
            kind, text = self.peek()
            if (kind, text) == ("sign", ")"):
                self.next()
                if anchored and part.kids:
                    part.kids[-1].last = True
                return part
            if kind == "end":
                raise RuleError("query: missing )")
            if (kind, text) == ("sign", "."):
                self.next()
                anchored = True
            elif kind == "not":
                part.absent.append(self.next()[1][1:])
            elif (kind, text) == ("sign", "(") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] == "test":
                self.next()
                self.test()
            else:
                kid = self.part()
                kid.follows, anchored = anchored, False
                part.kids.append(kid)

    def test_list(self) -> None:
        while self.peek() != ("sign", ")"):
            if self.next() != ("sign", "("):
                raise RuleError("query: expected a predicate")
            self.test()
        self.next()

    def test(self) -> None:
        _, name = self.next()
        if name not in TESTS:
            raise RuleError(f"query: unsupported predicate {name}")
        args = []
        while self.peek() != ("sign", ")"):
            kind, text = self.next()
            if kind not in ("capture", "string", "name"):
                raise RuleError(f"query: bad argument of {name}")
            args.append(("capture", text[1:]) if kind == "capture" else ("text", re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "string" else text))
        self.next()
        self.tests.append((name, args))


def captured(parts: list[Part]) -> list[str]:
    found: list[str] = []
    for p in parts:
        found += [*p.captures, *captured(p.choices), *captured(p.kids)]
    return list(dict.fromkeys(found))


@dataclass
class Query:
    parts: list[Part]
    tests: list[tuple[str, list[tuple[str, str]]]]
    names: list[str]


def compile_query(body: str) -> Query:
    parser = _Parser(body)
    parts = parser.top()
    names = captured(parts)
    if not names:
        raise RuleError("query: needs at least one capture")
    for test, args in parser.tests:
        if "match" in test:
            regex.compiled(args[1][1])
    return Query(parts, parser.tests, names)


def _fits(tree: Tree, part: Part, i: int) -> bool:
    if part.choices or part.anything:
        return True
    node = tree.sign(i)
    return node.named if part.kind is None else node.kind == part.kind and node.named == part.named


def _below(tree: Tree, part: Part, i: int, bound: Captures) -> Iterator[Captures]:
    """Every way in which a node that fits a part can be that part, with captures."""
    if part.absent and any(tree.sign(k).field in part.absent for k in tree.children(i)):
        return
    if part.choices:
        starts = (own for choice in part.choices if _fits(tree, choice, i) for own in _below(tree, choice, i, bound))
    else:
        starts = iter((bound,))
    kids = [k for k in part.kids if not k.optional]
    for own in starts:
        if part.captures:
            own = own | dict.fromkeys(part.captures, node_bound(tree, i))
        yield from _kids(tree, kids, 0, i, None, own) if kids else (own,)


def _kids(tree: Tree, kids: list[Part], n: int, i: int, before: int | None, bound: Captures) -> Iterator[Captures]:
    if n == len(kids):
        yield bound
        return
    kid = kids[n]
    tokens = not kid.named or kid.anything
    order = (tree.child_ord if tokens else tree.named_ord) if kid.follows else None
    for k in tree.children(i, before):
        if not _fits(tree, kid, k) or kid.label and tree.sign(k).field != kid.label:
            continue
        if order is not None and order[k] != (0 if before is None else order[before] + 1 if order[before] >= 0 else -1):
            continue
        if kid.last and (tree.end(k) != tree.end(i) if tokens else not (own := tree.named(i)) or k != own[-1]):
            continue
        for found in _below(tree, kid, k, bound):
            yield from _kids(tree, kids, n + 1, i, k, found)


def _passes(query: Query, bound: Captures) -> bool:
    for test, args in query.tests:
        texts = [(x.text if (x := bound.get(text)) else None) if kind == "capture" else text for kind, text in args]
        if texts[0] is None or texts[1] is None and test in ("#eq?", "#not-eq?"):
            return False
        if "match" in test:
            ok = regex.compiled(args[1][1]).search(texts[0]) is not None
        else:
            ok = texts[0] in texts[1:]
        if ok == ("not" in test):
            return False
    return True


def query_matches(tree: Tree, query: Query) -> list[tuple[Match, int, int]]:
    """All matches, each with the first and the last byte that its captures cover. What is matched is the capture ``match`` or
    ``target``, else the widest one."""
    found = []
    for branch, part in enumerate(query.parts):
        roots = tree.of_kind(part.kind) if part.kind is not None and not part.choices else range(len(tree.nodes))
        for i in roots:
            if _fits(tree, part, i):
                for bound in _below(tree, part, i, {}):
                    if bound and _passes(query, bound):
                        found.append((branch, i, [bound[n].node if n in bound else -1 for n in query.names], bound))
    found.sort(key=lambda x: x[:3])
    out = []
    for order, (_, top, _, bound) in enumerate(found):
        chosen = next((bound[n] for n in reversed(query.names) if n in ("match", "target") and n in bound), None)
        if chosen is None:
            if {"match", "target"} & set(query.names):
                continue
            chosen = max((bound[n] for n in query.names if n in bound), key=lambda b: b.end - b.start)
        at = chosen.node
        out.append((Match((top, order), at, at, tree.start(at), tree.end(at), bound), min(b.start for b in bound.values()), max(b.end for b in bound.values())))
    return out
