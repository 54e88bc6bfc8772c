"""Syntax trees while they are parsed: kinds, spans, and what makes them rows of nodes."""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field
from typing import NamedTuple


@dataclass(slots=True)
class Syn:
    """A node. ``start`` and ``end`` count characters; offsets in rows count bytes."""

    kind: str
    start: int
    end: int
    named: bool = True
    kids: list[Syn] = field(default_factory=list)
    field: str | None = None
    extra: bool = False
    missing: bool = False

    def add(self, *kids: Syn) -> Syn:
        self.kids.extend(kids)
        return self

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.kids))


def token(kind: str, start: int, end: int | None = None) -> Syn:
    """An anonymous token."""
    return Syn(kind, start, start + len(kind) if end is None else end, named=False)


def fitted(node: Syn) -> Syn:
    """``node`` with its span drawn around its children."""
    if node.kids:
        node.start, node.end = node.kids[0].start, node.kids[-1].end
    return node


def settled(root: Syn) -> Syn:
    """``root`` after every node was drawn around its children, which may have grown since they were put there."""
    for node in reversed(list(root.walk())):
        for k in node.kids:
            node.start, node.end = min(node.start, k.start), max(node.end, k.end)
    return root


class Sign(NamedTuple):
    """What a node is, apart from its place."""

    kind: str
    named: bool = True
    extra: bool = False
    missing: bool = False
    field: str | None = None


#: The signs met so far in this process, with their numbers. Numbers differ between processes: they never leave one.
SIGNS: list[Sign] = []
KINDS: list[str] = []
_NUMBERS: dict[tuple, int] = {}


def sign(kind: str, named: bool = True, extra: bool = False, missing: bool = False, field: str | None = None) -> int:
    """The number of a sign."""
    found = _NUMBERS.get(key := (kind, named, extra, missing, field))
    if found is None:
        found = _NUMBERS[key] = len(SIGNS)
        SIGNS.append(Sign(*key))
        KINDS.append(kind)
    return found


class Tape:
    """A tree as five rows of numbers, 20 bytes a node, in pre-order. ``stop[i]``: the first node after i's subtree."""

    __slots__ = ("end", "parent", "signs", "start", "stop")

    def __init__(self):
        self.signs, self.start, self.end, self.parent, self.stop = (array("i") for _ in range(5))

    def closed(self) -> None:
        """Sets ``stop``."""
        self.stop = stop = array("i", range(1, len(self.signs) + 1))
        parent = self.parent
        for i in range(len(stop) - 1, 0, -1):
            p = parent[i]
            if stop[p] < stop[i]:
                stop[p] = stop[i]

    def settle(self) -> None:
        """Draws every node around its children."""
        start, end, parent = self.start, self.end, self.parent
        for i in range(len(parent) - 1, 0, -1):
            p = parent[i]
            if start[i] < start[p]:
                start[p] = start[i]
            if end[i] > end[p]:
                end[p] = end[i]

    def syn(self) -> Syn:
        made: list[Syn] = []
        for i, n in enumerate(self.signs):
            kind, named, extra, missing, label = SIGNS[n]
            made.append(Syn(kind, self.start[i], self.end[i], named, [], label, extra, missing))
            if i:
                made[self.parent[i]].kids.append(made[i])
        return made[0]


def taped(root: Syn) -> Tape:
    tape = Tape()
    signs, start, end, parent = tape.signs.append, tape.start.append, tape.end.append, tape.parent.append
    at, stack = 0, [(root, -1)]
    while stack:
        node, above = stack.pop()
        signs(sign(node.kind, node.named, node.extra, node.missing, node.field))
        start(node.start)
        end(node.end)
        parent(above)
        if node.kids:
            stack.extend([(k, at) for k in reversed(node.kids)])
        at += 1
    tape.closed()
    return tape


def error(start: int, end: int) -> Syn:
    return Syn("ERROR", start, end)


def has_error(root: Syn, missing_too: bool = True) -> bool:
    return any(n.kind == "ERROR" or missing_too and n.missing for n in root.walk())
