"""What parsers of programming languages share: tokens, nodes from them, binary operators by precedence, recovery, comments.

Parsers descend recursively. A statement that can't be read becomes an ERROR node that holds its tokens up to where the next
statement may begin, so the rest of a file is still searched. Depth of nesting is bounded (``DEEPEST``); what is nested deeper
is such an error too.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from .tree import Syn

DEEPEST = 120


class Broken(Exception):
    """What stands here isn't what the grammar asks for."""


@dataclass(slots=True)
class Token:
    """``kind``: name, number, string, sign, or a layout token of the language. ``fresh``: it's the first on its line."""

    kind: str
    text: str
    start: int
    end: int
    fresh: bool = False


def named(field: str, node: Syn | None) -> Syn | None:
    """``node`` with a field."""
    if node is not None:
        node.field = field
    return node


class Parser:
    """``tokens`` end with one of kind ``end``. ``keywords`` are names that aren't identifiers."""

    keywords: frozenset[str] = frozenset()

    def __init__(self, source: str, tokens: list[Token]):
        self.source, self.tokens, self.at, self.depth = source, tokens, 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, by: int = 1) -> Token:
        return self.tokens[min(self.at + by, len(self.tokens) - 1)]

    def sees(self, *texts: str) -> bool:
        t = self.tokens[self.at]
        return t.text in texts and t.kind in ("sign", "name", "line")

    def token(self) -> Syn:
        """The current token as an anonymous node."""
        t = self.now
        if t.kind == "end":
            raise Broken
        self.at += 1
        return Syn(t.text, t.start, t.end, named=False)

    def take(self, *texts: str) -> Syn:
        if not self.sees(*texts):
            raise Broken
        return self.token()

    def accept(self, *texts: str) -> Syn | None:
        return self.token() if self.sees(*texts) else None

    def leaf(self, kind: str) -> Syn:
        t = self.now
        self.at += 1
        return Syn(kind, t.start, t.end)

    def identifier(self, kind: str = "identifier") -> Syn:
        if self.now.kind != "name" or self.now.text in self.keywords:
            raise Broken
        return self.leaf(kind)

    def make(self, kind: str, *kids: Syn | None) -> Syn:
        present = [k for k in kids if k is not None]
        if not present:
            return Syn(kind, self.now.start, self.now.start)
        return Syn(kind, present[0].start, present[-1].end, kids=present)

    def listed(self, close: str, one, separator: str = ",") -> list[Syn]:
        """Items by ``one`` with separators, up to ``close``, which isn't taken."""
        found: list[Syn] = []
        while not self.sees(close):
            found.append(one())
            if not self.sees(close):
                found.append(self.take(separator))
        return found

    def binary(self, levels: list[dict[str, str]], operand, level: int = 0) -> Syn:
        """Operators of ``levels``, the loosest first, each with the kind of its node; all bind to the left."""
        if level == len(levels):
            return operand()
        left = self.binary(levels, operand, level + 1)
        while self.now.kind in ("sign", "name") and (kind := levels[level].get(self.now.text)):
            operator = self.token()
            right = self.binary(levels, operand, level + 1)
            left = self.make(kind, named("left", left), named("operator", operator), named("right", right))
        return left

    def tried(self, parse):
        """What ``parse`` reads, or None with nothing read."""
        at, depth = self.at, self.depth
        try:
            return parse()
        except Broken:
            self.at, self.depth = at, depth
            return None

    def deeper(self, parse):
        self.depth += 1
        if self.depth > DEEPEST:
            raise Broken
        found = parse()
        self.depth -= 1
        return found

    def recovered(self, parse, ends) -> Syn:
        """What ``parse`` reads, else an ERROR node of the tokens up to one for which ``ends`` holds outside brackets."""
        at, depth = self.at, self.depth
        try:
            return parse()
        except Broken:
            self.at, self.depth = at, depth
        kids, open_ = [], 0
        while self.now.kind != "end":
            if kids and not open_ and ends(self.now):
                break
            if self.sees("(", "[", "{"):
                open_ += 1
            elif self.sees(")", "]", "}"):
                if not open_ and kids:
                    break
                open_ = max(0, open_ - 1)
            t = self.now
            self.at += 1
            if t.kind in ("name", "number", "string") and t.text not in self.keywords:
                kids.append(Syn({"name": "identifier"}.get(t.kind, t.kind), t.start, t.end))
            elif t.end > t.start and t.text.strip():
                kids.append(Syn(t.text, t.start, t.end, named=False))
        return Syn("ERROR", kids[0].start if kids else self.tokens[at].start, kids[-1].end if kids else self.tokens[at].start, kids=kids)


def with_comments(root: Syn, comments: list[Syn]) -> Syn:
    """``root`` with each comment in the smallest node around it that has children."""
    for c in comments:
        node = root
        while True:
            at = bisect_right(node.kids, c.start, key=lambda k: k.start)
            if at and node.kids[at - 1].end >= c.end and node.kids[at - 1].kids:
                node = node.kids[at - 1]
                continue
            node.kids.insert(at, c)
            break
    return root
