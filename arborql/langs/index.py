"""A syntax tree as its matcher sees it: nodes in pre-order, byte offsets, and what is looked up of a node, made when asked for."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from itertools import accumulate
from typing import TYPE_CHECKING

from .tree import KINDS, SIGNS, Sign, Syn, Tape, taped

if TYPE_CHECKING:
    from . import Language

#: Trees of up to so many nodes keep all that was looked up of them; in larger ones only nodes with more than BROAD below them do.
SMALL, BROAD = 4096, 64


class _Signs(dict):
    """What holds for the nodes of a sign, by its number."""

    def __init__(self, of: Callable[[Sign], bool]):
        self.of = of

    def __missing__(self, n: int) -> bool:
        found = self[n] = self.of(SIGNS[n])
        return found


#: By language, the signs that patterns look at, and the named ones.
_SEEN: dict[str, tuple[_Signs, _Signs]] = {}


def _seen(lang: Language) -> tuple[_Signs, _Signs]:
    if lang.name not in _SEEN:
        seen = lambda x: not (x.extra or x.missing or x.kind in lang.comments)
        _SEEN[lang.name] = _Signs(lambda x: seen(x) and x.kind not in lang.separators), _Signs(lambda x: seen(x) and x.named)
    return _SEEN[lang.name]


class Tree:
    """Nodes are numbers, and what they are is in arrays. ``nodes[i]``: the number of i's sign; ``stop[i]``: the first node after
    i's subtree. Only the source is held, never a node's text, and what can be looked up quickly again isn't held for each node."""

    def __init__(self, root: Syn | Tape, source: str, lang: Language):
        tape = root if isinstance(root, Tape) else taped(root)
        self.lang, self.source = lang, source
        self.nodes, self.starts, self.ends, self.parent, self.stop = tape.signs, tape.start, tape.end, tape.parent, tape.stop
        self.small = len(self.nodes) <= SMALL
        self._is_relevant, self._is_named = _seen(lang)
        self._relevant: dict[int, Sequence[int]] = {}
        self._named: dict[int, Sequence[int]] = {}
        self._core: dict[int, int] = {}
        self._of_kind: dict[str, Sequence[int]] = {}

    def sign(self, i: int) -> Sign:
        return SIGNS[self.nodes[i]]

    def kind(self, i: int) -> str:
        return KINDS[self.nodes[i]]

    def holds(self, i: int) -> bool:
        """Whether what is looked up of a node is kept."""
        return self.small or self.stop[i] - i > BROAD

    def children(self, i: int, after: int | None = None) -> Iterator[int]:
        """The children of a node, those after one of them if that's given."""
        stop, end = self.stop, self.stop[i]
        k = i + 1 if after is None else stop[after]
        while k < end:
            yield k
            k = stop[k]

    @cached_property
    def data(self) -> bytes:
        return self.source.encode("utf-8", "surrogatepass")

    @cached_property
    def _offset(self) -> array | None:
        """The byte of each character; None where they are the same."""
        if self.source.isascii():
            return None
        return array("i", accumulate((len(c.encode("utf-8", "surrogatepass")) for c in self.source), initial=0))

    def start(self, i: int) -> int:
        at = self.starts[i]
        return at if self._offset is None else self._offset[at]

    def end(self, i: int) -> int:
        at = self.ends[i]
        return at if self._offset is None else self._offset[at]

    def text(self, i: int) -> str:
        return self.source[self.starts[i] : self.ends[i]]

    def slice(self, start: int, end: int) -> str:
        """The text between two bytes."""
        return self.source[start:end] if self._offset is None else self.data[start:end].decode("utf-8", "replace")

    @cached_property
    def _lines(self) -> array:
        text, end = (self.source, "\n") if self._offset is None else (self.data, b"\n")
        found, at = array("i", [0]), text.find(end)
        while at >= 0:
            found.append(at + 1)
            at = text.find(end, at + 1)
        return found

    def place(self, byte: int) -> tuple[int, int]:
        """Row and column of a byte, both from 0."""
        row = bisect_right(self._lines, byte) - 1
        return row, byte - self._lines[row]

    @cached_property
    def _kinds(self) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for i, n in enumerate(self.nodes):
            found.setdefault(KINDS[n], []).append(i)
        return found

    def of_kind(self, kind: str) -> Sequence[int]:
        """The nodes of a kind, in order."""
        if self.small:
            return self._kinds.get(kind, ())
        found = self._of_kind.get(kind)
        if found is None:
            wanted = {n for n, k in enumerate(KINDS) if k == kind}
            found = self._of_kind[kind] = array("i", (i for i, n in enumerate(self.nodes) if n in wanted))
        return found

    def comment(self, i: int) -> bool:
        return KINDS[self.nodes[i]] in self.lang.comments

    def relevant(self, i: int) -> Sequence[int]:
        """The children that a pattern looks at."""
        found = self._relevant.get(i)
        if found is None:
            found, nodes, wanted = self._row(i), self.nodes, self._is_relevant
            found.extend([k for k in self.children(i) if wanted[nodes[k]]])
            if self.holds(i):
                self._relevant[i] = found
        return found

    def named(self, i: int) -> Sequence[int]:
        found = self._named.get(i)
        if found is None:
            found, nodes, wanted = self._row(i), self.nodes, self._is_named
            found.extend([k for k in self.children(i) if wanted[nodes[k]]])
            if self.holds(i):
                self._named[i] = found
        return found

    def _row(self, i: int) -> list[int] | array:
        return array("i") if self.stop[i] - i > SMALL else []

    def core(self, i: int) -> int:
        """The node that remains when wrappers around it are looked through."""
        found = self._core.get(i)
        if found is None:
            found, through = i, self.lang.through
            while KINDS[self.nodes[found]] in through and len(own := self.named(found)) == 1:
                found = own[0]
            if self.holds(i):
                self._core[i] = found
        return found

    def wrapped(self, i: int) -> list[int]:
        """The wrappers around a core and itself."""
        found = []
        while i >= 0 and self.core(i) == (found[0] if found else i):
            found.append(i)
            i = self.parent[i]
        return found

    def hole(self, i: int) -> str | None:
        """What stands between the tokens at a node's edges, if it has no other children."""
        if self.stop[i] == i + 1 or any(SIGNS[self.nodes[k]].named for k in self.children(i)):
            return None
        a, b, left = self.starts[i], self.ends[i], list(self.children(i))
        while left and self.starts[left[0]] == a:
            a = self.ends[left.pop(0)]
        while left and self.ends[left[-1]] == b:
            b = self.starts[left.pop()]
        return None if left or a > b else self.source[a:b]

    def _order(self, counts: Callable[[int], bool]) -> array:
        """By node, its place among those of its siblings that count, -1 for others."""
        parent, n = self.parent, len(self.nodes)
        found, seen = array("i", [-1]) * n, array("i", [0]) * n
        for i in range(1, n):
            if counts(self.nodes[i]):
                p = parent[i]
                found[i] = seen[p]
                seen[p] += 1
        return found

    @cached_property
    def rel_ord(self) -> array:
        return self._order(self._is_relevant.__getitem__)

    @cached_property
    def child_ord(self) -> array:
        return self._order(lambda n: True)

    @cached_property
    def named_ord(self) -> array:
        return self._order(self._is_named.__getitem__)

    def statement(self, i: int) -> int | None:
        """The node or the ancestor that stands in a block."""
        at = i
        while (p := self.parent[at]) >= 0:
            if KINDS[self.nodes[p]] in self.lang.blocks:
                return at
            at = p
        return None
