"""Elias-Fano sequences and n-gram tries in memory-mapped files, for numpy.

A monotone sequence keeps the low bits of its values packed and the high parts in unary; a count of ones before every word
makes select a search and a few steps in one word. A trie has a level per order. The words below one node are a range of its
level; the values stored are words plus all that the ranges before have used up, so a level is one monotone sequence and a
word is found by searching the successor of the word shifted by its context's offset. Where ranges begin is a monotone
sequence too. Probabilities and back-off weights are 8-bit logarithms.
"""

from __future__ import annotations

import numpy as np

WORD = np.uint64(64)


def _select_table() -> np.ndarray:
    """The place of the r-th one in each byte."""
    table = np.zeros((256, 8), np.uint8)
    for b in range(256):
        for r, i in enumerate([i for i in range(8) if b >> i & 1]):
            table[b, r] = i
    return table


SELECT = _select_table()


def select_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th one (from 0) of each 64-bit word."""
    left, r = words, r.astype(np.uint8)
    at = np.zeros(len(words), np.uint8)
    for width in (32, 16, 8):
        low = np.bitwise_count(left & np.uint64((1 << width) - 1))
        up = r >= low
        r = r - low * up
        shift = up * np.uint8(width)
        left = left >> shift.astype(np.uint64)
        at += shift
    return (at + SELECT[(left & np.uint64(255)).astype(np.uint8), r]).astype(np.int64)


class EliasFano:
    """A sequence of values that never fall. Arrays may be memory-mapped."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.loads = np.ndarray((max(1, len(low) * 8 - 7),), np.uint64, low.data, strides=(1,))
        self.mask = np.uint64((1 << bits) - 1)

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        packed = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits:
            flat = packed.view(np.uint8)
            for at in range(0, n, 1 << 18):  # a multiple of 8, so that parts begin at a byte
                part = values[at : at + (1 << 18)]
                each = (part[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
                coded = np.packbits(each.ravel(), bitorder="little")
                flat[at * bits // 8 : at * bits // 8 + len(coded)] = coded
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)) if n < 1 << 12 else _set_bits(high, place)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]]).astype(np.uint32)
        return EliasFano(n, bits, packed, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.bits
        first = self.loads[bit >> 3] >> (bit & 7).astype(np.uint64)
        return first & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1
        place = (word << 6) + select_in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _zeros_to(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``h``: ones before the h-th zero."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if not hasattr(self, "_zeros") else self._zeros
        self._zeros = zeros
        h = np.minimum(h, int(self.high.size * 64 - self.n))
        word = np.searchsorted(zeros, np.maximum(h - 1, 0), "right") - 1
        place = (word << 6) + select_in_word(~self.high[word], np.maximum(h - 1, 0) - zeros[word])
        return np.where(h > 0, place - (h - 1), 0)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is at least ``x``; n if there is none."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is ``x``; n if it isn't there. The successor's high part is known from the search."""
        place, end = self._search(x)
        at = np.flatnonzero(place < end)
        hit = self._low(place[at]) == x[at] & self.mask
        out = np.full(len(x), self.n, np.int64)
        out[at[hit]] = place[at[hit]]
        return out

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successors, and the ends of the runs of values that share the high part of ``x``."""
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        most = self.high.size * 64 - self.n - 1
        inside = h < most
        h = np.minimum(h, most - 1)
        low, high = self._zeros_to(h), self._zeros_to(h + 1)
        end = np.where(inside, high, 0)
        want = x & self.mask
        active = np.flatnonzero(low < high)
        while len(active):
            a, b = low[active], high[active]
            middle = (a + b) >> 1
            less = self._low(middle) < want[active]
            low[active] = np.where(less, middle + 1, a)
            high[active] = np.where(less, b, middle)
            active = active[low[active] < high[active]]
        return np.where(inside, low, self.n), end


def _set_bits(high: np.ndarray, place: np.ndarray) -> None:
    """Sets increasing places."""
    for at in range(0, len(place), 1 << 20):
        part = place[at : at + (1 << 20)]
        first = int(part[0]) >> 6
        bits = np.zeros(((int(part[-1]) >> 6) - first + 1) * 64, np.uint8)
        bits[part - (first << 6)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        high[first : first + len(words)] |= words


#: Steps of the 8-bit logarithms, and the least that they are made.
LEAST_STEP = 0.02


def quantised(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Base-10 logarithms of probabilities in 8 bits, and their step. 0, of nodes that are contexts only, gets the last code."""
    some = p > 0
    logs = np.full(len(p), np.inf)
    logs[some] = -np.log10(p[some])
    step = max(LEAST_STEP, float(logs[some].max()) / 255 if some.any() else 0.0)
    return np.minimum(np.rint(logs / step), 255).astype(np.uint8), step


class Trie:
    """Nodes of order 1 are the first words; below them a level per order."""

    def __init__(self, roots: EliasFano, levels: list[dict]):
        self.roots, self.levels = roots, levels

    @staticmethod
    def build(roots: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]) -> Trie:
        """``roots``: sorted words. Per level: the node above of each gram (sorted), its word (rising below a node), its
        discounted probability, and the back-off weight as a context (None: no level follows)."""
        found, above = [], len(roots)
        for parent, word, p, weight in levels:
            counts = np.bincount(parent, minlength=above)
            starts = np.concatenate([[0], np.cumsum(counts)])
            filled = np.flatnonzero(counts)
            used = np.zeros(above, np.int64)
            used[filled] = word[starts[filled + 1] - 1] + 1
            offsets = np.concatenate([[0], np.cumsum(used)[:-1]])
            codes, step = quantised(p)
            level = {"starts": EliasFano.build(starts), "words": EliasFano.build(word + offsets[parent]), "p": codes, "p_step": step}
            if weight is not None:
                level["w"], level["w_step"] = quantised(weight)
            found.append(level)
            above = len(word)
        return Trie(EliasFano.build(roots), found)

    def root(self, words: np.ndarray) -> np.ndarray:
        """Nodes of first words; -1 where there is none."""
        if not self.roots.n:
            return np.full(len(words), -1)
        at = self.roots.find(words.astype(np.uint64))
        return np.where(at < self.roots.n, at, -1)

    def child(self, level: int, nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The node of ``words`` below ``nodes`` of the level above; -1 where there is none."""
        held = self.levels[level]
        out = np.full(len(nodes), -1, np.int64)
        at = np.flatnonzero(nodes >= 0)
        if not len(at) or not held["words"].n:
            return out
        above = nodes[at]
        if (above[1:] >= above[:-1]).all():  # sorted already
            first = np.concatenate([[True], above[1:] != above[:-1]])
            contexts, back = above[first], np.cumsum(first) - 1
        else:
            contexts, back = np.unique(above, return_inverse=True)
        begin, end = held["starts"].access(contexts).astype(np.int64), held["starts"].access(contexts + 1).astype(np.int64)
        before = np.zeros(len(contexts), np.uint64)
        some = np.flatnonzero((begin > 0) & (begin < end))
        before[some] = held["words"].access(begin[some] - 1) + np.uint64(1)
        at, back = at[(keep := (begin < end)[back])], back[keep]
        want = words[at].astype(np.uint64) + before[back]
        place = held["words"].find(want)
        ok = place < end[back]
        out[at[ok]] = place[ok]
        return out

    def p(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self._decoded(level, "p", nodes, 0.0)

    def weight(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self._decoded(level, "w", nodes, 1.0)

    def _decoded(self, level: int, name: str, nodes: np.ndarray, otherwise: float) -> np.ndarray:
        held = self.levels[level]
        out = np.full(len(nodes), otherwise)
        at = np.flatnonzero(nodes >= 0)
        out[at] = 10.0 ** (-held[f"{name}_step"] * np.arange(256))[held[name][nodes[at]]]
        return out

    def parts(self):
        """All arrays of the file, in order, with what rebuilds them."""
        sequences = [self.roots, *(level[k] for level in self.levels for k in ("starts", "words"))]
        for s in sequences:
            yield ("ef", s.n, s.bits, [s.low, s.high, s.ones])
        for level in self.levels:
            for k in ("p", "w"):
                if k in level:
                    yield (k, len(level[k]), level[f"{k}_step"], [level[k]])

    def to_bytes(self) -> bytes:
        """A header of 64-bit numbers and 8-byte aligned arrays."""
        body, head = [], []
        for kind, n, extra, arrays in self.parts():
            head += [{"ef": 0, "p": 1, "w": 2}[kind], n, int(np.float64(extra).view(np.int64)), len(arrays)]
            for a in arrays:
                raw = a.tobytes()
                body.append(raw.ljust(-(-len(raw) // 8) * 8, b"\0"))
                head += [{8: 0, 4: 1, 1: 2}[a.itemsize], len(a)]
        header = np.array([len(self.levels), len(head), *head], np.int64)
        return header.tobytes() + b"".join(body)

    @staticmethod
    def from_buffer(raw: np.ndarray) -> Trie:
        """A trie over a buffer of bytes, such as a memory map, without copies."""
        n_levels, n_head = raw[:16].view(np.int64).tolist()
        head = raw[16 : 16 + 8 * n_head].view(np.int64).tolist()
        at, place, entries = 0, 16 + 8 * n_head, []
        while at < n_head:
            kind, n, extra, count = head[at : at + 4]
            at += 4
            arrays = []
            for _ in range(count):
                dtype, size = (np.uint64, np.uint32, np.uint8)[head[at]], head[at + 1]
                nbytes = size * np.dtype(dtype).itemsize
                arrays.append(raw[place : place + nbytes].view(dtype))
                place += -(-nbytes // 8) * 8
                at += 2
            entries.append((kind, n, float(np.int64(extra).view(np.float64)), arrays))
        sequences = [EliasFano(n, int(x), *arrays) for kind, n, x, arrays in entries if kind == 0]
        levels = [{"starts": sequences[1 + 2 * i], "words": sequences[2 + 2 * i]} for i in range(n_levels)]
        i = -1
        for kind, _, x, (array, *_rest) in entries:
            if kind == 1:
                i += 1
                levels[i] |= {"p": array, "p_step": x}
            elif kind == 2:
                levels[i] |= {"w": array, "w_step": x}
        return Trie(sequences[0], levels)
