"""An n-gram language model over a whole corpus, in Elias-Fano tries that workers map into memory.

Words are numbered by the order of their 64-bit hashes, and each has a second hash of 64 bits: where two words of a corpus meet
in the first one, all are hashed again from another seed, and a word that was not learned is known by its second hash. Counts are made in two passes: words, then n-grams of every order up
to ``order``, counted per block of text and dealt to shards by their first two words. A task per shard adds the counts up and
writes one trie. Probabilities are hierarchical Dirichlet estimates,

    p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K),    h' being h without its first word, K a parameter per order,

kept as the 8-bit logarithms of c(h w) / (c(h) + K) at the gram and of K / (c(h) + K) at its context. The lowest order is
(c(w) + 1) / (N + V + 1), which leaves a share for a word that was never seen. A text is preceded by ``order`` - 1 marks of its
begin and followed by one end, which is a token.

Vocabulary and tries are files in the shared folder. No task and no driver holds the model: a shard's counts are bounded by
TOKENS_PER_SHARD on average, whatever one word's share of the text, and scoring touches the pages that its lookups need.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import scratch, shared_dir, small_batches, stored, utf8
from .trie import Trie

ORDER = 3
#: K per order from 2 on.
MASS = (3000.0, 15.0)
TOKENS_PER_SHARD = 1_000_000
WORDS_PER_SHARD = 2_000_000
#: Files that a worker keeps: mapped ones, and those that it had to read.
KEPT_FILES = (4096, 16)
#: Tokens that a task counts or scores at a time.
BLOCK = 600_000
#: The hash of an end: that of no bytes.
END = 0


#: Bytes whose words are hashed at a time, and the bytes that part words.
CHUNK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Longer words are hashed one by one: polynomials modulo a power of two meet for some long words, whatever the base.
LONG = 64
SEEDS = 8


@lru_cache(maxsize=4)
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A base ** i and its inverse, modulo 2 ** 64, for i below n."""
    base = xxhash.xxh64_intdigest(b"base", seed) | 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hashed:
    """The tokens of some texts: ``whole`` has 64-bit hashes of all words between ASCII white space, A-Z lower-cased, each
    text's end as END; ``sizes`` the tokens per text.

    A word's hash is a polynomial of its bytes, taken from running sums, so no word becomes an object.
    """

    def __init__(self, texts: list[bytes], seed: int):
        self.bytes = b"\n".join(texts).lower() + b"\n"
        data = np.frombuffer(self.bytes, np.uint8)
        space = SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.end = start, end = edges[0::2], edges[1::2]
        out = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            last = max(at + 1, int(np.searchsorted(start, start[at] + CHUNK)))
            first, stop = int(start[at]), int(end[last - 1])
            size = stop - first
            up, down = _powers(1 << max(20, size.bit_length()), seed)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((data[first:stop].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
            s, e = start[at:last] - first, end[at:last] - first
            out[at:last] = (sums[e] - sums[s]) * down[s]
            at = last
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        for i in np.flatnonzero(end - start > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.bytes[start[i] : end[i]], seed)
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        words = np.diff(np.searchsorted(start, bounds), prepend=0)
        if len(texts):
            words[0] = int(np.searchsorted(start, bounds[0]))
        self.sizes = words + 1
        self.whole = np.full(int(self.sizes.sum()), END, np.uint64)
        self.ends = np.cumsum(self.sizes) - 1
        keep = np.ones(len(self.whole), bool)
        keep[self.ends] = False
        self.whole[keep] = out

    def distinct(self, inverse: bool = False, counts: bool = False) -> tuple[np.ndarray, ...]:
        """Distinct hashes, the second hash of a word with each, and what np.unique gives besides."""
        found, first, *more = np.unique(self.whole, return_index=True, return_inverse=inverse, return_counts=counts)
        checks, digest, data = np.zeros(len(found), np.uint64), xxhash.xxh64_intdigest, self.bytes
        words = first - np.searchsorted(self.ends, first)
        is_word = np.flatnonzero(self.ends[np.minimum(np.searchsorted(self.ends, first), len(self.ends) - 1)] != first)
        places = words[is_word]
        checks[is_word] = np.fromiter((digest(data[a:b], 0) for a, b in zip(self.start[places].tolist(), self.end[places].tolist(), strict=True)), np.uint64, len(places))
        return found, checks, *more


def write_file(uri: str, data: bytes) -> None:
    """Writes a file of the shared folder whole: a task that runs twice leaves one."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def read_file(uri: str) -> np.ndarray:
    """The bytes of a file: mapped where the folder is a local path, else read."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def _read_trie(uri: str) -> Trie | None:
    try:
        return Trie.from_buffer(read_file(uri))
    except FileNotFoundError:
        return None


def _read_words(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = read_file(uri).reshape(3, -1)
    return raw[0].view(np.uint64), raw[1].view(np.uint64), raw[2].view(np.int64)


_TRIES = [lru_cache(n)(_read_trie) for n in KEPT_FILES]
_WORDS = [lru_cache(n)(_read_words) for n in KEPT_FILES]


def _is_mapped(uri: str) -> bool:
    return uri.startswith(("file:", "/"))


def load_trie(uri: str) -> Trie | None:
    """None where no gram fell to the shard."""
    return _TRIES[0 if _is_mapped(uri) else 1](uri)


def load_words(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, second hashes and counts."""
    return _WORDS[0 if _is_mapped(uri) else 1](uri)


@dataclass
class Vocabulary:
    """Hashes of the words that occur, in order, and their counts; a file for each range of hashes."""

    folder: str
    bits: int
    bases: list[int]
    tokens: int
    distinct: int
    seed: int = 0

    def lookup(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of words by both of their hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        cuts = np.searchsorted(hashes[order], np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else []
        for shard, at in enumerate(np.split(order, cuts)):
            if not len(at) or self.bases[shard] == self.bases[shard + 1]:
                continue
            known, second, count = load_words(f"{self.folder}/words-{shard}")
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            ok = (known[place] == hashes[at]) & (second[place] == checks[at])
            ids[at[ok]] = place[ok] + self.bases[shard]
            counts[at[ok]] = count[place[ok]]
        return ids, counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and counts of all tokens, the end of each text included, and the number of tokens of each text."""
        found = Hashed(texts, self.seed)
        distinct, checks, back = found.distinct(inverse=True)
        ids, counts = self.lookup(distinct, checks)
        return ids[back], counts[back], found.sizes


def _blocks(batches: Iterator[pa.RecordBatch], column: int, tokens: int) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of about so many tokens, guessed from bytes."""
    ids, texts, held = [], [], 0
    for batch in small_batches(batches):
        for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(column)), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t) // 6 + 1
            if held >= tokens:
                yield ids, texts
                ids, texts, held = [], [], 0
    if texts:
        yield ids, texts


def _words(texts: DataFrame, seed: int) -> DataFrame:
    """(h, c, g, g2): words by their hash under a seed with counts, and the least and the greatest second hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, 1, BLOCK):
            found, checks, counts = Hashed(block, seed).distinct(counts=True)
            columns = [found.view(np.int64), counts, checks.view(np.int64)]
            for at in range(0, len(found), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)]) for c in columns], ["h", "c", "g"])

    return stored(texts.mapInArrow(count, "h long, c long, g long").groupBy("h").agg(F.sum("c").alias("c"), F.min("g").alias("g"), F.max("g").alias("g2")), "words")


def _vocabulary(texts: DataFrame, folder: str) -> Vocabulary:
    """``texts`` (id, text) to a vocabulary of its words and ends."""
    for seed in range(SEEDS):
        words = _words(texts, seed)
        total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("g") != F.col("g2"), 1)).alias("met")).first()
        if not total["met"]:
            break
    else:
        raise RuntimeError(f"different words have one hash under each of {SEEDS} seeds")
    bits = max(0, (total["v"] // WORDS_PER_SHARD).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            shards, *columns = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            for s in np.unique(shards).tolist():
                held.setdefault(s, []).append([x[shards == s] for x in columns])
        for s, parts in held.items():
            h, g, c = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))
            order = np.argsort(h.view(np.uint64))
            write_file(f"{folder}/words-{s}", b"".join(x[order].tobytes() for x in (h, g, c)))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(h)], pa.int64())], ["shard", "n"])

    sizes = {r["shard"]: r["n"] for r in words.select(shard.alias("shard"), "h", "g", "c").repartition(1 << bits, "shard").mapInArrow(write, "shard int, n long").collect()}
    bases = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(1 << bits)])]).tolist()
    return Vocabulary(folder, bits, bases, total["n"], total["v"], seed)


def shard_of(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % shards


def _counted(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each occurs. Numbers are below 2 ** 31; a pair is sorted as one."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    heads: list[np.ndarray] = []  # what the upper half of a key stands for
    key = rows[:, 0] << 32 | rows[:, 1]
    for i in range(2, rows.shape[1]):
        head, rank = np.unique(key, return_inverse=True)
        heads.append(head)
        key = rank << 32 | rows[:, i]
    if counts is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, counts = key[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.diff(np.append(first, len(key))) if counts is None else np.add.reduceat(counts, first)
    key, columns = key[first], []
    for head in [*reversed(heads), None]:
        columns.append(key & 0xFFFFFFFF)
        key = key >> 32 if head is None else head[key >> 32]
    return np.ascontiguousarray(np.column_stack([key, *reversed(columns)])), sums.astype(np.int64)


def _pack(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted rows and counts, compressed by column; the first word as differences."""
    columns = [np.diff(rows[:, 0], prepend=0), *(rows[:, i] for i in range(1, rows.shape[1])), counts]
    raw = b"".join(np.ascontiguousarray(c.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    columns = raw.reshape(width + 1, 4, -1).transpose(0, 2, 1).copy().view("<u4")[:, :, 0].astype(np.int64)
    columns[0] = np.cumsum(columns[0])
    return np.ascontiguousarray(columns[:width].T), columns[width]


def _grams(ids: np.ndarray, sizes: np.ndarray, order: int, begin: int) -> np.ndarray:
    """The ``order`` words that end at each token, begins before the first token of a text."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.empty((len(ids), order), np.int64)
    for back in range(order):
        shifted = np.roll(ids, back)
        out[:, order - 1 - back] = np.where(place >= back, shifted, begin) if back else ids
    return out


def _build(blobs: dict[int, list[bytes]], order: int, mass: tuple[float, ...], total_of) -> Trie:
    """The trie of a shard from the packed counts of each order."""
    grams = {}
    for n in range(2, order + 1):
        parts = [_unpack(b, n) for b in blobs.get(n, [])]
        rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, n), np.int64)
        grams[n] = _counted(rows, np.concatenate([p[1] for p in parts]) if parts else None)
    # A context of begins only has no gram of its own: it's there for what follows it.
    for n in range(order, 2, -1):
        need = _heads(grams[n][0])[0]
        low, low_counts = grams[n - 1]
        grams[n - 1] = _counted(np.concatenate([low, need]), np.concatenate([low_counts, np.zeros(len(need), np.int64)]))
    roots = np.unique(grams[2][0][:, 0])
    levels, index = [], None
    for n in range(2, order + 1):
        rows, counts = grams[n]
        if n == 2:
            parent = np.searchsorted(roots, rows[:, 0])
            above = total_of(roots)
        else:
            heads, of = _heads(rows)
            parent = _rows_in(grams[n - 1][0], heads)[of]
            above = np.bincount(parent, counts, len(grams[n - 1][0]))
            k = mass[n - 2]
            levels[-1][3] = k / (above + k)
        k = mass[n - 2]
        levels.append([parent, rows[:, -1], counts / (above[parent] + k), None])
    return Trie.build(roots, [tuple(x) for x in levels])


def _heads(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct beginnings of sorted rows without their last word, and the one of each row."""
    if not len(rows):
        return rows[:, :-1], np.zeros(0, np.int64)
    changes = np.concatenate([[True], (np.diff(rows[:, :-1], axis=0) != 0).any(axis=1)])
    return rows[changes][:, :-1], np.cumsum(changes) - 1


def _rows_in(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of sorted distinct ``wanted`` rows in sorted distinct ``rows``; all are there."""
    both = np.concatenate([rows, wanted])
    order = np.lexsort(both.T[::-1])  # stable: a row comes before its equal in ``wanted``
    is_row = order < len(rows)
    places = np.cumsum(is_row) - 1
    out = np.empty(len(wanted), np.int64)
    out[order[~is_row] - len(rows)] = places[~is_row]
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    folder: str
    order: int
    mass: tuple[float, ...]
    shards: int
    ends: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.vocabulary.tokens + self.vocabulary.distinct + 1)

    def probabilities(self, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each token after those before it."""
        p = self.base(counts)
        begin = self.vocabulary.distinct
        grams = _grams(ids, sizes, 2, begin)
        pair, back = np.unique(np.where((grams < 0).any(axis=1), -1, grams[:, 0] << 32 | grams[:, 1] & 0xFFFFFFFF), return_inverse=True)
        a, b = pair >> 32, pair & 0xFFFFFFFF
        shard = np.where(pair >= 0, shard_of(a, b, self.shards), -1)
        node = np.full(len(pair), -1, np.int64)
        alpha = np.zeros(len(pair))
        for _, trie, at in self._by_shard(shard):
            node[at] = trie.child(0, trie.root(a[at]), b[at])
            alpha[at] = trie.p(0, node[at])
        before = np.roll(counts, 1)
        first = np.zeros(len(ids), bool)
        first[np.cumsum(sizes) - sizes] = True
        before[first] = self.ends
        k = self.mass[0]
        p = alpha[back] + k / (before + k) * p
        node, shard = node[back], np.where(node >= 0, shard, -1)[back]
        for n in range(3, self.order + 1):
            # Contexts are the nodes of the words before; a text's begin has contexts of begins alone.
            above, of = np.roll(node, 1), np.roll(shard, 1)
            of[first], above[first] = self._begin_node(n - 1)
            node, shard = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
            alpha, weight = np.zeros(len(ids)), np.ones(len(ids))
            for s, trie, at in self._by_shard(np.where(above >= 0, of, -1)):
                at = at[np.argsort(above[at])]  # neighbours in the trie are looked up together
                up = above[at]
                node[at] = found = trie.child(n - 2, np.where(ids[at] >= 0, up, -1), ids[at])
                shard[at] = s
                alpha[at] = trie.p(n - 2, found)
                weight[at] = trie.weight(n - 3, up)
            shard[node < 0] = -1
            p = alpha + weight * p
        return np.minimum(p, 1.0)

    def _begin_node(self, n: int) -> tuple[int, int]:
        """Shard and node of n begins; a single begin is a first word and has none."""
        begin = np.array([self.vocabulary.distinct])
        s = int(shard_of(begin, begin, self.shards)[0])
        trie = load_trie(f"{self.folder}/trie-{s}")
        if trie is None:
            return -1, -1
        node = trie.root(begin)
        for level in range(n - 1):
            node = trie.child(level, node, begin)
        return (s, int(node[0])) if node[0] >= 0 else (-1, -1)

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, Trie, np.ndarray]]:
        """Shards that occur and have grams, their tries, and where they occur."""
        if self.shards < 1 << 15:
            shard = shard.astype(np.int16)  # sorted by digits
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            s = int(shard[at[0]])
            if s >= 0 and (trie := load_trie(f"{self.folder}/trie-{s}")) is not None:
                yield s, trie, at

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base-10 logarithms of the base's and the model's probability."""
        ids, counts, sizes = self.vocabulary.encode(texts)
        if not len(texts):
            return sizes, sizes, np.zeros(0), np.zeros(0)
        starts = np.cumsum(sizes) - sizes
        p = self.probabilities(ids, counts, sizes)
        return sizes, np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(np.log10(self.base(counts)), starts), np.add.reduceat(np.log10(p), starts)


def train(df: DataFrame, text_col: str, learn: Column | None = None, order: int = ORDER, mass: tuple[float, ...] = MASS) -> Model:
    """A model of all texts of ``df`` for which ``learn`` holds (null doesn't). Null texts are empty and count their end."""
    if not 2 <= order <= len(mass) + 1:
        raise ValueError("mass must have a number for every order from 2 on")
    mass = tuple(mass[: order - 1])
    texts = (df if learn is None else df.where(learn)).select(F.lit(0).alias("id"), df[text_col].cast("string").alias("text"))
    folder = f"{shared_dir(df.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    with scratch(df.sparkSession):
        vocabulary = _vocabulary(texts, folder)
    if vocabulary.distinct >= 1 << 31:
        raise ValueError("the vocabulary has more words than the tries' keys hold")
    shards = max(1, -(-vocabulary.tokens // TOKENS_PER_SHARD))
    _, (ends,) = vocabulary.lookup(np.array([END], np.uint64), np.zeros(1, np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, 1, BLOCK):
            ids, _, sizes = vocabulary.encode(block)
            grams = _grams(ids, sizes, order, vocabulary.distinct)
            for n in range(2, order + 1):
                rows, counts = _counted(grams[:, order - n :])
                of = shard_of(rows[:, 0], rows[:, 1], shards)
                by = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.diff(of[by])) + 1
                found = [(int(of[at[0]]), n, _pack(rows[at], counts[at])) for at in np.split(by, cuts)]
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["shard", "n", "grams"])

    def total_of(roots: np.ndarray) -> np.ndarray:
        """How often each word is a context: as often as it occurs, a begin once a text."""
        out = np.full(len(roots), ends, np.int64)
        known = roots < vocabulary.distinct
        bases = np.array(vocabulary.bases)
        of = np.searchsorted(bases, roots[known], "right") - 1
        values = np.zeros(len(of), np.int64)
        for s in np.unique(of).tolist():
            values[of == s] = load_words(f"{folder}/words-{s}")[2][roots[known][of == s] - bases[s]]
        out[known] = values
        return out

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        at = None

        def written() -> pa.RecordBatch:
            data = _build(blobs, order, mass, total_of).to_bytes()
            write_file(f"{folder}/trie-{at}", data)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(data)], pa.int64())], ["shard", "n"])

        for batch in batches:
            for s, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and s != at:
                    yield written()
                    blobs.clear()
                at = s
                blobs.setdefault(n, []).append(data)
        if at is not None:
            yield written()

    partitions = min(shards, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    dealt = texts.mapInArrow(count, "shard int, n int, grams binary").repartition(partitions, "shard").sortWithinPartitions("shard")
    dealt.mapInArrow(build, "shard int, n long").agg(F.sum("n")).first()  # writes the tries; nothing of them comes to the driver
    return Model(vocabulary, folder, order, mass, shards, int(ends))


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score): one row per row of ``df``. Null texts are empty: their end is scored."""
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches, 1, BLOCK):
            found = model.score(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(x) for x in found)], ["id", "n_tokens", "n_known", "base_score", "score"])

    id_type = pa.int64() if rows.schema["id"].dataType.simpleString() == "bigint" else pa.string()
    if id_type == pa.string():
        rows = rows.withColumn("id", F.col("id").cast("string"))
    kind = "long" if id_type == pa.int64() else "string"
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
