"""Packing token sequences into windows: best-fit decreasing on a segment tree over remaining capacities."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches

#: Splits text before byte-level merges (a fixed value of that vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A block of this many tokens is packed at a time: it bounds a task's memory.
BLOCK_TOKENS = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: its own if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a tokenizer file, the same as its own encoding of whole texts.

    If the file is a byte-level BPE whose ids are in the order of its merges, texts of ASCII, Latin and general punctuation
    (where the classes of characters are settled) go through the same merges by rank, several times faster. Those with
    other characters or with the name of an added token, and all texts under other files, are encoded by the file itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = regex.compile(r"[\x00-\u024f\u2010-\u2027]*").fullmatch
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._by_rank(path)

    def _by_rank(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if model.get("type") != "BPE" or not byte_level or file.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            return None
        vocab, letters = model["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [vocab.get(a + b, -1) for a, b in pairs]
        if merged != list(range(256, 256 + len(merged))) or any(c not in vocab for c in letters):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        return tiktoken.Encoding("merges", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.ranked and (text.isascii() or self.plain(text)) and not any(x in text for x in self.added):
            return np.array(self.ranked(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


class OpenWindows:
    """Windows by what they can still take; a segment tree over capacities finds the tightest that fits."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, window: int, room: int) -> None:
        self.stacks[room].append(window)
        at = self.leaves + room
        while at:
            self.any[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and its room; it's no longer open."""
        any_, at = self.any, self.leaves + need
        if not any_[at]:
            while at > 1 and (at & 1 or not any_[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if any_[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            any_[at] -= 1
            at >>= 1
        return self.stacks[room].pop(), room


def best_fit(lengths: list[int], size: int) -> tuple[list[tuple[int, int]], int]:
    """Window and offset of each length (none over ``size``), taken longest first; the number of windows."""
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    windows, open_ = 0, OpenWindows(size)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = open_.take(n)
        if found is None:
            found, windows = (windows, size), windows + 1
        window, room = found
        places[i] = (window, size - room)
        if room > n:
            open_.add(window, room - n)
    return places, windows


def pack(df: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int = 1024, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece; ids are little-endian 32-bit.

    Each text's ids and ``end_id`` are cut into full windows and a rest; the rests of a block of about ``block_tokens``
    tokens are packed by best-fit decreasing. Blocks are those of a task's rows, so nothing is shuffled, a block has one
    poorly filled window at most in practice, and sequence ids (task, then order) are unique. Null and empty texts are
    their end id. ``tokenizer`` is a path that every executor can read. Rows may repeat; no rows give no pieces.
    """
    chosen = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        sequence, block, held = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows, rests = [], []
            for i, ids in block:
                n = len(ids) // 4
                whole = n // size * size
                for at in range(0, whole, size):
                    rows.append((i, at, size, ids[4 * at : 4 * (at + size)], n, sequence, 0))
                    sequence += 1
                if whole < n:
                    rests.append((i, whole, n - whole, ids))
            places, n = best_fit([length for _, _, length, _ in rests], size)
            for (i, at, length, ids), (window, offset) in zip(rests, places, strict=True):
                rows.append((i, at, length, ids[4 * at :], len(ids) // 4, sequence + window, offset))
            sequence += n
            block.clear()
            for at in range(0, len(rows), 4096):
                some = list(zip(*rows[at : at + 4096], strict=True))
                types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, types, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in small_batches(batches):
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.append((i, encode(text or "") + end))
                held += len(block[-1][1]) // 4
                if held >= block_tokens:
                    yield from packed()
                    held = 0
        if block:
            yield from packed()

    return chosen.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def padding(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """(windows, tokens, padding): a window is padded to ``size`` unless its length is a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return filled.agg(F.count("*").alias("windows"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(size - F.col("n"))).alias("padding"))
