"""Exact removal of long repeated byte strings, by prefix-free parsing with windows of a fixed length.

Parsing. A rolling hash of every GRAM bytes is taken; a position triggers where its hash is the least (the first of equals)
of those that begin in some window of SPREAD positions. For every start s of a string of ``length`` bytes the trigger of the
window at s lies inside the string, so equal strings have their triggers at equal places. The starts with the same trigger
are one range, and the text from the first of them to the last one's end is a phrase: phrases overlap by ``length`` bytes, so
each string of that length is in exactly one phrase of the parse, and no phrase is the proper beginning of another.

Dictionary and parse. The parse is a table of phrase occurrences, the dictionary its distinct phrases with their counts.
Strings of a phrase that occurs twice are repeated. Other repeats lie in different phrases with the same GRAM bytes at the
trigger; such a group is put into corpus order, as suffix arrays of a dictionary and a parse combine: every start is the
dictionary suffix before the trigger followed by the continuation after it. Continuations are sorted once and suffixes (read
from the trigger to the left) once; among the phrases that share a suffix, neighbours in the continuations' order have the
longest common prefix, so a start repeats if suffix and common prefix together have ``length`` bytes.

Only counts, trigger hashes and phrases of groups are shuffled, never pairs; texts move only for the documents that have
such phrases or lose bytes. A group of more than MOST_PHRASES different phrases is not gathered: the digests of its single
strings are counted instead, which is the same answer from more rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept, scratch, small_batches, stored, utf8

LENGTH = 400
SPREAD = 256
MOST_PHRASES = 40_000
CHUNK_PHRASES = 4096
#: Keys of documents (16 bytes each) up to this many are broadcast to keep other texts in place; beyond it texts are joined.
BROADCAST_KEYS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 18
#: Bytes that stand for a word, and what words are: as bytes.split() has them.
CODE = 8
WORD = re.compile(rb"[^ \t\n\r\x0b\f]+")
RANGES = "array<struct<first:int,last:int>>"
RANGE = pa.struct([("first", pa.int32()), ("last", pa.int32())])


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i below n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """A polynomial hash modulo 2 ** 64 of every ``gram`` bytes."""
    n = len(data) - gram + 1
    out = np.empty(max(0, n), np.uint64)
    up, down = _powers(BLOCK + gram)
    for at in range(0, n, BLOCK):
        part = data[at : at + BLOCK + gram - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        m = len(part) - gram + 1
        out[at : at + m] = (sums[gram:] - sums[:m]) * down[:m]
    return out


def parse(text: bytes, length: int = LENGTH, spread: int = SPREAD, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start, trigger and trigger hash of each phrase of a text; with a ``unit`` of CODE, strings start at
    codes only. All places and lengths are in bytes."""
    data = np.frombuffer(text, np.uint8 if unit == 1 else "<u8")
    length, spread = length // unit, spread // unit
    gram = length - spread + 1
    starts = len(data) - length + 1
    if starts < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = rolling(data, gram)
    mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
    low = ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= spread:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < spread:
        low = np.minimum(low[: len(low) - (spread - width)], low[spread - width :])
    trigger = (low[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    last = np.concatenate([first[1:], [starts]]) - 1
    at = trigger[first]
    return first * unit, last * unit, at * unit, hashes[at]


def _phrases(df: DataFrame, length: int, spread: int, coded: bool) -> DataFrame:
    """The parse: a row for each different phrase of a text (``coded``: of its words' codes), with its digest, its first place
    and trigger, how often it occurs there, and if that's more than once the starts of all of its places, those that touch in
    one range. So a run that repeats itself is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, unit = xxhash.xxh3_128_intdigest, CODE if coded else 1
        for batch in small_batches(batches):
            rows = []
            for da, db, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                text = word_codes(text) if coded else text
                first, last, at, h = parse(text, length, spread, unit)
                view = memoryview(text)
                own: dict[int, list] = {}
                for a, b, t, g in zip(first.tolist(), last.tolist(), at.tolist(), h.view(np.int64).tolist(), strict=True):
                    d = digest(view[a : b + length], t - a)
                    row = own.get(d)
                    if row is None:
                        own[d] = [g, *struct.unpack("<qq", d.to_bytes(16, "little")), da, db, a, b, t, 1, [(a, b)]]
                    else:
                        row[8] += 1
                        if row[9][-1][1] == a - unit:
                            row[9][-1] = (row[9][-1][0], b)
                        else:
                            row[9].append((a, b))
                rows += own.values()
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.int64()]
                several = [None if n == 1 else [{"first": a, "last": b} for a, b in x] for n, x in zip(columns[8], columns[9], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:9], types, strict=True)), pa.array(several, pa.list_(RANGE))], ["h", "k1", "k2", "da", "db", "first", "last", "at", "n", "several"])

    return df.mapInArrow(run, f"h long, k1 long, k2 long, da long, db long, first int, last int, at int, n long, several {RANGES}")


def common_prefix(a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of ``a`` and the next, within their sizes."""
    if len(a) < 2:
        return np.zeros(0, np.int64)
    differ = a[:-1] != a[1:]
    where = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(where, np.minimum(sizes[:-1], sizes[1:]))


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def repeated_in_groups(groups: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each phrase of some groups, the ranges of e for which its string from e bytes before the trigger is in another too.

    ``left`` is read from the trigger to the left; phrases of a group are different and share a trigger hash.
    """
    n = len(left)
    sizes_l, sizes_r = np.fromiter(map(len, left), np.int64, n), np.fromiter(map(len, right), np.int64, n)
    by_left = np.array(sorted(range(n), key=lambda i: (groups[i], left[i])), np.int64)
    by_right = np.array(sorted(range(n), key=lambda i: (groups[i], right[i])), np.int64)
    width_l, width_r = max(1, int(sizes_l.max())), int(sizes_r.max())
    same = groups[by_left][1:] == groups[by_left][:-1]
    suffix = np.where(same, common_prefix(_matrix([left[i] for i in by_left], width_l), sizes_l[by_left]), -1)
    same = groups[by_right][1:] == groups[by_right][:-1]
    prefix = np.where(same, common_prefix(_matrix([right[i] for i in by_right], width_r), sizes_r[by_right]), -1)
    prefix = np.append(prefix, -1)
    rank = np.empty(n, np.int64)
    rank[by_right] = np.arange(n)
    least, found = length - sizes_r, [[] for _ in range(n)]
    levels = sorted({int(x) for x in suffix if x >= 0} | {0})
    for level, below in zip(reversed(levels), [*reversed(levels[:-1]), -1], strict=True):
        kind = np.concatenate([[0], np.cumsum(suffix < level)])  # phrases that share ``level`` bytes before the trigger
        order = np.lexsort((rank[by_left], kind))
        who, kind = by_left[order], kind[order]
        pair = np.flatnonzero(kind[1:] == kind[:-1])
        if not len(pair):
            continue
        bounds = np.column_stack([rank[who[pair]], rank[who[pair + 1]]]).ravel()
        lcp = np.minimum.reduceat(prefix, bounds)[::2]
        best = np.full(n, -1, np.int64)
        np.maximum.at(best, who[pair], lcp)
        np.maximum.at(best, who[pair + 1], lcp)
        low = np.maximum(np.maximum(length - best, below + 1), least)
        high = np.minimum(level, sizes_l)
        for i in np.flatnonzero((best >= 0) & (low <= high)).tolist():
            found[i].append((int(low[i]), int(high[i])))
    return found


def _with_texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs`` (da, db, text, ...) joined to ``lists`` (da, db, ...), moving only texts that have a list where their keys are few."""
    keys = lists.select("da", "db")
    if keys.count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(keys), ["da", "db"], "left_semi")
    return docs.join(lists.hint("shuffle_merge"), ["da", "db"])


def _edges(docs: DataFrame, dictionary: DataFrame, length: int, coded: bool) -> DataFrame:
    """(da, db, ranges): starts of single phrases whose strings are in other phrases of their group."""
    lists = stored(dictionary.groupBy("da", "db").agg(F.collect_list(F.struct("h", "k1", "k2", "first", "last", "at", "n", "large")).alias("phrases")), "edge-lists", 8 * dictionary.count())
    joined = _with_texts(docs.select("da", "db", "text"), lists).select("da", "db", "text", "phrases")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for da, db, text, phrases in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                text = word_codes(text) if coded else text
                for p in phrases:
                    rows.append((p["h"], p["k1"], p["k2"], da, db, p["first"], p["at"], p["n"], p["large"], text[p["first"] : p["last"] + length]))
            for at in range(0, len(rows), 4096):
                some = list(zip(*rows[at : at + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(some, [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()], strict=True))], ["h", "k1", "k2", "da", "db", "first", "at", "n", "large", "phrase"])

    texts = joined.mapInArrow(cut, "h long, k1 long, k2 long, da long, db long, first int, at int, n long, large boolean, phrase binary")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solved() -> Iterator[pa.RecordBatch]:
            groups = np.array([r[0] for r in held], np.int64)
            offsets = [r[6] - r[5] for r in held]
            left = [r[8][:o][::-1] for r, o in zip(held, offsets, strict=True)]
            right = [r[8][o:] for r, o in zip(held, offsets, strict=True)]
            rows = [(r[3], r[4], [{"first": r[6] - high, "last": r[6] - low} for low, high in found]) for r, found in zip(held, repeated_in_groups(groups, left, right, length), strict=True) if r[7] == 1 and found]
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.list_(RANGE)], strict=True)], ["da", "db", "ranges"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] == row[:3]:
                    continue  # the same phrase from a repeated row
                if len(held) >= CHUNK_PHRASES and held[-1][0] != row[0]:
                    yield from solved()
                held.append(row)
        if held:
            yield from solved()

    grouped = texts.where("not large").drop("large").repartition("h").sortWithinPartitions("h", "k1", "k2")
    small = grouped.mapInArrow(order, f"da long, db long, ranges {RANGES}")
    large = dictionary.where("large")
    if large.isEmpty():
        return small

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 18):
            rows = []
            for da, db, first, phrase in zip(*(batch.column(c).to_pylist() for c in ("da", "db", "first", "phrase")), strict=True):
                for i in range(len(phrase) - length + 1):
                    d = xxhash.xxh3_128_intdigest(phrase[i : i + length])
                    rows.append((d - (1 << 127) & 0xFFFFFFFFFFFFFFFF, d >> 64, da, db, first + i))
            a = np.array([(x[0], x[1]) for x in rows], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, 0])), pa.array(np.ascontiguousarray(a[:, 1])), *(pa.array([r[i] for r in rows], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32())))], ["s1", "s2", "da", "db", "first"])

    strings = texts.where("large").dropDuplicates(["h", "k1", "k2"]).select("da", "db", "first", "phrase").mapInArrow(single, "s1 long, s2 long, da long, db long, first int")
    strings = stored(strings, "strings")
    several = strings.groupBy("s1", "s2").agg(F.count("*").alias("c")).where("c > 1")
    return small.unionByName(strings.join(several, ["s1", "s2"]).select("da", "db", F.array(F.struct("first", F.col("first").alias("last"))).alias("ranges")))


def repeated_starts(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, most_phrases: int = MOST_PHRASES, coded: bool = False) -> DataFrame:
    """(da, db, ranges): starts in ``docs`` (da, db, text) whose string of ``length`` bytes also starts elsewhere; ``coded``: in
    the texts' word codes."""
    occurrences = stored(_phrases(docs.select("da", "db", "text"), length, spread, coded), "parse")
    # Stored, so that the joins stand alone in their stages and hot hashes can be split there.
    most = occurrences.count()
    several = stored(occurrences.groupBy("h").agg(F.sum("n").alias("hn")).where("hn > 1").select("h"), "several", most)
    open_ = stored(occurrences.join(several, "h", "left_semi"), "open", most)
    most = open_.count()
    one = F.min(F.struct("da", "db", "first", "last", "at")).alias("one")
    counted = stored(open_.groupBy("h", "k1", "k2").agg(F.sum("n").alias("n"), one), "dictionary", most)
    within = counted.where("n > 1").select("h", "k1", "k2")
    inside = open_.join(within, ["h", "k1", "k2"], "left_semi").select("da", "db", F.coalesce("several", F.array(F.struct("first", "last"))).alias("ranges"))
    mixed = stored(counted.groupBy("h").agg(F.count("*").alias("phrases")).where("phrases > 1").withColumn("large", F.col("phrases") > most_phrases), "groups", most)
    dictionary = stored(counted.join(mixed, "h").select("h", "k1", "k2", "n", "large", "one.*"), "mixed", most)
    return inside.unionByName(_edges(docs, dictionary, length, coded))


def covered(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Bytes that strings from ranges of starts cover, as maximal runs."""
    runs: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"] + length) for r in ranges):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def word_codes(text: bytes) -> bytes:
    """CODE bytes for each word of a text, the XXH64 of its bytes, so that runs of words are strings of one length."""
    digest = xxhash.xxh64_digest
    return b"".join([digest(w, 42) for w in text.split()])


def passages(text: bytes, ranges: list[dict], words: int) -> list[dict]:
    """The bytes from the first word to the last one's end of runs of ``words`` words, from ranges of starts in their codes."""
    if not ranges:
        return []
    spans, found = [m.span() for m in WORD.finditer(text)], []
    for r in ranges:
        first, last = -(-r["first"] // CODE), r["last"] // CODE
        if first <= last:
            found.append({"first": spans[first][0], "last": spans[last + words - 1][1]})
    return found


def remove_repeats(df: DataFrame, text_col: str, length: int = LENGTH, spread: int = SPREAD, most_phrases: int = MOST_PHRASES, words: int = 0, give: tuple[str, ...] = ("kept", "removed")) -> DataFrame:
    """``df`` with the columns ``give``: kept (binary) and removed (array of byte ranges), the text's UTF-8 bytes without those
    that a string of ``length`` bytes covers which also starts anywhere else, in the same text or another; all judged on the
    input. clean (string): the text without those and without runs of ``words`` words (over 32) that also stand elsewhere, in
    whatever white space; characters that a cut halves go too.

    Null texts are empty. A repeated row repeats all of its strings. Columns named as in ``give`` are replaced, others stay;
    no rows give no rows. ``spread`` bounds how far triggers lie apart and is less than ``length``.
    """
    if not 0 < spread < length:
        raise ValueError("spread must be positive and less than length")
    fields = [c for c in df.columns if c not in give or c == text_col]
    text = df[text_col].cast("string")
    row = F.to_json(F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(fields) if c != text_col])) if len(fields) > 1 else F.lit("")
    docs = df.select(F.xxhash64(text, row).alias("da"), F.xxhash64(row, text, F.lit(1)).alias("db"), text.alias("text"), F.struct(*[df[c] for c in fields]).alias("row"))
    spark = df.sparkSession

    def found(coded: bool) -> DataFrame:
        with scratch(spark):
            starts = repeated_starts(docs, CODE * words if coded else length, SPREAD if coded else spread, most_phrases, coded)
            return kept(stored(starts, "starts"))

    none = F.array().cast(RANGES)
    with scratch(spark):
        starts = found(False).withColumn("runs", none)
        if words:
            starts = starts.unionByName(found(True).withColumnRenamed("ranges", "runs").withColumn("ranges", none))
        lists = kept(stored(starts.groupBy("da", "db").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("ranges", "runs"))), "ranges"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = {"kept": ("binary", pa.binary()), "removed": ("array<struct<start:long,end:long>>", span), "clean": ("string", pa.string())}

    def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
        ends = [0, *(b for _, b in runs)]
        return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(text)], strict=True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: dict[str, list] = {c: [] for c in kinds}
            for text, ranges, word_runs in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole = [{"first": r["first"], "last": r["last"] + length} for r in ranges or []]
                runs = covered(whole, 0)
                out["kept"].append(without(text, runs))
                out["removed"].append([{"start": a, "end": b} for a, b in runs])
                if "clean" in give:
                    out["clean"].append(without(text, covered(whole + passages(text, word_runs or [], words), 0)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(3), *(pa.array(out[c], kinds[c][1]) for c in give)], ["row", *give])

    schema = f"row {docs.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[c][0]}" for c in give)
    keys = lists.select("da", "db")
    if keys.count() > BROADCAST_KEYS:
        return docs.join(lists, ["da", "db"], "left").select("text", "ranges", "runs", "row").mapInArrow(cut, schema).select("row.*", *give)
    hit = docs.join(F.broadcast(keys), ["da", "db"], "left_semi").join(lists.hint("shuffle_merge"), ["da", "db"]).select("text", "ranges", "runs", "row").mapInArrow(cut, schema)
    same = {"kept": F.coalesce(F.col("text"), F.lit("")).cast("binary"), "removed": F.array().cast(kinds["removed"][0]), "clean": F.coalesce(F.col("text"), F.lit(""))}
    whole = docs.join(F.broadcast(keys), ["da", "db"], "left_anti").select("row", *(same[c].alias(c) for c in give))
    return hit.unionByName(whole).select("row.*", *give)
