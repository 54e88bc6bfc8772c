"""SimHash fingerprints of word shingles, linked within a Hamming radius by covering locality-sensitive hashing.

Tables: give each bit i a nonzero vector m(i) of radius + 1 bits, dealt round robin. The table of a nonzero vector v keeps
the bits with <m(i), v> odd. For any ``radius`` bits some v is orthogonal to all of their vectors, so a pair that differs
in at most ``radius`` bits agrees on all that this table keeps: it shares a bucket in one of the 2^(radius+1) - 1 tables.

Buckets: tables hold distinct fingerprints, never documents. A bucket of up to SMALL fingerprints compares them in place.
In a larger one no pair is formed: two fingerprints are within 2e of each other exactly if their balls of radius e meet,
so each fingerprint names the points of its ball that lie in the bucket and those with a common point are linked to the
least of them. A point's members number at most its own ball, whatever the size of the bucket.

Long signatures: a radius that is wide enough for a likeness of 0.8 (a pair differs in 15 % of the bits) leaves 64 bits no
keys. For that, ``signature`` goes on to WORDS words of bits by the same rule, and ``meetings`` deals them out to tables, each
with keys of so many bits that a bucket holds about BUCKET unrelated members, and as many tables as miss a pair with a
probability of MISS. A bucket's members are compared by their first NEAR_WORDS words; those with a member within the radius
of that likeness are given, once a bucket, so no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import acos, comb, lgamma, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, stored
from .components import components

BITS = 64
SMALL = 12
#: Bits of this many shingles are counted at a time.
CHUNK = 1 << 15
#: Words of 64 bits of a long signature, and those that are compared.
WORDS, NEAR_WORDS = 16, 2
BUCKET, MISS = 128, 1e-5
#: Buckets of up to so many members are compared all at once; members of tables that a task gathers before it compares.
AT_ONCE, GATHERED = 512, 1 << 16
_SEEDS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text's word shingles, XXH64 with seed 42, a bit being 1 if set in over half of them. No words: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        hashes = [digest(b" ".join(tokens), 42)]
    else:
        hashes = [digest(b" ".join(x), 42) for x in zip(*(tokens[i:] for i in range(words)), strict=False)]
    values = np.array(hashes, "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16).astype(np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed number. Null texts have 0, as texts without words."""
    chosen = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, fp long")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The bits that each table keeps, as signed numbers."""
    vectors = [i % ((1 << radius + 1) - 1) + 1 for i in range(bits)]
    kept = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << radius + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in kept]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(fp: Column, radius: int) -> Column:
    """All points within ``radius`` of a fingerprint."""
    flips = [0] + [reduce(lambda a, i: a | 1 << i, c, 0) for r in range(1, radius + 1) for c in combinations(range(BITS), r)]
    return F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), lambda x: fp.bitwiseXOR(x))


def link(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints ``fps`` (fp) whose components are those of all pairs within ``radius``.

    ``radius`` is even and small: a large bucket costs a ball of radius / 2 for each fingerprint.
    """
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("the radius must be 2 or 4")
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])
    table = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sized = table.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(table.join(sized, ["t", "key"]), "buckets")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    few = members.where(F.col("n") <= SMALL).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    close = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    crowded = members.where(F.col("n") > SMALL).select("fp").distinct()
    points = crowded.select("fp", F.explode(_ball(F.col("fp"), radius // 2)).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top"), F.collect_set("fp").alias("fps")).where("a <> top")
    met = least.select("a", F.explode("fps").alias("b")).where("a <> b")
    return close.union(met).distinct()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id): one row per row of ``df``; component_id is the smallest id that the row reaches.

    Rows link if their fingerprints differ in at most ``radius`` bits; equal fingerprints are one node, so copies never
    form pairs. Null and empty texts have fingerprint 0 and link to each other and to what is near 0. A null id keeps its
    row and is passed over for component_id unless no row of the component has an id. Other columns are ignored.
    """
    rows = stored(fingerprints(df, id_col, text_col, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes", rows.count())
    roots = components(link(nodes.select("fp"), radius))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("id", "fp", "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64; zero stays zero."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(hashes: np.ndarray) -> np.ndarray:
    """WORDS words, each the SimHash of the 64-bit ``hashes`` themselves (the first) or mixed with a seed of the word's own."""
    ones = np.zeros(WORDS * BITS, np.int64)
    for at in range(0, len(hashes), 255):
        part = np.repeat(hashes[at : at + 255, None], WORDS, axis=1)
        part[:, 1:] = _mixed(part[:, 1:] + _SEEDS[1:])
        bits = np.unpackbits(part.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def differing(percent: int) -> float:
    """The share of bits in which two equally large sets with a Jaccard likeness of ``percent`` hundredths differ; less if one is larger."""
    return acos(2 * percent / (100 + percent)) / pi


def radius(percent: int) -> int:
    """Bits of the compared words in which such sets differ at most, but for a few in a million."""
    n, p = NEAR_WORDS * BITS, differing(percent)
    return int(n * p + 5.3 * (n * p * (1 - p)) ** 0.5)


@lru_cache
def tables(bits: int, percent: int) -> int:
    """Tables with keys of ``bits`` bits that miss a pair of such sets in all with a probability of at most MISS."""
    n, p = WORDS * BITS, differing(percent)
    at = np.arange(n + 1)
    odds = np.exp([lgamma(n + 1) - lgamma(d + 1) - lgamma(n - d + 1) + d * log(p) + (n - d) * log(1 - p) for d in at])
    apart = 1 - np.array([comb(n - d, bits) / comb(n, bits) for d in at.tolist()])
    count, missed = 0, odds
    while missed.sum() > MISS:
        count, missed = count + 1, missed * apart
    return count


@lru_cache
def _dealt(bits: int, count: int) -> np.ndarray:
    """The bits of each table; tables have none in common before all bits are dealt."""
    random, each = np.random.default_rng(42), WORDS * BITS // bits
    rounds = [random.permutation(WORDS * BITS)[: each * bits].reshape(each, bits) for _ in range(-(-count // each))]
    return np.concatenate(rounds)[:count]


def table_keys(signatures: np.ndarray, bits: int, percent: int) -> np.ndarray:
    """The key of each of the ``signatures`` (rows of WORDS words) in each table."""
    plain = np.unpackbits(np.ascontiguousarray(signatures, "<u8").view(np.uint8), axis=1, bitorder="little")
    found = np.zeros((len(plain), tables(bits, percent)), np.int64)
    for i, places in enumerate(_dealt(bits, found.shape[1]).T):
        found |= plain[:, places].astype(np.int64) << i
    return found


def words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), WORDS)


def within(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs of ``a`` and ``b`` (first words last) differ in ``most`` compared bits at most."""
    return np.bitwise_count(a[..., :NEAR_WORDS] ^ b[..., :NEAR_WORDS]).sum(axis=-1, dtype=np.uint16) <= most


def key_bits(rows: int) -> int:
    """Bits of a key for which ``rows`` unrelated signatures fill buckets of about BUCKET."""
    return max(1, (max(rows, 1) // BUCKET).bit_length())


def _groups(words: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """The group of each member of a bucket, -1 for those with no other member that is near. Near members have one group."""
    most, n = radius(percent), len(words)
    alike = lambda x: np.minimum(size[x], size) * 100 >= np.maximum(size[x], size) * percent
    if n > AT_ONCE:  # one group: a member that is near one that was compared needn't be compared itself
        found = np.full(n, -1)
        for at in range(n):
            if found[at] < 0:
                near = within(words[at], words, most) & alike(at)
                near[at] = False
                if near.any():
                    found[near] = found[at] = 0
        return found
    near = within(words[:, None], words, most) & alike(np.arange(n)[:, None])
    has = near.sum(axis=1) > 1
    found = np.where(has, np.arange(n), -1)
    if has.any():
        some = np.flatnonzero(has)
        near = near[np.ix_(some, some)]
        while True:
            least = np.where(near, found[some], n).min(axis=1)
            if (least == found[some]).all():
                break
            found[some] = least
    return found


def meetings(nodes: DataFrame, bits: int, percent: int) -> DataFrame:
    """(key, node, size, n): the ``nodes`` (node, size, sketch: a signature's bytes) that meet another that is near, in every
    bucket where they do. Near nodes with a bucket in common have a key in common there, which n members have.

    Sets of so few elements that no other set can be alike by ``percent`` hundredths meet none.
    """
    schema = "bucket long, node long, size int, " + ", ".join(f"w{i} long" for i in range(NEAR_WORDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = words_of(batch.column(2))
            found = table_keys(words, bits, percent)
            buckets = found | np.arange(found.shape[1]) << bits
            for at in range(found.shape[1]):
                columns = [pa.array(buckets[:, at]), batch.column(0), batch.column(1), *(pa.array(words[:, i].view("<i8")) for i in range(NEAR_WORDS))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "node", "size", *(f"w{i}" for i in range(NEAR_WORDS))])

    def met(bucket: np.ndarray, node: np.ndarray, size: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
        keys, who, counts = [], [], []
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if end - start < 2:
                continue
            group = _groups(words[start:end], size[start:end], percent)
            some = np.flatnonzero(group >= 0)
            if len(some):
                _, number, n = np.unique(group[some], return_inverse=True, return_counts=True)
                least = np.full(len(n), np.iinfo(np.int64).max)
                np.minimum.at(least, number, node[start:end][some])
                hashed = _mixed(least.view(np.uint64) + bucket[start : start + 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keys.append(hashed.view(np.int64)[number])
                who.append(some + start)
                counts.append(n[number])
        if keys:
            at = np.concatenate(who)
            columns = [pa.array(np.concatenate(keys)), pa.array(node[at]), pa.array(size[at]), pa.array(np.concatenate(counts))]
            made = pa.RecordBatch.from_arrays(columns, ["key", "node", "size", "n"])
            for x in range(0, len(at), 4096):
                yield made.slice(x, 4096)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of what is gathered waits for the rest of it."""
        rest: list[list[np.ndarray]] = []
        held = 0

        def gathered() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*rest, strict=True)]

        for batch in small_batches(batches):
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            rest.append([*c[:3], np.column_stack(c[3:]).view(np.uint64)])
            held += batch.num_rows
            if held >= GATHERED:
                all_ = gathered()
                whole = int(np.searchsorted(all_[0], all_[0][-1]))
                yield from met(*(x[:whole] for x in all_))
                rest, held = [[x[whole:].copy() for x in all_]], 0
        if rest:
            yield from met(*gathered())

    several = nodes.where(F.col("size") * 100 >= (F.col("size") + 1) * percent).select("node", "size", "sketch")
    dealt = several.mapInArrow(deal, schema).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "key long, node long, size int, n long")
