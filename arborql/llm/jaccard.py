"""Near duplicates by SimHash, every link confirmed by the exact Jaccard likeness of word shingles.

Sets: a text's distinct shingles as XXH64 numbers, hashed as ``simhash`` hashes them. Texts with equal sets are one node.
Candidates: nodes that meet in a table of SimHash bits and differ in few bits (``simhash.meetings``). A pair with a likeness
of 0.8 is missed with a computed probability of about 1 in 100,000 by the tables and of a few in a million by the radius,
a more alike one with less; sets of fewer than ten shingles, whose bits are uneven, somewhat more.

Links: a candidate is a link if its two sets, read again from the texts, are at least that alike. So that large groups of
near copies form few pairs, every bucket's members meet its busiest node first (a text that others are copies of shares more
keys with them than they do with each other), STARS rounds long. Those that are left form families, connected by common keys.
A family is compared, signatures first, then sets, in blocks of BLOCK members and pairs of blocks, so none has to fit into
one task; of the links found there only as many become rows as it takes to connect what they connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._shared import held, kept, scratch, small_batches, stored
from .components import components

STARS = 1
BLOCK, BLOCK_SHINGLES = 1000, 1 << 20
#: So many candidates are worth one pass over all sets of a block.
MANY = 16


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct shingles of a text's lower-case words as numbers; a text of fewer words is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    parts = zip(*(tokens[i:] for i in range(min(words, len(tokens)))), strict=False)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(x), 42) for x in parts], np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _node(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), 42))


def _sets(df: DataFrame, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the nodes ``wanted`` (node, text_key)."""
    key = F.xxhash64(df[text_col].cast("string"))
    texts = df.select(key.alias("text_key"), df[text_col].cast("string").alias("text")).join(held(wanted.select("text_key").distinct()), "text_key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [shingles(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "shingles"])

    one = texts.dropDuplicates(["text_key", "text"])
    return stored(one.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "sets", 8 * wanted.count())


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike by at least ``percent``."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return both.where(common * (100 + percent) >= total * percent).select("a", "b")


def _linked_in_families(open_: DataFrame, nodes: DataFrame, sets: DataFrame, rows: int, percent: int) -> DataFrame:
    """(a, b): links between nodes of ``open_`` (key, node, size, root; ``rows`` rows) with different roots, enough of them to
    connect all such nodes that share a key and are linked."""
    least = open_.groupBy("key").agg(F.min("node").alias("a"))
    families = components(open_.join(least, "key").select("a", F.col("node").alias("b")).where("a <> b"), rows)
    left = stored(open_.select("node", "size", "root").distinct().join(families.select("node", F.col("root").alias("family")), "node"), "families", rows)
    crowd = stored(left.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "crowd", left.count())
    placed = left.join(crowd, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = placed.join(nodes.select("node", "sketch"), "node").join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = full.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "root", "sketch", "shingles")
    most = simhash.radius(percent)

    def compare(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        own, node, size, root = (table[c].to_numpy() for c in ("own", "node", "size", "root"))
        words = simhash.words_of(table["sketch"].combine_chunks())
        known, shingle = np.unique(table["shingles"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        here, part = np.zeros(len(known), bool), np.unique(root, return_inverse=True)[1]
        found: list[tuple[int, int]] = []
        for at in range(len(node)):
            to = np.arange(at + 1, len(node)) if i == j else np.flatnonzero(own == j) if own[at] == i else np.zeros(0, np.int64)
            to = to[part[to] != part[at]]
            small, large = np.minimum(size[at], size[to]), np.maximum(size[at], size[to])
            to = to[small.astype(np.int64) * 100 >= large.astype(np.int64) * percent]
            to = to[simhash.within(words[to], words[at], most)]
            if not len(to):
                continue
            mine = shingle[starts[at] : starts[at] + size[at]]
            here[mine] = True
            if len(to) < MANY:
                common = np.array([np.count_nonzero(here[shingle[starts[x] : starts[x] + size[x]]]) for x in to])
            else:
                common = np.add.reduceat(here[shingle], starts, dtype=np.int64)[to]
            here[mine] = False
            to = to[common * (100 + percent) >= (size[to].astype(np.int64) + size[at]) * percent]
            parts, first = np.unique(part[to], return_index=True)
            found += [(int(node[at]), int(node[x])) for x in to[first]]
            part[np.isin(part, parts)] = part[at]
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return members.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def link(nodes: DataFrame, df: DataFrame, text_col: str, words: int = 5, percent: int = 80) -> DataFrame:
    """(node, root): the components of the nodes (node, text_key, size, sketch) that have a link; root is the least node."""
    count = nodes.count()
    bits = simhash.key_bits(count)
    members = stored(simhash.meetings(nodes, bits, percent), "meetings")
    keys_ = members.count()
    wanted = stored(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "text_key"), "wanted", min(count, keys_))
    sets = _sets(df, text_col, wanted, words)
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    open_ = stored(members.drop("n").join(weights, "node").withColumn("root", F.col("node")), "open", keys_)
    alike = F.least("size", "size2") * 100 >= F.greatest("size", "size2") * percent
    pair = lambda rows: rows.where(alike).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    links = None
    for turn in range(STARS + 1):
        if turn < STARS:
            busiest = stored(open_.groupBy("key").agg(F.max(F.struct("weight", "node", "size", "root")).alias("top")), "busiest", keys_)
            other = busiest.select("key", F.col("top.node").alias("node2"), F.col("top.size").alias("size2"), F.col("top.root").alias("root2"))
            met = open_.join(other, "key").where("root <> root2")
            pairs = stored(pair(met), "pairs", keys_)
            known = pairs.count() + (0 if links is None else links.count())
            found = _links(pairs, sets, percent)
        else:
            found = stored(_linked_in_families(open_, nodes, sets, keys_, percent), "linked")
            known = found.count() + (0 if links is None else links.count())
        links = stored(found if links is None else links.union(found), "confirmed", 16 * known)
        roots = components(links, known)
        if turn < STARS:
            # The busiest node has met all of its bucket, so others go on without it where they aren't connected yet.
            named = open_.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            rest = stored(named.join(other.select("key", "node2"), "key").where("node <> node2").drop("node2"), "rest", keys_)
            mixed = rest.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
            open_ = stored(rest.join(mixed, "key", "left_semi"), "open", keys_)
            if open_.isEmpty():
                break
    return roots


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 5, percent: int = 80) -> DataFrame:
    """(id, node, component_id): one row per row of ``df``; component_id is the smallest id that the row reaches.

    Candidates come from SimHash signatures of the same shingles. Rows link if their sets of shingles have a Jaccard likeness of at least ``percent`` hundredths. Texts without words link
    to each other only. A null id keeps its row and is passed over for component_id unless no row of the component has an id.
    """
    chosen = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col].cast("string")).alias("text_key"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [shingles(x, words) for x in batch.column(2).to_pylist()]
            columns = [pa.array([_node(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array([simhash.signature(x).tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "text_key", "node", "size", "sketch"])

    rows = stored(chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, text_key long, node long, size int, sketch binary"), "shingled")
    nodes = stored(rows.groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("text_key", "size", "sketch")).alias("one")).select("node", "least", "one.*"), "nodes", rows.count())
    with scratch(df.sparkSession):
        roots = link(nodes, df, text_col, words, percent)
        named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = kept(stored(named.join(least, "root").select("node", "component_id"), "classes", nodes.count()))
    return rows.join(classes, "node").select("id", "node", "component_id")
