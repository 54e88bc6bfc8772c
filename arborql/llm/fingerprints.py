"""Canonical exact fingerprints: equal after Unicode normalisation, case folding and white-space folding.

The digest is 128-bit xxhash of the canonical text. Equal digests are not trusted: buckets with several rows compare the
canonical bytes, and in a bucket with different texts each text gets its own suffix. All of a bucket's rows are never
gathered: minimum and maximum of its texts show whether they are equal, and only distinct texts of a broken bucket are ranked.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_batches, stored


def canonical(text: str | None) -> bytes:
    """NFKC, case folding, NFKC again, then every run of white space to one space, trimmed. Null is empty."""
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes, bits: int = 128) -> str:
    """Hex digits of the first ``bits`` bits of the canonical text's xxh3-128."""
    return xxhash.xxh3_128_hexdigest(canon)[: bits // 4]


def _digests(df: DataFrame, bits: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            canon = [canonical(x) for x in batch.column(1).to_pylist()]
            found = [batch.column(0), pa.array([digest(x, bits) for x in canon], pa.string())]
            yield pa.RecordBatch.from_arrays(found + [pa.array(canon, pa.binary())] * with_text, ["id", "digest"] + ["canon"] * with_text)

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, digest string" + ", canon binary" * with_text)


#: Digests of several rows up to this many (about 60 bytes each) are broadcast; beyond it they are joined.
BROADCAST_ROWS = 200_000


def exact_fingerprints(df: DataFrame, id_col: str, text_col: str, bits: int = 128) -> DataFrame:
    """(id, fingerprint, copies): one row per row of ``df``, in no order; copies counts the rows with that fingerprint.

    Null texts are empty texts, equal to each other; repeated rows and null ids stay rows of their own. Texts with equal
    canonical bytes have equal fingerprints, others different ones: where digests collide, a suffix tells the texts apart.
    """
    chosen = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    rows = stored(_digests(chosen, bits, False), "digests")
    several = stored(rows.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1"), "buckets")
    small = several.count() <= BROADCAST_ROWS
    held = F.broadcast(several) if small else several
    texts = _digests(chosen, bits, True).join(held.select("digest"), "digest", "left_semi")
    ends = texts.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    broken = stored(ends.where("low <> high").select("digest"), "collisions")
    out = rows.join(held, "digest", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    if broken.isEmpty():
        return out.select("id", F.col("digest").alias("fingerprint"), "copies")
    again = _digests(chosen, bits, True)
    bad = again.join(broken, "digest", "left_semi")
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("canon"))
    ranked = bad.groupBy("digest", "canon").agg(F.count("*").alias("copies")).withColumn("rank", rank)
    named = bad.select("id", "digest", "canon").join(ranked, ["digest", "canon"])
    split = named.select("id", F.concat_ws("-", "digest", F.col("rank").cast("string")).alias("fingerprint"), "copies")
    return out.join(broken, "digest", "left_anti").select("id", F.col("digest").alias("fingerprint"), "copies").unionByName(split)


def likeness(a: bytes, b: bytes) -> float:
    """1 if the digests are equal and the canonical bytes too, else 0: an exact fingerprint knows nothing between."""
    return float(digest(a) == digest(b) and a == b)
