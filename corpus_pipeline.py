"""From documents to packed training sequences: quality, near duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and works on every row that the stage before
kept. Null and empty texts pass through as empty texts; repeated rows are copies of a document, of which near-duplicate
removal keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborql.llm import _shared, jaccard, mixing, packing, quality, queries, repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP_FROM = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression classifier scores at least KEEP_FROM. Labels that it learns from are the table's."""
    _shared.small_arrow(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "doc_id", "text", "quality", quality.learn_rows())
    return quality.score(docs.select(*COLUMNS), "text", model, "__score").where(F.col("__score") >= KEEP_FROM).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id (a null id is the largest). SimHash signatures of
    five-word shingles tell which documents to compare; a Jaccard likeness of at least 0.8 of the shingles links them."""
    _shared.small_arrow(spark)
    keyed = _shared.keyed(docs.select(*COLUMNS))
    named = keyed.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *_shared.KEY))
    key = [F.col(f"id.{k}").alias(k) for k in _shared.KEY]
    with _shared.scratch(spark):
        found = _shared.stored(jaccard.near_duplicates(named, "__row", "text", words=5, percent=80), "near-duplicates")
        n = found.count()
        lost = _shared.kept(_shared.stored(found.where("id <> component_id").select(*key).distinct(), "lost", n))
        counted = _shared.kept(_shared.stored(found.where("id = component_id").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "counted", n))
    kept = keyed.join(_shared.held(lost), _shared.KEY, "left_anti")
    return _shared.one_row_each(kept, counted).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without passages of over 50 words or of 400 bytes that also stand elsewhere; characters that a cut halves go too."""
    _shared.small_arrow(spark)
    found = repeats.remove_repeats(docs.select(*COLUMNS), "text", words=queries.PASSAGE_WORDS, give=("clean",))
    same = F.col("clean") == F.coalesce("text", F.lit(""))
    n_chars = F.when(same, F.col("n_chars")).otherwise(F.char_length("clean").cast("long"))
    return found.withColumn("n_chars", n_chars).withColumn("text", F.when(same, F.col("text")).otherwise(F.col("clean"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it."""
    _shared.small_arrow(spark)
    keyed = _shared.keyed(docs.select(*COLUMNS))
    named = keyed.withColumn("__row", F.struct("doc_id", *_shared.KEY))
    with _shared.scratch(spark):
        mixed = mixing.mix(named, "__row", "source", queries.word_count())
        copies = mixed.groupBy(*(F.col(f"id.{k}").alias(k) for k in _shared.KEY)).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
        total = _shared.kept(_shared.stored(copies, "copies"))
    rows = _shared.one_row_each(keyed, total).join(_shared.held(total.where("copies > 0").select(*_shared.KEY, "copies")), _shared.KEY)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens, with their ids as little-endian 32-bit numbers."""
    _shared.small_arrow(spark)
    return packing.pack(docs, "doc_id", "text", queries.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]

#: SQL cannot express the classifier, the components and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with _shared.scratch(spark):
            docs = _shared.kept(_shared.stored(stage(spark, docs, sf_dir), name.split()[0].lower()))
    return STAGES[-1][1](spark, docs, sf_dir)
