"""The queries of this subpackage: each applies one operator to a whole table and gives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, fingerprints, media, mixing, neighbours, ngrams, packing, quality, repeats, simhash, toxicity, webpages

TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def word_count(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_shared.documents(spark, sf_dir), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.documents(spark, sf_dir)
    fold = _shared.remainder("doc_id", 7)
    model = ngrams.train(docs, "text", fold != 2)
    found = ngrams.score(docs, "doc_id", "text", model)
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    _shared.small_arrow(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = webpages.main_text(pages, "page_id", "url", "html")
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


#: Words of a passage that op4_repeats' further column ``text`` is without, as the pipeline's stage: over 50.
PASSAGE_WORDS = 51


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns tell of strings of 400 bytes; ``text`` is the text without those and without passages of over 50
    words that also stand elsewhere (many such passages have fewer bytes)."""
    docs = _shared.documents(spark, sf_dir).select("doc_id", "text")
    found = repeats.remove_repeats(docs, "text", words=PASSAGE_WORDS, give=("kept", "removed", "clean"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    kept = F.octet_length("kept").cast("long")
    return found.select("doc_id", (kept + lost).alias("n_bytes"), lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("clean").alias("text"))


def _classified(docs: DataFrame, model, score, threshold: float) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), "text", model)
    held_out = F.coalesce(_shared.remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic", toxicity.learn_rows())
    return _classified(docs, model, toxicity.score, 0.5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_shared.documents(spark, sf_dir), "doc_id", "text", tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    import pyarrow as pa

    docs = _shared.documents(spark, sf_dir)
    names = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_fingerprint", "near_edited", "near_next"]

    def make(ids: list, texts: list, nexts: list) -> pa.RecordBatch:
        rows = []
        for i, text, after in zip(ids, texts, nexts, strict=True):
            text, after = text or "", after or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            own, other, next_ = map(fingerprints.canonical, (text, edited, after))
            rows.append((i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprints.digest(own), fingerprints.digest(other), fingerprints.likeness(own, other), fingerprints.likeness(own, next_)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    beside = neighbours.map_with_next(docs, "doc_id", "text", make, "doc_id long, n_chars long, edited_sha256 string, digest string, edited_fingerprint string, near_edited double, near_next double")
    found = fingerprints.exact_fingerprints(docs, "doc_id", "text")
    named = found.select(F.col("id"), "fingerprint", "copies", F.split("fingerprint", "-")[0].alias("d")).dropDuplicates(["id", "fingerprint"])
    joined = beside.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    return joined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "doc_id", "text", "quality", quality.learn_rows())
    return _classified(docs, model, quality.score, 0.3)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_shared.documents(spark, sf_dir), "doc_id", "source", word_count())
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_audio(_shared.documents(spark, sf_dir), "doc_id", "text")
    read = media.media_columns(stored, "media", with_payload=True)
    seconds = (F.col("media_duration") / F.col("media_timescale")).cast("decimal(20,3)")
    key = lambda at: F.concat_ws("-", F.element_at("media_keyframes", at)["start"].cast("string"), F.element_at("media_keyframes", at)["end"].cast("string"))
    feature = F.concat_ws(";", "media_codec", seconds.cast("string"), F.col("media_samples").cast("string"), F.size("media_keyframes").cast("string"), key(1), key(-1))
    payload = F.col("media_payload")
    return read.select(
        F.col("id").alias("doc_id"), "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash": op1_simhash, "op2_language_model": op2_language_model, "op3_main_text": op3_main_text, "op4_repeats": op4_repeats, "op5_toxicity": op5_toxicity, "op8_quality": op8_quality, "op6_packing": op6_packing, "op7_fingerprints": op7_fingerprints, "op9_mixing": op9_mixing, "op10_media": op10_media}


def oracle_sql() -> dict[str, str]:
    return {}
