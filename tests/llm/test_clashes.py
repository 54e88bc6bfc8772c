"""Extra columns, whatever their names, change no result."""

import pytest
from pyspark.sql import functions as F

from arborql.llm import queries

#: Names that the operators use for their own columns.
NAMES = ["id", "fp", "component_id", "root", "node", "key", "t", "n", "kept", "removed", "clean", "row", "da", "db", "h", "size", "block", "rate", "copies", "extra", "target", "total", "score", "ids", "media", "payload", "digest", "fingerprint", "hash", "label", "y", "quality", "toxic", "__key_a", "__row"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    text = lambda i, n: " ".join(words[(i * 7 + k * (i % 5 + 1)) % 8] + str((i + k) % 11) for k in range(n))
    rows = [(i, text(i % 20, 20 + 9 * (i % 7)), "en", f"s{i % 3}", 5) for i in range(40)] + [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, text(1, 90), "en", "s1", 1), (102, text(1, 90), "en", "s1", 1), (None, text(3, 30), "en", "s2", 1)]
    plain, more = (str(tmp_path_factory.mktemp(n)) for n in ("plain", "more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(f"{plain}/documents.parquet")
    docs.select("*", *[F.lit(i if i % 2 else f"x{i}").alias(n) for i, n in enumerate(NAMES)]).write.parquet(f"{more}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").coalesce(1)
    labels.write.parquet(f"{plain}/labels.parquet")
    labels.select("*", F.lit(3).alias("id"), F.lit("z").alias("text"), F.lit(0.5).alias("y")).write.parquet(f"{more}/labels.parquet")
    return plain, more


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "op3_main_text"])
def test_clashing_columns(spark, folders, name):
    a, b = (queries.queries()[name](spark, f) for f in folders)
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
