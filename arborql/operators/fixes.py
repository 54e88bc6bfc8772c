"""Fixes: rewrites of findings, put into their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_sources(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file_id, file, fixed_src, applied, skipped) of files with fixes.

    Fixes go in from the end of a file; one that overlaps a fix after it is skipped. At equal starts the one that ends
    last goes first, then by rule, so the result doesn't depend on the order of rows.
    """
    fixes = findings.where("fix is not null").select("file_id", F.struct((-F.col("startByte")).alias("at"), (-F.col("endByte")).alias("to"), "rule", "fix").alias("f"))
    per_file = fixes.groupBy("file_id").agg(F.array_sort(F.collect_list("f")).alias("fixes"))
    rows = files.select("file_id", F.col("path").alias("file"), F.col("src").cast("binary").alias("bin")).join(per_file, "file_id")
    start = F.struct(F.lit(b"").alias("tail"), (F.octet_length("bin")).alias("edge"), F.lit(0).alias("applied"), F.lit(0).alias("skipped"))

    def step(acc, f):
        a, b = -f["at"], -f["to"]
        after = F.expr("bin")
        between = F.substring(after, b + 1, F.greatest(acc["edge"] - b, F.lit(0)))
        done = F.struct(F.concat(f["fix"].cast("binary"), between, acc["tail"]).alias("tail"), a.alias("edge"), (acc["applied"] + 1).alias("applied"), acc["skipped"].alias("skipped"))
        left = F.struct(acc["tail"].alias("tail"), acc["edge"].alias("edge"), acc["applied"].alias("applied"), (acc["skipped"] + 1).alias("skipped"))
        return F.when(b > acc["edge"], left).otherwise(done)

    folded = rows.withColumn("r", F.aggregate("fixes", start, step))
    whole = F.concat(F.substring("bin", F.lit(1), F.col("r")["edge"]), F.col("r")["tail"]).cast("string")
    return folded.select("file_id", "file", whole.alias("fixed_src"), F.col("r")["applied"].alias("applied"), F.col("r")["skipped"].alias("skipped"))


def fix_counts(fixed: DataFrame) -> DataFrame:
    """(files_changed, fixes_applied, skipped)."""
    return fixed.agg(F.count(F.when(F.col("applied") > 0, 1)).alias("files_changed"), F.coalesce(F.sum("applied"), F.lit(0)).alias("fixes_applied"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
