"""Rules' own test cases, all in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compile import Compiled, compile_rule
from ..rules.model import Rule
from .findings import matched
from .fixes import fixed_sources

RESULT = "rule string, idx int, expect string, lang string, n long, passed boolean, why string"


def run_tests(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule, idx, expect, lang, n, passed, why): one row per case.

    A case runs in each language of its rule and the one with the most findings counts, the first of equals. Paths,
    settings and suppressing comments play no part. A fix is held against the snippet with all of that language's fixes.
    """
    rows: list[tuple] = []
    every: list[Compiled] = []
    for at, rule in enumerate(rules):
        compiled = compile_rule(rule)
        for idx, case in enumerate(rule.cases):
            for order, c in enumerate(compiled):
                rows.append((len(rows), f"{at}", c.lang.name, case.code, [len(every) + order], at, rule.id, idx, case.expect, case.count, case.fixed, order))
        every += compiled
    if not rows:
        return spark.createDataFrame([], RESULT)
    cases = spark.createDataFrame(rows, "file_id long, path string, lang string, src string, todo array<int>, at int, rule string, idx int, expect string, count int, fixed string, lang_order int")
    findings = matched(cases, every, keep_suppressed=True).withColumn("rule", F.col("number").cast("string"))
    counts = findings.groupBy("file_id").agg(F.count("*").alias("n"))
    fixed = fixed_sources(cases, findings).select("file_id", "fixed_src")
    scored = cases.join(counts, "file_id", "left").join(fixed, "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.row_number().over(Window.partitionBy("at", "idx").orderBy(F.desc("n"), "lang_order"))
    scored = scored.withColumn("best", best).where("best = 1")
    counted = F.when(F.col("expect") == "no_match", F.col("n") == 0).when(F.col("count") >= 0, F.col("n") == F.col("count")).otherwise(F.col("n") >= 1)
    trim = lambda c: F.btrim(F.coalesce(c, F.col("src")), F.lit(" \t\r\n"))
    right_fix = F.col("fixed").isNull() | (trim(F.col("fixed_src")) == F.btrim("fixed", F.lit(" \t\r\n")))
    why = F.when(~counted, F.concat(F.lit("found "), F.col("n"))).when(~right_fix, F.concat(F.lit("fixed to: "), trim(F.col("fixed_src"))))
    return scored.select("rule", "idx", "expect", "lang", "n", (counted & right_fix).alias("passed"), why.alias("why")).orderBy("rule", "idx")

