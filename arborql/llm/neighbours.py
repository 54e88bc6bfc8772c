"""Each row beside the next one in id order, for tables of any size: range parts, sorted and streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches


def map_with_next(df: DataFrame, id_col: str, text_col: str, make: Callable[[list, list, list], pa.RecordBatch], schema: str) -> DataFrame:
    """``make(ids, texts, next_texts)`` for lists of rows, where next is the row after in ascending id; the last row's is the first.

    Ids are integers; a null id comes first, equal ids go by their text's hash. The rows are dealt to ranges of ids whose
    bounds come from approximate quantiles (one number a partition reaches the driver), sorted there and streamed, so no
    task holds a range in memory. A copy of each range's first row closes the range before it. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    bounds = np.unique(rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) or [0.0])

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy("float64", na_value=-np.inf)
        return pd.Series(np.searchsorted(bounds, values, "right").astype("int32"))

    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("part", part_of("id"))
    first = sorted((r["part"], r["f"]["id"], r["f"]["h"]) for r in rows.groupBy("part").agg(F.min(F.struct(F.col("id"), F.col("h"))).alias("f")).collect())
    if not first:
        return rows.limit(0).mapInArrow(lambda batches: (make([], [], []) for _ in batches), schema)
    ends = [(*first[(i + 1) % len(first)][1:], part) for i, (part, _, _) in enumerate(first)]
    closing = spark.createDataFrame(ends, "fid long, fh long, end_part int")
    tails = rows.join(F.broadcast(closing), F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")))  # as many rows as ranges
    dealt = rows.select("part", F.lit(False).alias("tail"), "id", "h", "text").unionByName(tails.select(F.col("end_part").alias("part"), F.lit(True).alias("tail"), "id", "h", "text"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", F.asc_nulls_first("id"), "h").select("part", "tail", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in small_batches(batches):
            ids, texts, nexts = [], [], []
            for part, tail, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before and before[0] == part:
                    ids.append(before[1])
                    texts.append(before[2])
                    nexts.append(text)
                before = None if tail else (part, i, text)
            if ids:
                yield make(ids, texts, nexts)

    return dealt.mapInArrow(run, schema)
