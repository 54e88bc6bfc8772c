"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Among all rates r >= 0 of documents that give each source its target number of tokens, take those with the least
Kullback-Leibler divergence from taking every token once. Tokens are the units, so the divergence is the sum over
documents of size * (r * ln r - r + 1) and its convex dual is, per source, size_sum * exp(L) - target * L: each rate is an
exponential tilt exp(L) of the base rate. Newton's method solves the dual on sums that partial aggregation makes.

Rates become copies: every document gets floor(rate), and the fraction f of the rate is met by giving some documents one
copy more. Large documents first: in an order by hash they are taken while the running sum of sizes stays nearest to
f of theirs; then small ones meet what is still missing. Running sums are kept over blocks of rows and over rows inside
a block, so a source that holds most rows is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

#: Documents in a block of running sums, on average.
BLOCK_ROWS = 2_000
NEWTON_STEPS = 80


def targets(sources: DataFrame, weights: int, most: float) -> DataFrame:
    """``sources`` (source, total) with weight, target: weights 1..``weights`` repeat by code point, null last.

    A target is at most ``most`` times its total. With K tokens a unit of weight, sum(min(most * total, weight * K)) is the
    sum of all totals; sources are full in the order of most * total / weight, so running sums over it give K at once.
    The rows are one a source, a small table whatever the number of documents.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % weights + 1).cast("double")).withColumn("full", F.col("total") * F.lit(most))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("full") / F.col("weight"), F.asc_nulls_last("source"))
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("all", F.sum("total").over(everything))
        .withColumn("full_below", F.coalesce(F.sum("full").over(below), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("full_below")) / F.col("weight_from"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("full"))
        .withColumn("k", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    )
    return levels.select("source", "total", "weight", F.when(F.col("k").isNull() | (F.col("weight") * F.col("k") > F.col("full")), F.col("full")).otherwise(F.col("weight") * F.col("k")).alias("target"))


def newton(total: Column, target: Column) -> Column:
    """The dual variable: zero of total * exp(L) - target by Newton's steps, null where either is 0.

    From above the zero the steps shrink L by less than 1 and then converge quadratically; one step from below leads above.
    """
    step = lambda at, _: at - 1 + target / total * F.exp(-at)
    return F.when((total > 0) & (target > 0), F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (source, id, size, block, h, ...) with ``upto``: the sum of sizes in their source from the first one to each."""
    inside = Window.partitionBy("source", "block").orderBy("h", F.asc_nulls_last("id"), "row")
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("block_size").over(ahead), F.lit(0)).alias("before"))
    placed = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return placed.withColumn("upto", F.col("before") + F.sum("size").over(inside)).drop("s", "b", "before")


def mix(df: DataFrame, id_col: str, source_col: str, size: Column, weights: int = 3, most: float = 3.0) -> DataFrame:
    """(id, size, source, source_size, target, rate, copies, row): one row per row of ``df``.

    ``size`` is the number of tokens of a row (null counts 0); a null source is a source of its own. Copies never exceed
    ``most``, and of large rows ceil(rate). A source without tokens has target 0 and rate 1. Copies depend on ids, sizes and the
    rows' order within equal (id, size) pairs only, so runs agree; repeated rows are rows of their own. No rows, no result.
    """
    base = df.select(df[id_col].alias("id"), df[source_col].alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    return _mix_sizes(stored(base, "sizes"), weights, most)


def _mix_sizes(base: DataFrame, weights: int, most: float) -> DataFrame:
    plain = F.struct(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"))
    base = base.withColumn("row", F.monotonically_increasing_id()).withColumn("source_key", F.to_json(plain))
    per_source = base.groupBy("source_key", "source").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    named = targets(per_source.select("source", "total"), weights, most)
    plan = per_source.select("source_key", F.col("source").alias("s"), "n").join(named, F.col("s").eqNullSafe(F.col("source"))).drop("s", "source")
    rate = F.least(F.coalesce(F.exp(newton(F.col("total"), F.col("target"))), F.when(F.col("total") > 0, 0.0).otherwise(1.0)), F.lit(most))
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    plan = plan.withColumn("rate", near).withColumn("fraction", F.col("rate") - F.floor("rate"))
    plan = plan.withColumn("small", F.greatest(F.col("total") / F.col("n") / 2, F.lit(1.0))).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS))
    plan = stored(plan.withColumnRenamed("source_key", "k"), "mix-plan", base.count())
    # One row a source: broadcast up to a proven size, else joined.
    sources = plan.count()
    held = F.broadcast(plan) if sources <= 100_000 else plan
    hash_ = F.xxhash64("id", "size")
    rows = base.join(held, F.col("source_key") == F.col("k")).drop("k", "n", "weight").withColumnRenamed("source", "label").withColumnRenamed("source_key", "source")
    rows = rows.withColumn("h", hash_).withColumn("block", F.shiftrightunsigned(hash_, 33) % F.col("blocks"))
    is_large = F.col("size") > F.col("small")
    sums = rows.groupBy("source").agg(F.sum(F.when(is_large, F.col("size")).otherwise(0)).alias("large"), F.max(F.when(is_large, F.col("size")).otherwise(0)).alias("largest"), F.sum(F.when(is_large, 0).otherwise(F.col("size"))).alias("little"))
    wanted = stored(plan.select(F.col("k").alias("source"), (F.col("fraction") * F.col("total")).alias("wanted_all"), (F.lit(most) - F.floor("rate")).alias("room")).join(sums, "source"), "mix-wanted", sources)
    hold = lambda df: F.broadcast(df) if held is not plan else df
    fill = F.col("little") * F.col("room") >= F.col("largest")
    first = _placed(rows.where(is_large)).join(hold(wanted), "source")
    middle = F.col("upto") - F.col("size") / 2
    share = F.col("large") * F.col("fraction")
    first = stored(first.withColumn("extra", F.when(fill, F.col("upto") <= share).otherwise(middle <= share).cast("long")), "mix-large")
    met = first.groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("met"))
    rest = stored(wanted.join(met, "source", "left").withColumn("rest", F.col("wanted_all") - F.coalesce("met", F.lit(0))).drop("met"), "mix-rest", sources)
    second = _placed(rows.where(~is_large)).join(hold(rest), "source")
    times = F.floor((F.col("rest") - middle) / F.greatest("little", F.lit(1))) + 1
    second = second.withColumn("extra", F.least(F.floor("room"), F.greatest(times, F.lit(0))).cast("long")).drop("rest")
    copies = F.floor("rate") + F.when(F.col("fraction") > 0, F.col("extra")).otherwise(0)
    both = first.unionByName(second)
    return both.select("id", "size", F.col("label").alias("source"), F.col("total").alias("source_size"), "target", "rate", copies.cast("long").alias("copies"), "row")
