"""Connected components of a table of links, by repeated minimum hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept, scratch, stored

MOST_ROUNDS = 60


def _followed(hooks: DataFrame, rows: int) -> DataFrame:
    """``hooks`` (from, to) with ``to`` at the end of its path. Hooks go to smaller nodes only, so they make no circle."""
    for _ in range(MOST_ROUNDS):
        hooks = stored(hooks, "hooks", rows)
        ends = hooks.select(F.col("from").alias("f2"), F.col("to").alias("t2"))
        if hooks.join(ends, F.col("to") == F.col("f2"), "left_semi").isEmpty():
            return hooks
        for _ in range(2):
            ends = hooks.select(F.col("from").alias("f2"), F.col("to").alias("t2"))
            hooks = hooks.join(ends, F.col("to") == F.col("f2"), "left").select("from", F.coalesce("t2", "to").alias("to"))
    raise RuntimeError(f"paths didn't end in {MOST_ROUNDS} rounds")


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): every node that occurs in ``links`` (a, b; at most ``rows`` if known) and the smallest node that it reaches.

    Each round hooks every root that has a smaller neighbour to the smallest of them and follows the hooks to their ends,
    so at least half of the linked roots go; links inside a component are dropped as it forms. Nothing but "is it empty"
    reaches the driver; rounds are written to the shared folder. No links give no rows.
    """
    with scratch(links.sparkSession):
        return kept(_components(links, rows))


def _components(links: DataFrame, rows: int | None) -> DataFrame:
    open_ = stored(links.select("a", "b").where("a <> b").distinct(), "links", rows)
    most = open_.count()
    nodes = open_.select(F.col("a").alias("node")).union(open_.select(F.col("b").alias("node"))).distinct()
    label = stored(nodes.select("node", F.col("node").alias("root")), "labels", 2 * most)
    for _ in range(MOST_ROUNDS):
        if open_.isEmpty():
            return label
        hooks = _followed(open_.groupBy(F.greatest("a", "b").alias("from")).agg(F.min(F.least("a", "b")).alias("to")), most)
        label = stored(label.join(hooks, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root")), "labels", 2 * most)
        ha = hooks.select(F.col("from").alias("fa"), F.col("to").alias("ta"))
        hb = hooks.select(F.col("from").alias("fb"), F.col("to").alias("tb"))
        moved = open_.join(ha, F.col("a") == F.col("fa"), "left").join(hb, F.col("b") == F.col("fb"), "left")
        open_ = stored(moved.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b").distinct(), "links", most)
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
