"""Connected components over edges of any number by alternating star steps; only edge counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, release


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``id, component`` (the least id reachable) of all ids on edges ``a, b``.

    Large-star: every neighbour above a node links to the least id of the node's neighbourhood. Small-star: a node and its lower neighbours link to the least of
    them. Both keep components and end in stars (Kiveris et al., 2014). A node with very many neighbours is aggregated before its minimum is shuffled. Loops and repeated
    edges do no harm; no edges give no rows.
    """
    now = cut(_ordered(edges), "components")
    seen = None
    for _ in range(most_rounds):
        before, now = now, cut(_small_star(_large_star(now)), "components")
        release(before)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        if state == seen:
            nodes = now.select(F.col("high").alias("id"), F.col("low").alias("component"))
            return nodes.unionByName(nodes.select(F.col("component").alias("id"), "component")).groupBy("id").agg(F.min("component").alias("component"))
        seen = state
    raise RuntimeError("components didn't settle")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()


def _large_star(now: DataFrame) -> DataFrame:
    both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()


def _small_star(now: DataFrame) -> DataFrame:
    least = now.groupBy("high").agg(F.min("low").alias("m"))
    lower = now.join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return lower.unionByName(least.select("high", F.col("m").alias("low"))).filter("high <> low").distinct()
