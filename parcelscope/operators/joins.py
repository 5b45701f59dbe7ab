"""Joins with declared cardinality, presence tags, fallback levels and orphan checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.columns import c


class CardinalityError(ValueError):
    """A declared 1:1 or m:1 join does not hold."""


def _repeated(df: DataFrame, keys: list[str]) -> bool:
    return bool(df.groupBy(*keys).count().filter("count > 1").head(1))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                 validate: str = "m:1") -> DataFrame:
    """Join that fails when the declared key uniqueness is broken, so rows never multiply."""
    if validate in ("m:1", "1:1") and _repeated(right, on):
        raise CardinalityError(f"right side repeats {on}")
    if validate in ("1:1", "1:m") and _repeated(left, on):
        raise CardinalityError(f"left side repeats {on}")
    return left.join(right, on, how)


def presence_join(left: DataFrame, right: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Left join with a boolean telling whether the relation exists."""
    r = right.withColumn(flag, F.lit(True))
    return left.join(r, on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def membership_join(left: DataFrame, right: DataFrame, on: list[str], tag: str = "membership") -> DataFrame:
    """Full outer join with both / left_only / right_only."""
    j = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), on, "full")
    m = (F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both")
         .when(F.col("_l").isNotNull(), "left_only").otherwise("right_only"))
    return j.withColumn(tag, m).drop("_l", "_r")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def fallback_join(left: DataFrame, levels: list[tuple[str, DataFrame, list[str]]], values: list[str],
                  level_col: str, test: str) -> DataFrame:
    """Take ``values`` from the first level whose ``test`` column is known; tag the level or MISSING."""
    out = left
    for name, frame, keys in levels:
        out = out.join(frame.select(*keys, *[F.col(v).alias(f"_{name}_{v}") for v in values]), keys, "left")
    known = [(name, F.col(f"_{name}_{test}").isNotNull()) for name, _, _ in levels]

    def choose(pick, otherwise) -> Column:
        return reduce(lambda acc, nk: F.when(nk[1], pick(nk[0])).otherwise(acc), reversed(known), otherwise)

    cols = {v: choose(lambda n, v=v: F.col(f"_{n}_{v}"), F.lit(None)) for v in values}
    out = out.withColumns({**cols, level_col: choose(F.lit, F.lit("MISSING"))})
    return out.drop(*[f"_{name}_{v}" for name, _, _ in levels for v in values])


def top_one(df: DataFrame, keys: list[str], order_desc: list[str], tie_asc: str, keep: list[str]) -> DataFrame:
    """First row per group by descending columns, then the smallest tie column.

    One partial aggregate per group instead of a sorted window, so a large group is combined map-side.
    """
    low = F.min(F.struct(*[(-F.col(x).cast("double")).alias(f"d{i}") for i, x in enumerate(order_desc)],
                         F.col(tie_asc), *[F.col(k) for k in keep if k != tie_asc]))
    return (df.groupBy(*keys).agg(low.alias("_t"))
            .select(*keys, *[F.col("_t")[k].alias(k) for k in keep]))


def crosstab(df: DataFrame, a: str, b: str, a_levels: list, b_levels: list) -> DataFrame:
    """Counts for every listed pair of levels, 0 where absent."""
    grid = df.sparkSession.createDataFrame([(x, y) for x in a_levels for y in b_levels], f"{a} int, {b} int")
    n = df.groupBy(c(a).cast("int").alias(a), c(b).cast("int").alias(b)).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fixed_buckets(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Counts per bucket in a fixed order, 0 where a bucket is empty."""
    base = df.sparkSession.createDataFrame(list(enumerate(order)), f"position int, {col} string")
    n = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return base.join(n, col, "left").withColumn("n", F.coalesce("n", F.lit(0)))
