"""Column profiles: completeness, numeric and categorical summaries, cardinality, entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.columns import n_if, ratio, rnd
from parcelscope.operators import ranks

PROFILE_PROBS = {"p01": .01, "p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95, "p99": .99}


def completeness(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Missing count and percent per column, one scan."""
    n = F.count(F.lit(1))
    agg = df.agg(n.alias("_n"), *[F.count(k).alias(k) for k in columns])
    long = agg.unpivot(["_n"], columns, "column_name", "present")
    return long.select(F.lit(table).alias("table_name"), "column_name", F.col("_n").alias("n_rows"),
                       (F.col("_n") - F.col("present")).alias("missing"),
                       rnd(100.0 * (F.col("_n") - F.col("present")) / F.nullif("_n", F.lit(0))).alias("missing_pct"))


def graded_completeness(profile: DataFrame, limits: dict[str, tuple[float, str]]) -> DataFrame:
    """Completeness against a per-column limit and severity."""
    lim = F.create_map(*[F.lit(v) for k, (p, s) in limits.items() for v in (k, p)])
    sev = F.create_map(*[F.lit(v) for k, (p, s) in limits.items() for v in (k, s)])
    ok = F.col("missing_pct") <= lim[F.col("column_name")]
    return profile.select("*", F.when(ok, "PASS").otherwise(sev[F.col("column_name")]).alias("status"))


def numeric_profile(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Moments, exact quantiles, IQR fences, MAD outliers, cardinality and dominant share per column.

    The long form is reduced to distinct values with counts before any ranking; moments of shape
    are corrected to the sample estimators.
    """
    long = ranks.melt(df, [], columns)
    key = ["variable"]
    v = "value"
    n = F.count(v)
    nn = n.cast("double")
    base = long.groupBy("variable").agg(
        n.alias("n"), (F.count(F.lit(1)) - n).alias("missing"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.when(nn > 2, F.skewness(v) * F.sqrt(nn * (nn - 1)) / (nn - 2)).alias("skew"),
        F.when(nn > 3, ((nn + 1) * F.kurtosis(v) + 6) * (nn - 1) / ((nn - 2) * (nn - 3))).alias("kurtosis"))
    d = ranks.distinct_counts(long, key, v)
    q = ranks.quantiles_of_counts(d, key, v, {**PROFILE_PROBS, "median": .5})
    mm = ranks.quantiles_of_counts(ranks.deviation_counts(d, q, key, v, "median"), key, "_dev", {"mad": .5})
    card = d.groupBy("variable").agg(F.count(F.lit(1)).alias("unique_values"), F.max("_n").alias("_top"))
    stats = base.join(q, key).join(mm, key).join(card, key)
    iqr = F.col("p75") - F.col("p25")
    fences = stats.select("variable", (F.col("p25") - 1.5 * iqr).alias("_lo"), (F.col("p75") + 1.5 * iqr).alias("_hi"),
                          "median", "mad")
    o = d.join(fences, key)
    z = F.abs(0.6745 * (F.col(v) - F.col("median")) / F.nullif("mad", F.lit(0.0)))
    tails = o.groupBy("variable").agg(
        F.sum(F.when((F.col(v) < F.col("_lo")) | (F.col(v) > F.col("_hi")), F.col("_n")).otherwise(0)).alias("iqr_outliers"),
        F.sum(F.when(z > 3.5, F.col("_n")).otherwise(0)).alias("mad_outliers"))
    out = stats.join(tails, key)
    return out.select(F.lit(table).alias("table_name"), "variable", "n", "missing", "unique_values",
                      *[rnd(k, 4).alias(k) for k in ("mean", "std", "min", "max", "skew", "kurtosis", "mad", *PROFILE_PROBS)],
                      rnd(100 * ratio("_top", "n"), 4).alias("dominant_pct"), "iqr_outliers", "mad_outliers")


def categorical_frequency(df: DataFrame, col: str) -> DataFrame:
    """Rows and share per level; the total comes from the level table."""
    g = df.groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    d = ranks.attach(g, g.agg(F.sum("n").alias("_all")), [])
    return d.select("level", "n", rnd(100 * F.col("n") / F.col("_all")).alias("share_pct"))


def categorical_profile(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Per column: missing, levels, dominant share, singleton levels, Shannon entropy in bits."""
    long = df.unpivot([], [F.col(k).cast("string").alias(k) for k in columns], "variable", "level")
    lv = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    tot = lv.filter("level is not null").groupBy("variable").agg(F.sum("n").alias("_all"))
    p = F.col("n") / F.col("_all")
    known = F.col("level").isNotNull()
    return lv.join(tot, "variable").groupBy("variable").agg(
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("missing"), n_if(known).alias("levels"),
        F.max(F.when(known, F.col("n"))).alias("dominant_n"), n_if(known & (F.col("n") == 1)).alias("singletons"),
        rnd(100 * F.max(F.when(known, p))).alias("dominant_pct"),
        rnd(-F.sum(F.when(known, p * F.log2(p)))).alias("entropy_bits"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("a"), "level")))["level"].alias("top_level"),
    ).withColumn("table_name", F.lit(table))


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Length statistics of text columns."""
    long = df.unpivot([], [F.col(k).cast("string").alias(k) for k in columns], "variable", "s").filter("s is not null")
    return long.groupBy("variable").agg(F.min(F.length("s")).alias("min_len"), F.max(F.length("s")).alias("max_len"),
                                        rnd(F.avg(F.length("s"))).alias("mean_len"))


def identifier_cardinality(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Distinct values and unique ratio per identifier, via one (column, value) shuffle."""
    long = df.unpivot([], [F.col(k).cast("string").alias(k) for k in columns], "column_name", "v")
    g = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.count("v").alias("distinct_values"),
        rnd(F.count("v") / F.sum("n")).alias("unique_ratio")).withColumn("table_name", F.lit(table))


def near_constant(df: DataFrame, columns: list[str], table: str, limit_pct: float) -> DataFrame:
    """Variables with at most one value, or whose most frequent value has at least ``limit_pct`` percent of the non-null rows."""
    d = ranks.distinct_counts(ranks.melt(df, [], columns), ["variable"], "value").groupBy("variable")
    share = 100.0 * F.max("_n") / F.sum("_n")
    d = d.agg(F.count(F.lit(1)).alias("distinct_n"), share.alias("s"))
    flag = (F.col("distinct_n") <= 1) | (F.col("s") >= limit_pct)
    return d.select(F.lit(table).alias("table_name"), "variable", "distinct_n", rnd("s").alias("dominant_pct"), flag.cast("int").alias("near_constant"))
