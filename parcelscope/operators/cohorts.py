"""Cohort aggregates: late rates, calendars, volume bands, monthly history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.functions.columns import c, n_if, ratio, rnd
from parcelscope.operators import ranks


def late_rate_by(df: DataFrame, category: str) -> DataFrame:
    """Late rate per category at order x category grain, with the share of all pairs.

    Pairs are made distinct first; totals come from the small category table.
    """
    pairs = df.select("order_id", category, "late").dropDuplicates(["order_id", category])
    g = pairs.groupBy(category).agg(F.count(F.lit(1)).alias("orders"), F.sum("late").alias("late_orders"))
    total = ranks.attach(g, g.agg(F.sum("orders").alias("_all")), [])
    return total.select(category, "orders", "late_orders",
                        rnd(100 * F.col("late_orders") / F.col("orders")).alias("late_rate_pct"),
                        rnd(100 * F.col("orders") / F.col("_all")).alias("share_pct"))


def rate_by_part(df: DataFrame, part: Column, name: str) -> DataFrame:
    """Orders, late orders and late rate by a calendar part."""
    return df.groupBy(part.alias(name)).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("late").cast("long").alias("late_orders"),
        rnd(100 * F.avg("late")).alias("late_rate_pct"))


# fixed values: upper bounds of the seller volume bands and their names
VOLUME_BANDS = [(1, "1"), (5, "2-5"), (20, "6-20"), (100, "21-100"), (None, ">100")]


def volume_band(n) -> Column:
    out = None
    for top, label in VOLUME_BANDS[:-1]:
        out = F.when(c(n) <= top, label) if out is None else out.when(c(n) <= top, label)
    return out.otherwise(VOLUME_BANDS[-1][1])


def seller_volume_bands(pairs: DataFrame) -> DataFrame:
    """Stability of seller late rates by volume band (pairs: order x seller with label)."""
    per = (pairs.select("order_id", "seller_id", "late").distinct().groupBy("seller_id")
           .agg(F.count(F.lit(1)).alias("orders"), F.sum("late").alias("late_orders")))
    per = per.withColumns({"rate": F.col("late_orders") / F.col("orders"), "band": volume_band("orders")})
    agg = per.groupBy("band").agg(
        F.count(F.lit(1)).alias("sellers"), F.sum("orders").alias("order_pairs"),
        rnd(F.avg("rate")).alias("mean_rate"), rnd(F.stddev_samp("rate")).alias("std_rate"),
        rnd(ratio(F.sum("late_orders"), F.sum("orders"))).alias("pooled_rate"))
    med = ranks.exact_quantiles(per, ["band"], "rate", {"median_rate": 0.5})
    return agg.join(med.select("band", rnd("median_rate").alias("median_rate")), "band")


def monthly_cohort(orders: DataFrame) -> DataFrame:
    """Per purchase month: totals, delivered, observable, coverage and late rate."""
    from parcelscope.operators.gold import DELIVERED, PROMISED, is_delivered
    seen = is_delivered() & F.col(DELIVERED).isNotNull() & F.col(PROMISED).isNotNull()
    late = seen & (F.to_date(DELIVERED) > F.to_date(PROMISED))
    return orders.groupBy(F.date_format("order_purchase_timestamp", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), n_if(is_delivered()).alias("delivered"), n_if(seen).alias("observable"),
        rnd(100 * n_if(seen) / F.count(F.lit(1))).alias("coverage_pct"), n_if(late).alias("late"),
        rnd(100 * ratio(n_if(late), n_if(seen))).alias("late_pct"))


def month_over_month(monthly: DataFrame, value: str) -> DataFrame:
    """Previous month's value and the change; the window runs over the small monthly table."""
    w = Window.orderBy("month")
    return monthly.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))


def current_vs_prior(monthly: DataFrame, min_orders: int = 1000, min_late: int = 200) -> DataFrame:
    """Each month against all months strictly before it (``orders``, ``late`` per month)."""
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    d = monthly.withColumns({"prior_orders": F.coalesce(F.sum("orders").over(w), F.lit(0)),
                             "prior_late": F.coalesce(F.sum("late").over(w), F.lit(0))})
    cur, pri = ratio("late", "orders"), ratio("prior_late", "prior_orders")
    return d.select("month", "orders", "late", "prior_orders", "prior_late",
                    rnd(cur).alias("current_rate"), rnd(pri).alias("prior_rate"),
                    rnd(100 * (cur - pri)).alias("delta_pp"), rnd(cur / F.nullif(pri, F.lit(0.0))).alias("rate_ratio"),
                    F.when((F.col("prior_orders") >= min_orders) & (F.col("prior_late") >= min_late), 1).otherwise(0)
                    .alias("prior_supported"))


def profile_by_class(df: DataFrame, variables: list[str], label: str, quantiles: dict[str, float]) -> DataFrame:
    """n, mean, std and exact quantiles of each variable within each class."""
    long = ranks.melt(df, [label], variables).filter("value is not null")
    keys = ["variable", label]
    a = long.groupBy(*keys).agg(F.count("value").alias("n"), rnd(F.avg("value"), 5).alias("mean"),
                                rnd(F.stddev_samp("value"), 5).alias("std"))
    q = ranks.exact_quantiles(long, keys, "value", quantiles)
    return a.join(q.select(*keys, *[rnd(k, 5).alias(k) for k in quantiles]), keys)
