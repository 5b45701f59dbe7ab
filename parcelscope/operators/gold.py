"""Gold tables: order features, delivery outcomes, supervised cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.columns import day, ratio

PURCHASE, DELIVERED, PROMISED = ("order_purchase_timestamp", "order_delivered_customer_date",
                                 "order_estimated_delivery_date")
CORE_FEATURES = ["item_count", "unique_product_count", "unique_seller_count", "total_price", "mean_price",
                 "max_price", "min_price", "price_range", "total_freight", "mean_freight", "max_freight",
                 "merchandise_plus_freight", "freight_price_ratio"]


def order_core(items: DataFrame) -> DataFrame:
    """Thirteen features per order from its items."""
    p, f = "price", "freight_value"
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.countDistinct("product_id").alias("unique_product_count"),
        F.countDistinct("seller_id").alias("unique_seller_count"),
        F.sum(p).alias("total_price"), F.avg(p).alias("mean_price"),
        F.max(p).alias("max_price"), F.min(p).alias("min_price"),
        (F.max(p) - F.min(p)).alias("price_range"),
        F.sum(f).alias("total_freight"), F.avg(f).alias("mean_freight"), F.max(f).alias("max_freight"),
        (F.sum(p) + F.sum(f)).alias("merchandise_plus_freight"),
        ratio(F.sum(f), F.sum(p)).alias("freight_price_ratio"))


def features_core(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per order; features are NULL when the order has no items."""
    o = orders.select("order_id", F.col(PURCHASE).alias("prediction_time"))
    return (o.join(order_core(items), "order_id", "left")
            .withColumn("has_order_items", F.col("item_count").isNotNull())
            .select("order_id", "prediction_time", "has_order_items", *CORE_FEATURES))


def service_outcomes(orders: DataFrame) -> DataFrame:
    """Calendar-day late label; NULL while the outcome is not observed."""
    seen = F.col(DELIVERED).isNotNull() & F.col(PROMISED).isNotNull()
    return orders.select(
        "order_id", "order_status", DELIVERED, PROMISED, seen.alias("target_observed"),
        F.when(seen, day(DELIVERED) > day(PROMISED)).alias("late_delivery_calendar_day"))


def is_delivered():
    return F.lower(F.trim("order_status")) == "delivered"


def supervised_cohort(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with items, an observed outcome and status delivered.

    Label and prediction time come from the same order row, so the orders are read once and only
    joined to the item aggregate.
    """
    o = (orders.filter(is_delivered() & F.col(DELIVERED).isNotNull() & F.col(PROMISED).isNotNull())
         .select("order_id", F.col(PURCHASE).alias("prediction_time"), (day(DELIVERED) > day(PROMISED)).alias("late_delivery_calendar_day")))
    return o.join(order_core(items), "order_id").withColumn("has_order_items", F.lit(True)).select(
        "order_id", "prediction_time", "has_order_items", *CORE_FEATURES, "late_delivery_calendar_day")


def task_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders with purchase, promise and delivery times known, with day-level helpers."""
    t = orders.filter(is_delivered() & F.col(PURCHASE).isNotNull() & F.col(DELIVERED).isNotNull()
                      & F.col(PROMISED).isNotNull())
    return t.withColumns({
        "late": (day(DELIVERED) > day(PROMISED)).cast("int"),
        "purchase_month": F.date_format(PURCHASE, "yyyy-MM"),
        "lateness_calendar_days": F.datediff(day(DELIVERED), day(PROMISED))})
