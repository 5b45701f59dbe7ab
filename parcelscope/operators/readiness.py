"""Conditional completeness, per-order readiness, missing reasons and the cohort funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.columns import n_if, rnd
from parcelscope.operators.joins import presence_join

PHYSICAL = ["product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]
READY_FLAGS = ["has_items", "item_core_complete", "all_products_resolved", "all_categories_known",
               "all_physical_known", "all_sellers_resolved", "all_sellers_geo", "has_payment",
               "customer_resolved", "customer_geo"]


def exposure(task: DataFrame, t) -> DataFrame:
    """Task items with product, seller and geography resolution tags (item grain)."""
    zips = t.geolocation.select(F.col("geolocation_zip_code_prefix").alias("seller_zip_code_prefix")).distinct()
    s = presence_join(t.sellers.select("seller_id", "seller_zip_code_prefix"), zips, ["seller_zip_code_prefix"], "seller_geo")
    p = t.products.select("product_id", F.col("product_category_name").isNull().alias("category_missing"),
                          F.greatest(*[F.col(k).isNull() for k in PHYSICAL]).alias("physical_missing"))
    d = t.items.join(task.select("order_id", "purchase_month"), "order_id")
    d = presence_join(d, p, ["product_id"], "product_resolved")
    return presence_join(d, s.drop("seller_zip_code_prefix"), ["seller_id"], "seller_resolved")


def order_readiness(task: DataFrame, t) -> DataFrame:
    """Ten nullable-safe flags per task order (missing relation = false)."""
    e = exposure(task, t)
    core = F.col("product_id").isNotNull() & F.col("seller_id").isNotNull() & F.col("price").isNotNull() & F.col("freight_value").isNotNull()
    per = e.groupBy("order_id").agg(
        F.lit(True).alias("has_items"), F.bool_and(core).alias("item_core_complete"),
        F.bool_and("product_resolved").alias("all_products_resolved"),
        F.bool_and(F.col("product_resolved") & ~F.coalesce("category_missing", F.lit(True))).alias("all_categories_known"),
        F.bool_and(F.col("product_resolved") & ~F.coalesce("physical_missing", F.lit(True))).alias("all_physical_known"),
        F.bool_and("seller_resolved").alias("all_sellers_resolved"),
        F.bool_and(F.coalesce("seller_geo", F.lit(False))).alias("all_sellers_geo"))
    pay = t.payments.select("order_id").distinct()
    zips = t.geolocation.select(F.col("geolocation_zip_code_prefix").alias("customer_zip_code_prefix")).distinct()
    cu = presence_join(t.customers.select("customer_id", "customer_zip_code_prefix"), zips,
                       ["customer_zip_code_prefix"], "customer_geo").drop("customer_zip_code_prefix")
    d = task.select("order_id", "customer_id", "purchase_month").join(per, "order_id", "left")
    d = presence_join(presence_join(d, pay, ["order_id"], "has_payment"), cu, ["customer_id"], "customer_resolved")
    return d.select("order_id", "purchase_month", *[F.coalesce(F.col(k), F.lit(False)).cast("int").alias(k) for k in READY_FLAGS])


def readiness_summary(ready: DataFrame, by: list[str]) -> DataFrame:
    """Ready orders and percent per flag (and month when asked)."""
    long = ready.groupBy(*by).agg(F.count(F.lit(1)).alias("orders"), *[F.sum(k).alias(k) for k in READY_FLAGS])
    out = long.unpivot([*by, "orders"], READY_FLAGS, "readiness", "ready")
    return out.withColumn("ready_pct", rnd(100 * F.col("ready") / F.col("orders")))


def conditional_completeness(e: DataFrame) -> DataFrame:
    """Category and physical completeness over items, products, orders and sellers that resolve."""
    r = e.filter("product_resolved")
    item = r.agg(F.lit("TASK_ITEM_EXPOSURE").alias("scope"), F.count(F.lit(1)).alias("denominator"),
                 n_if(F.col("category_missing")).alias("category_missing"), n_if(F.col("physical_missing")).alias("physical_missing"))

    def at(key, scope):
        g = r.groupBy(key).agg(F.bool_or("category_missing").alias("c"), F.bool_or("physical_missing").alias("p"))
        return g.agg(F.lit(scope).alias("scope"), F.count(F.lit(1)).alias("denominator"),
                     n_if(F.col("c")).alias("category_missing"), n_if(F.col("p")).alias("physical_missing"))
    return (item.unionByName(at("product_id", "TASK_UNIQUE_PRODUCT")).unionByName(at("order_id", "TASK_ORDER"))
            .unionByName(at("seller_id", "TASK_UNIQUE_SELLER")))


def _reason(component: str, scope: str, state: str, missing, among):
    return F.struct(F.lit(component).alias("component"), F.lit(scope).alias("scope"), F.lit(state).alias("state"),
                    n_if(missing).alias("n"), n_if(among).alias("denominator"))


def missing_reasons(ready: DataFrame, e: DataFrame) -> DataFrame:
    """Component, scope and state (relation or attribute missing) with its own denominator."""
    every, cr = F.lit(True), F.col("customer_resolved") == 1
    pr, sr = F.col("product_resolved"), F.col("seller_resolved")
    order_rows = F.array(
        _reason("order_items", "TASK_ORDER", "RELATION_MISSING", F.col("has_items") == 0, every),
        _reason("payments", "TASK_ORDER", "RELATION_MISSING", F.col("has_payment") == 0, every),
        _reason("customer", "TASK_ORDER", "RELATION_MISSING", ~cr, every),
        _reason("customer_geolocation", "TASK_ORDER", "RELATION_MISSING", cr & (F.col("customer_geo") == 0), cr))
    item_rows = F.array(
        _reason("product", "TASK_ITEM", "RELATION_MISSING", ~pr, every),
        _reason("product_category", "TASK_ITEM", "ATTRIBUTE_MISSING", pr & F.col("category_missing"), pr),
        _reason("product_physical", "TASK_ITEM", "ATTRIBUTE_MISSING", pr & F.col("physical_missing"), pr),
        _reason("seller", "TASK_ITEM", "RELATION_MISSING", ~sr, every),
        _reason("seller_geolocation", "TASK_ITEM", "RELATION_MISSING", sr & ~F.col("seller_geo"), sr))
    rows = (ready.agg(order_rows.alias("a")).select(F.inline("a"))
            .unionByName(e.agg(item_rows.alias("a")).select(F.inline("a"))))
    return rows.withColumn("pct", rnd(100 * F.col("n") / F.nullif("denominator", F.lit(0))))


def funnel(orders: DataFrame, ready: DataFrame) -> DataFrame:
    """Nested cohort counts from source orders to fully ready task orders."""
    from parcelscope.operators.gold import DELIVERED, PROMISED, is_delivered
    a = is_delivered()
    b = a & F.col(DELIVERED).isNotNull()
    s = b & F.col(PROMISED).isNotNull() & F.col("order_purchase_timestamp").isNotNull()
    d = orders.join(ready, "order_id", "left")
    i = s & (F.coalesce("has_items", F.lit(0)) == 1)
    full = i & (F.col("customer_geo") == 1) & (F.col("all_sellers_geo") == 1)
    steps = {"source_orders": F.lit(True), "status_delivered": a, "delivery_observed": b, "label_observed": s,
             "with_items": i, "with_geography": full}
    agg = d.agg(*[n_if(v).alias(k) for k, v in steps.items()])
    return agg.unpivot([], list(steps), "step", "orders")
