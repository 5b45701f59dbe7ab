"""Rule tables: availability of columns at prediction time, derived features, grain compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: availability class per (entity, column); "*" stands for every other column of the entity
AVAILABILITY = [
    ("orders", "order_id", "IDENTIFIER_ONLY"), ("orders", "customer_id", "JOIN_KEY_ONLY"),
    ("orders", "order_purchase_timestamp", "DERIVED_SAFE_AT_T0"),
    ("orders", "order_estimated_delivery_date", "DERIVED_SAFE_AT_T0"),
    ("orders", "order_status", "FORBIDDEN_FUTURE"), ("orders", "order_approved_at", "FORBIDDEN_FUTURE"),
    ("orders", "order_delivered_carrier_date", "FORBIDDEN_FUTURE"),
    ("orders", "order_delivered_customer_date", "TARGET_SOURCE_ONLY"),
    ("items", "order_id", "JOIN_KEY_ONLY"), ("items", "order_item_id", "AGGREGATE_SAFE_AT_T0"),
    ("items", "product_id", "JOIN_KEY_ONLY"), ("items", "seller_id", "JOIN_KEY_ONLY"),
    ("items", "shipping_limit_date", "HOLD_PROVENANCE"), ("items", "price", "AGGREGATE_SAFE_AT_T0"),
    ("items", "freight_value", "AGGREGATE_SAFE_AT_T0"), ("customers", "*", "SAFE_CONTEXT_AT_T0"),
    ("sellers", "*", "STATIC_REFERENCE_ASSUMPTION"), ("products", "*", "STATIC_REFERENCE_ASSUMPTION"),
    ("payments", "*", "HOLD_PROVENANCE"), ("reviews", "*", "FORBIDDEN_FUTURE"),
    ("geolocation", "*", "HOLD_DATA_QUALITY"), ("translation", "*", "PRESENTATION_ONLY"),
]
# fixed values: derived features with their sources
DERIVED_FEATURES = [
    ("item_count", "ORDER", "items.order_item_id"), ("unique_product_count", "ORDER", "items.product_id"),
    ("unique_seller_count", "ORDER", "items.seller_id"), ("total_price", "ORDER", "items.price"),
    ("total_freight", "ORDER", "items.freight_value"),
    ("freight_price_ratio", "ORDER", "items.freight_value;items.price"),
    ("purchase_hour", "TEMPORAL", "orders.order_purchase_timestamp"),
    ("promised_lead_days", "PROMISE", "orders.order_purchase_timestamp;orders.order_estimated_delivery_date"),
    ("customer_state", "GEOGRAPHY", "customers.customer_state"),
    ("distance_km", "GEOGRAPHY", "customers.customer_zip_code_prefix;geolocation.geolocation_lat"),
    ("payment_record_count", "PAYMENT", "payments.payment_sequential"),
    ("approval_delay", "PROCESS", "orders.order_purchase_timestamp;orders.order_approved_at"),
    ("delivery_days", "PROCESS", "orders.order_purchase_timestamp;orders.order_delivered_customer_date"),
]
# fixed values: grain of each entity and what an order-level feature must do with it
GRAIN = [("orders", "1 row per order", "DIRECT_GRAIN_MATCH"), ("items", "1 row per item", "CHILD_GRAIN_REQUIRES_AGGREGATION"),
         ("payments", "1 row per payment", "CHILD_GRAIN_REQUIRES_AGGREGATION"),
         ("customers", "1 row per customer_id", "ORDER_SPECIFIC_REFERENCE_JOIN"),
         ("sellers", "1 row per seller_id", "REFERENCE_ENTITY_REQUIRES_ITEM_TO_ORDER_AGGREGATION"),
         ("products", "1 row per product_id", "REFERENCE_ENTITY_REQUIRES_ITEM_TO_ORDER_AGGREGATION"),
         ("geolocation", "1 row per observation", "REFERENCE_OBSERVATION_REQUIRES_CONSOLIDATION"),
         ("reviews", "1 row per review", "POST_OUTCOME_DATA"),
         ("translation", "1 row per category", "PRESENTATION_REFERENCE")]
BLOCKING = ("FORBIDDEN_FUTURE", "TARGET_SOURCE_ONLY")


def column_registry(spark: SparkSession, present: DataFrame) -> DataFrame:
    """Classify each (table_name, column_name, ...) row; an exact rule beats the entity rule."""
    rules = spark.createDataFrame(AVAILABILITY, "table_name string, rule_column string, cls string")
    exact = rules.filter("rule_column <> '*'").select("table_name", F.col("rule_column").alias("column_name"), F.col("cls").alias("_e"))
    whole = rules.filter("rule_column = '*'").select("table_name", F.col("cls").alias("_w"))
    d = present.join(exact, ["table_name", "column_name"], "left").join(whole, "table_name", "left")
    return d.withColumn("availability", F.coalesce("_e", "_w", F.lit("UNCLASSIFIED"))).drop("_e", "_w")


def feature_contract(spark: SparkSession, registry: DataFrame) -> DataFrame:
    """Explode the sources of each derived feature, join their class, decide the feature's status."""
    f = spark.createDataFrame(DERIVED_FEATURES, "feature string, module string, sources string")
    src = f.select("feature", "module", F.explode(F.split("sources", ";")).alias("column_key"))
    r = registry.select(F.concat_ws(".", "table_name", "column_name").alias("column_key"), "availability", "missing")
    j = src.join(r, "column_key", "left")
    hold = F.coalesce(F.col("availability").startswith("HOLD"), F.lit(False))
    g = j.groupBy("module", "feature").agg(
        F.bool_or(F.col("availability").isNull()).alias("unknown"), F.bool_or(F.col("availability").isin(*BLOCKING)).alias("forbidden"),
        F.bool_or(hold).alias("hold"), F.sum("missing").alias("source_missing"))
    status = (F.when(F.col("unknown"), "UNKNOWN_SOURCE").when(F.col("forbidden"), "FORBIDDEN").when(F.col("hold"), "BLOCKED")
              .otherwise("READY"))
    return g.select("module", "feature", status.alias("status"), "source_missing")
