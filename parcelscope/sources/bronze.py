"""Raw and typed sources, inventories, file contracts and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope.functions.columns import not_blank
from parcelscope.sources.snapshots import listed_files

# fixed values: column types of the typed entities
SILVER_TYPES: dict[str, dict[str, str]] = {
    "orders": dict(order_id="string", customer_id="string", order_status="string", order_purchase_timestamp="timestamp_ntz",
                   order_approved_at="timestamp_ntz", order_delivered_carrier_date="timestamp_ntz",
                   order_delivered_customer_date="timestamp_ntz", order_estimated_delivery_date="timestamp_ntz"),
    "order_items": dict(order_id="string", order_item_id="bigint", product_id="string", seller_id="string",
                        shipping_limit_date="timestamp_ntz", price="double", freight_value="double"),
    "customers": dict(customer_id="string", customer_unique_id="string", customer_zip_code_prefix="string",
                      customer_city="string", customer_state="string"),
    "sellers": dict(seller_id="string", seller_zip_code_prefix="string", seller_city="string", seller_state="string"),
    "products": dict(product_id="string", product_category_name="string", product_name_lenght="bigint",
                     product_description_lenght="bigint", product_photos_qty="bigint", product_weight_g="double",
                     product_length_cm="double", product_height_cm="double", product_width_cm="double"),
    "payments": dict(order_id="string", payment_sequential="bigint", payment_type="string", payment_installments="bigint",
                     payment_value="double"),
    "reviews": dict(review_id="string", order_id="string", review_score="bigint", review_comment_title="string",
                    review_comment_message="string", review_creation_date="timestamp_ntz", review_answer_timestamp="timestamp_ntz"),
    "geolocation": dict(geolocation_zip_code_prefix="string", geolocation_lat="double", geolocation_lng="double",
                        geolocation_city="string", geolocation_state="string"),
    "product_category_translation": dict(product_category_name="string", product_category_name_english="string"),
}
#: Entities whose text fields hold line breaks; files of all others can be split.
_BROKEN_LINES = {"reviews"}


def bronze_scan(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Header CSV as strings with the source file name; a byte-order mark on the header is ignored."""
    names = list(SILVER_TYPES[entity])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (spark.read.option("header", True).option("enforceSchema", True).option("multiLine", entity in _BROKEN_LINES)
            .option("escape", '"').schema(schema).csv(path)
            .withColumn("_source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)))


def to_bronze(df: DataFrame, source: str) -> DataFrame:
    """Any frame as an all-string bronze table; NULL is kept."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns],
                     F.lit(source).alias("_source_file"))


def silver_type(bronze: DataFrame, entity: str) -> DataFrame:
    """Typed projection; blank or bad text becomes NULL."""
    spec = SILVER_TYPES[entity]
    return bronze.select(*[(F.col(n) if t == "string" else not_blank(n).try_cast(t)).alias(n)
                           for n, t in spec.items() if n in bronze.columns])


class MissingColumns(ValueError):
    """A required column is absent."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail if a column is absent, then prune to the required ones."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise MissingColumns(f"missing columns: {absent}")
    return df.select(*columns)


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    parts = [d.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(d.columns)).alias("n_columns"))
             for name, d in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def file_contract(spark: SparkSession, path: str, expected: list[str], pattern: str = "*") -> DataFrame:
    """Expected, missing and extra files of a folder."""
    have = listed_files(spark, path, pattern).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    want = spark.createDataFrame([(e,) for e in expected], "file_name string")
    from parcelscope.operators.joins import membership_join
    j = membership_join(want, have, ["file_name"])
    return j.select("file_name", F.when(F.col("membership") == "both", "PRESENT")
                    .when(F.col("membership") == "left_only", "MISSING").otherwise("EXTRA").alias("state"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a folder (the old files go first; ``snapshots.replace_table`` keeps them until the new ones are whole); CSV gets a header."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
