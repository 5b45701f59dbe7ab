"""Business entities (silver-shaped) derived from the given order tables by key arithmetic.

The given tables carry no promise or delivery times, zip codes or payments, so those columns are
deterministic integer expressions on the keys. Nothing is sampled: each entity has one row per
source row (payments and geolocation: one to three).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.session import stage


def _sec(x: str) -> str:
    return f"make_dt_interval(0, 0, 0, {x})"


def _days(x: str) -> str:
    return f"make_dt_interval(cast({x} as int), 0, 0, 0)"


class Tables:
    """Lazy DataFrames for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def stage(self, name: str, build, by: str | None = None) -> DataFrame:
        """Shared intermediate table of this folder (see ``session.stage``)."""
        return stage(self.spark, self.dir, name, build, by)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        p = self.raw("orders").selectExpr(
            "o_orderkey as order_id", "o_custkey as customer_id",
            f"o_orderdate + {_sec('(o_orderkey * 7919) % 86400')} as order_purchase_timestamp",
            "case when o_orderkey % 50 = 0 then 'canceled' when o_orderkey % 37 = 0 then 'unavailable'"
            " when o_orderkey % 29 = 0 then 'shipped' else 'delivered' end as order_status")
        ts = "order_purchase_timestamp"
        return p.selectExpr(
            "order_id", "customer_id", "order_status", ts,
            f"case when order_id % 97 != 0 then {ts} + {_sec('(order_id * 31) % 7200')} end as order_approved_at",
            f"{ts} + {_sec('86400 + (order_id * 104729) % 172800')} as order_delivered_carrier_date",
            f"case when order_status = 'delivered' or order_id % 600 = 0 then {ts} + "
            f"{_sec('172800 + (order_id * 1299709) % 1728000')} end as order_delivered_customer_date",
            f"cast(cast({ts} as date) as timestamp_ntz) + {_days('12 + order_id % 13')}"
            " as order_estimated_delivery_date")

    @cached_property
    def items(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey as order_id", "cast(l_linenumber as bigint) as order_item_id",
            "l_partkey as product_id", "l_suppkey as seller_id", "l_shipdate as shipping_limit_date",
            "l_extendedprice as price",
            "((cast(round(l_extendedprice * 100) as bigint) * cast(round(l_tax * 100) as bigint)) div 100)"
            " / 100.0D as freight_value")

    def _party(self, table: str, p: str, out: str) -> DataFrame:
        d = self.raw(table).selectExpr(f"{p}_{'custkey' if p == 'c' else 'suppkey'} as k",
                                       f"{p}_nationkey as nk")
        n = self.raw("nation").selectExpr("n_nationkey as nk", "n_name as nation")
        return d.join(n, "nk", "left").selectExpr(
            f"k as {out}_id", f"lpad(cast(k % 5000 as string), 5, '0') as {out}_zip_code_prefix",
            f"concat(nation, ' city ', k % 7) as {out}_city",
            f"case when k % 83 != 0 then nation end as {out}_state")

    @cached_property
    def customers(self) -> DataFrame:
        return self._party("customer", "c", "customer").withColumn(
            "customer_unique_id", F.expr("customer_id div 2"))

    @cached_property
    def sellers(self) -> DataFrame:
        return self._party("supplier", "s", "seller")

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey as product_id",
            "case when p_partkey % 61 != 0 then p_type end as product_category_name",
            "10 + p_partkey % 50 as product_name_lenght",
            "100 + p_partkey % 900 as product_description_lenght",
            "p_partkey % 6 as product_photos_qty",
            "case when p_partkey % 53 = 0 then null when p_partkey % 101 = 0 then 0.0D"
            " else p_size * 100.0D end as product_weight_g",
            "case when p_partkey % 59 != 0 then cast(10 + p_size % 13 as double) end as product_length_cm",
            "cast(10 + p_size % 7 as double) as product_height_cm",
            "cast(10 + p_size % 11 as double) as product_width_cm")

    @cached_property
    def payments(self) -> DataFrame:
        item_cents = self.items.groupBy("order_id").agg(
            F.sum(F.expr("cast(round(price * 100) as bigint) + cast(round(freight_value * 100) as bigint)"))
            .alias("item_cents"))
        o = self.raw("orders").selectExpr("o_orderkey as order_id",
                                          "cast(round(o_totalprice * 100) as bigint) as order_cents")
        paid = o.join(item_cents, "order_id", "left").selectExpr(
            "order_id",
            "coalesce(item_cents, order_cents) + case order_id % 10 when 7 then 1 when 8 then 50"
            " when 9 then 500 else 0 end as cents").filter("order_id % 1499 != 0")
        seqs = paid.selectExpr(
            "*", "explode(case when order_id % 5 = 0 then sequence(1, 2) else sequence(1, 1) end) as s")
        return seqs.selectExpr(
            "order_id", "cast(s as bigint) as payment_sequential",
            "case (order_id + s) % 5 when 0 then 'credit_card' when 1 then 'boleto' when 2 then 'voucher'"
            " when 3 then 'debit_card' else 'not_defined' end as payment_type",
            "(order_id * 7 + s) % 11 as payment_installments",
            "(case when order_id % 5 != 0 then cents when s = 1 then cents div 3 else cents - cents div 3 end)"
            " / 100.0D as payment_value")

    @cached_property
    def reviews(self) -> DataFrame:
        return self.orders.filter("order_id % 13 != 0").selectExpr(
            "order_id * 2 as review_id", "order_id", "1 + order_id % 5 as review_score",
            "case when order_id % 3 = 0 then concat('title ', order_id % 11) end as review_comment_title",
            f"order_purchase_timestamp + {_days('20')} as review_creation_date",
            f"order_purchase_timestamp + {_days('22')} as review_answer_timestamp")

    @cached_property
    def geolocation(self) -> DataFrame:
        zips = (self.raw("customer").selectExpr("c_custkey % 5000 as z")
                .union(self.raw("supplier").selectExpr("s_suppkey % 5000 as z")).distinct())
        g = zips.filter("z % 89 != 0").selectExpr("z", "explode(sequence(0, 2)) as i")
        return g.selectExpr(
            "lpad(cast(z as string), 5, '0') as geolocation_zip_code_prefix",
            "case when z % 71 = 0 and i = 1 then 95.0D else"
            " -33 + ((z * 7919) % 3900) / 100.0D + (i * (z % 4)) * 0.01D end as geolocation_lat",
            "-72 + ((z * 104729) % 3900) / 100.0D + (i * (z % 4)) * 0.01D as geolocation_lng",
            "concat('city ', z % 7) as geolocation_city",
            "concat('NATION_', case when z % 97 = 0 and i = 2 then (z + 1) % 25 else z % 25 end)"
            " as geolocation_state")

    @cached_property
    def translation(self) -> DataFrame:
        return (self.raw("part").selectExpr("p_type as product_category_name").distinct()
                .filter("length(product_category_name) % 2 = 0")
                .withColumn("product_category_name_english", F.lower("product_category_name")))

    @cached_property
    def municipal(self) -> DataFrame:
        """Population and GDP by year and municipality, one row per place seen among customers."""
        place = (self.customers.filter("customer_state is not null")
                 .selectExpr("customer_state as uf", "customer_city as city").distinct())
        return (place.withColumn("year", F.expr("explode(sequence(1995, 2001))"))
                .withColumn("k", F.expr("length(uf) * 1000 + cast(right(city, 1) as int) * 37 +"
                                        " cast(substring(uf, 8) as int) * 101"))
                .selectExpr("cast(year as bigint) as year", "uf", "city", "cast(k as string) as id_municipio",
                            "case when k % 19 != 0 then cast(20000 + k * 13 + (year - 1995) * 500 as bigint) end"
                            " as population",
                            "case when k % 23 != 0 then (k * 7919 + (year - 1995) * 100000) * 1.0D end"
                            " as gdp_current"))

    @cached_property
    def fuel(self) -> DataFrame:
        """Fuel price survey rows by month and place (one per order with a known customer state)."""
        o = self.orders.select("order_id", "customer_id", "order_purchase_timestamp")
        cu = self.customers.filter("customer_state is not null and customer_id % 7 != 3")
        return o.join(cu, "customer_id").selectExpr(
            "cast(year(order_purchase_timestamp) as bigint) as year",
            "cast(month(order_purchase_timestamp) as bigint) as month",
            "customer_state as uf", "customer_city as city",
            "case order_id % 4 when 0 then 'OLEO DIESEL' when 1 then 'DIESEL S10' when 2 then 'OLEO DIESEL S10'"
            " else 'GASOLINA' end as product",
            "3 + ((order_id * 37) % 200) / 100.0D as mean_price", "order_id % 6 as n_posts")
