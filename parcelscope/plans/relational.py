"""Sources (A), relational operators (B), aggregations and gold tables (C)."""

import zlib

from pyspark.sql import functions as F

from parcelscope.functions import columns as x
from parcelscope.functions.columns import rnd
from parcelscope.operators import cohorts, gold, joins, ranks
from parcelscope.plans.registry import query
from parcelscope.session import checkpoint_dir
from parcelscope.sources import bronze, snapshots

TABLES = ["orders", "items", "customers", "sellers", "products", "payments", "reviews", "geolocation", "translation"]


# ---------------------------------------------------------------- A sources
@query("a1_bronze_orders", """
select cast(order_id as varchar) order_id, cast(customer_id as varchar) customer_id, order_status,
  'orders.csv' _source_file from e_orders""")
def _(t):
    return bronze.to_bronze(t.orders.select("order_id", "customer_id", "order_status"), "orders.csv")


def _dirty_items(t):
    """Bronze items whose text carries blanks and bad numbers at fixed keys."""
    b = bronze.to_bronze(t.items, "items.csv")
    return b.withColumn("price", F.expr("case when cast(order_id as bigint) % 401 = 0 then ''"
                                        " when cast(order_id as bigint) % 397 = 0 then 'n/a' else price end"))


_DIRTY = """(select order_id, order_item_id, product_id, seller_id, freight_value,
  case when order_id % 401 = 0 then '' when order_id % 397 = 0 then 'n/a' else cast(price as varchar) end price from e_items)"""


@query("a2_silver_items", f"""
select cast(order_id as varchar) order_id, order_item_id, try_cast(nullif(price, '') as double) price, freight_value
from {_DIRTY}""")
def _(t):
    return bronze.silver_type(_dirty_items(t), "order_items").select("order_id", "order_item_id", "price", "freight_value")


@query("a2_silver_orders_parsed", """
select count(*) n, count(order_approved_at) n_approved, count(order_delivered_customer_date) n_delivered,
  cast(sum(epoch_us(order_purchase_timestamp) // 1000000) as bigint) sum_purchase_s from e_orders""")
def _(t):
    s = bronze.silver_type(bronze.to_bronze(t.orders, "orders.csv"), "orders")
    return s.agg(F.count(F.lit(1)).alias("n"), F.count("order_approved_at").alias("n_approved"),
                 F.count("order_delivered_customer_date").alias("n_delivered"),
                 F.sum(F.expr("unix_micros(cast(order_purchase_timestamp as timestamp)) div 1000000")).alias("sum_purchase_s"))


@query("a3_read_required", "select order_id, price, freight_value from e_items")
def _(t):
    return bronze.require_columns(t.items, ["order_id", "price", "freight_value"])


@query("a4_source_inventory", " union all ".join(
    f"select '{n}' table_name, (select count(*) from e_{n}) n_rows, {k} n_columns"
    for n, k in zip(TABLES, [8, 7, 5, 4, 9, 5, 6, 5, 2], strict=True)))
def _(t):
    return bronze.table_inventory({n: getattr(t, n) for n in TABLES})


@query("a4_source_file_hashes")
def _(t):
    return snapshots.file_digests(t.spark, t.dir, "*.parquet")


def _scratch(t, name):
    """A folder for tables written by a query, inside the session's checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/tables/{zlib.crc32(t.dir.encode()):08x}/{name}"


@query("a1_bronze_csv_scan", """
select order_id, order_item_id, product_id, price, freight_value from (select cast(order_id as varchar) order_id, order_item_id, cast(product_id as varchar) product_id, price, freight_value from e_items)""")
def _(t):
    path = _scratch(t, "order_items_csv")
    cols = list(bronze.SILVER_TYPES["order_items"])
    bronze.write_table(t.items.select(*[F.col(k).cast("string").alias(k) for k in cols]), path, "csv")
    s = bronze.silver_type(bronze.bronze_scan(t.spark, path, "order_items"), "order_items")
    return s.select("order_id", "order_item_id", "product_id", "price", "freight_value")


@query("a5_write_table", "select order_id, target_observed, late_delivery_calendar_day from o_outcomes")
def _(t):
    path = _scratch(t, "delivery_service_outcomes")
    bronze.write_table(gold.service_outcomes(t.orders), path)
    return t.spark.read.parquet(path).select("order_id", "target_observed", "late_delivery_calendar_day")


@query("a5_replace_table", "select order_id, target_observed, late_delivery_calendar_day from o_outcomes")
def _(t):
    """The table is replaced by a changed copy of itself; the version before it is read back, and its missing rows are added."""
    path = _scratch(t, "replaced_outcomes")
    columns = ["order_id", "target_observed", "late_delivery_calendar_day"]
    snapshots.replace_table(gold.service_outcomes(t.orders).select(*columns), path)
    snapshots.replace_table(snapshots.read_table(t.spark, path).filter("target_observed"), path)
    now, before = (snapshots.read_table(t.spark, path, back=b) for b in (0, 1))
    return now.unionByName(before.join(now.select("order_id"), "order_id", "left_anti"))


@query("a6_numeric_coercion", f"""
select count(*) n, count(*) filter (nullif(price, '') is not null) n_text, count(try_cast(nullif(price, '') as double)) n_number
from {_DIRTY}""")
def _(t):
    return _dirty_items(t).agg(F.count(F.lit(1)).alias("n"), F.count(x.not_blank("price")).alias("n_text"),
                               F.count(x.try_number(x.not_blank("price"))).alias("n_number"))


@query("a6_datetime_coercion", """
select count(*) n, count(try_cast(v as timestamp)) n_time from
 (select case when order_id % 211 = 0 then 'not a date' else strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') end v from e_orders)""")
def _(t):
    v = t.orders.select(F.expr("case when order_id % 211 = 0 then 'not a date' else"
                               " date_format(order_purchase_timestamp, 'yyyy-MM-dd HH:mm:ss') end").alias("v"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.count(x.try_ts("v")).alias("n_time"))


@query("a7_dataset_file_contract")
def _(t):
    want = [f"{n}.parquet" for n in ("orders", "lineitem", "customer", "supplier", "part", "returns")]
    return bronze.file_contract(t.spark, t.dir, want, "*.parquet")


# ---------------------------------------------------------------- B relational
@query("b1_checked_join", """
select order_id, customer_state, order_status from e_orders left join e_customers using (customer_id)""")
def _(t):
    return joins.checked_join(t.orders, t.customers, ["customer_id"]).select("order_id", "customer_state", "order_status")


@query("b2_gold_outcome_join", """
select order_id, item_count, target_observed from o_features join o_outcomes using (order_id)""")
def _(t):
    f = gold.features_core(t.orders, t.items).select("order_id", "item_count")
    return f.join(gold.service_outcomes(t.orders).select("order_id", "target_observed"), "order_id")


@query("b3_relation_presence", """
select order_id, cast(order_id in (select order_id from e_items) as int) has_order_items from e_orders""")
def _(t):
    p = joins.presence_join(t.orders.select("order_id"), t.items.select("order_id").distinct(), ["order_id"], "has")
    return p.select("order_id", F.col("has").cast("int").alias("has_order_items"))


@query("b4_orphan_detection", """
select count(*) orphan_rows, count(distinct order_id) orphan_keys from e_orders o
where not exists (select 1 from e_items i where i.order_id = o.order_id)""")
def _(t):
    return joins.orphans(t.orders.select("order_id"), t.items, "order_id").agg(
        F.count(F.lit(1)).alias("orphan_rows"), F.countDistinct("order_id").alias("orphan_keys"))


@query("b5_semi_join", "select order_id, price from e_items where order_id in (select order_id from o_task)")
def _(t):
    return t.items.join(gold.task_orders(t.orders).select("order_id"), "order_id", "left_semi").select("order_id", "price")


_PAID = "(select distinct order_id from e_payments)"
_ITEM = "(select distinct order_id from e_items where order_id % 11 != 0)"


@query("b6_membership_full_join", f"""
select case when p.order_id is not null and i.order_id is not null then 'both' when p.order_id is not null then 'left_only'
  else 'right_only' end membership, count(*) n from {_PAID} p full join {_ITEM} i on p.order_id = i.order_id group by 1""")
def _(t):
    i = t.items.filter("order_id % 11 != 0").select("order_id").distinct()
    m = joins.membership_join(t.payments.select("order_id").distinct(), i, ["order_id"])
    return m.groupBy("membership").agg(F.count(F.lit(1)).alias("n"))


@query("b7_resolved_join", """
select count(*) n, count(p.product_id) resolved from e_items i left join
 (select product_id from e_products where product_id % 17 != 0) p using (product_id)""")
def _(t):
    p = t.products.filter("product_id % 17 != 0").select("product_id")
    r = joins.presence_join(t.items, p, ["product_id"], "product_resolved")
    return r.agg(F.count(F.lit(1)).alias("n"), x.n_if(F.col("product_resolved")).alias("resolved"))


_CITY_LEVEL = "(select uf, city, min(population) population from e_municipal where year = 2000 and uf <> 'NATION_3' and population is not null group by 1, 2)"
_STATE_LEVEL = "(select uf, min(population) population from e_municipal where year = 2000 and uf <> 'NATION_4' group by 1)"


@query("b8_fallback_join", f"""
select c.customer_id, coalesce(a.population, b.population) population,
  case when a.population is not null then 'CITY' when b.population is not null then 'STATE' else 'MISSING' end level
from e_customers c left join {_CITY_LEVEL} a on a.uf = customer_state and a.city = customer_city
left join {_STATE_LEVEL} b on b.uf = customer_state""")
def _(t):
    m = t.municipal.filter("year = 2000")
    city = m.filter("uf <> 'NATION_3' and population is not null").groupBy("uf", "city").agg(F.min("population").alias("population"))
    state = m.filter("uf <> 'NATION_4'").groupBy("uf").agg(F.min("population").alias("population"))
    left = t.customers.select("customer_id", F.col("customer_state").alias("uf"), F.col("customer_city").alias("city"))
    out = joins.fallback_join(left, [("CITY", city, ["uf", "city"]), ("STATE", state, ["uf"])],
                              ["population"], "level", "population")
    return out.select("customer_id", "population", "level")


@query("b9_primary_seller", """
select order_id, seller_id, round(freight, 4) freight from (select *, row_number() over (partition by order_id order by freight desc, price desc, seller_id) rn
 from (select order_id, seller_id, cast(sum(cast(round(freight_value*100) as bigint)) as bigint)/100.0 freight, cast(sum(cast(round(price*100) as bigint)) as bigint)/100.0 price from e_items group by 1, 2)) where rn = 1""")
def _(t):
    pair = t.items.groupBy("order_id", "seller_id").agg(
        *[(F.sum(F.round(F.col(k) * 100).cast("long")) / 100.0).alias(n) for k, n in (("freight_value", "freight"), ("price", "price"))])
    top = joins.top_one(pair, ["order_id"], ["freight", "price"], "seller_id", ["seller_id", "freight"])
    return top.select("order_id", "seller_id", rnd("freight", 4).alias("freight"))


@query("b10_first_per_key", "select customer_unique_id, min(customer_id) customer_id from e_customers group by 1")
def _(t):
    return t.customers.groupBy("customer_unique_id").agg(F.min("customer_id").alias("customer_id"))


@query("b11_union_all", """
select party, count(*) n from (select 'customer' party, customer_state s from e_customers union all select 'seller', seller_state from e_sellers)
where s is not null group by 1""")
def _(t):
    a = t.customers.select(F.lit("customer").alias("party"), F.col("customer_state").alias("s"))
    b = t.sellers.select(F.lit("seller").alias("party"), F.col("seller_state").alias("s"))
    return a.unionByName(b).filter("s is not null").groupBy("party").agg(F.count(F.lit(1)).alias("n"))


@query("b12_domain_difference", """
select distinct product_category_name from e_products where product_category_name is not null
except select product_category_name from e_translation""")
def _(t):
    have = t.products.filter("product_category_name is not null").select("product_category_name").distinct()
    return have.subtract(t.translation.select("product_category_name"))


_FUEL_TYPE = "case when product like '%S10%' then 'S10' when product like '%DIESEL%' then 'COMMON' end"


@query("b13_pivot", f"""
select year, uf, round(avg(mean_price) filter (k = 'COMMON'), 8) common, round(avg(mean_price) filter (k = 'S10'), 8) s10
from (select *, {_FUEL_TYPE} k from e_fuel) where k is not null group by 1, 2""")
def _(t):
    f = t.fuel.withColumn("k", F.expr(_FUEL_TYPE)).filter("k is not null")
    p = f.groupBy("year", "uf").pivot("k", ["COMMON", "S10"]).agg(F.avg("mean_price"))
    return p.select("year", "uf", rnd("COMMON", 8).alias("common"), rnd("S10", 8).alias("s10"))


_STRICT = "cast(order_delivered_customer_date > order_estimated_delivery_date as int)"


@query("b14_crosstab", f"""
select strict, late, count(n.order_id) n from (values (0,0),(0,1),(1,0),(1,1)) g(strict, late)
left join (select order_id, {_STRICT} s, late l from o_task) n on s = strict and l = late group by 1, 2""")
def _(t):
    d = gold.task_orders(t.orders).withColumn("strict", F.expr(_STRICT))
    return joins.crosstab(d, "strict", "late", [0, 1], [0, 1])


@query("b15_fixed_buckets", """
select b.position, b.status, count(o.order_id) n from (values (0,'delivered'),(1,'created'),(2,'shipped')) b(position, status)
left join e_orders o on o.order_status = b.status group by 1, 2""")
def _(t):
    return joins.fixed_buckets(t.orders.select(F.col("order_status").alias("status")), "status",
                               ["delivered", "created", "shipped"])


@query("b16_conditional_projection", """
select case when freight_value = 0 then 'ZERO' when freight_value > price then 'ABOVE' else 'NORMAL' end kind, count(*) n
from e_items group by 1""")
def _(t):
    k = F.when(F.col("freight_value") == 0, "ZERO").when(F.col("freight_value") > F.col("price"), "ABOVE").otherwise("NORMAL")
    return t.items.groupBy(k.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("b17_sort_head", """
select purchase_month, count(*) n from o_task group by 1 order by 1 desc limit 6""")
def _(t):
    g = gold.task_orders(t.orders).groupBy("purchase_month").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("purchase_month")).limit(6)


@query("b18_scalar_comparison", """
select case when (select count(*) from o_features) = (select count(*) from e_orders) then 'PASS' else 'FAIL' end status,
 (select count(*) from o_features) observed, (select count(*) from e_orders) expected""")
def _(t):
    a = gold.features_core(t.orders, t.items).agg(F.count(F.lit(1)).alias("n"))
    b = t.orders.agg(F.count(F.lit(1)).alias("expected"))
    d = a.select(F.col("n").alias("observed"), b.scalar().alias("expected"))
    return d.withColumn("status", F.when(F.col("observed") == F.col("expected"), "PASS").otherwise("FAIL"))


@query("b19_stable_row_index", """
select order_id, row_number() over (partition by cast(order_purchase_timestamp as date) order by order_purchase_timestamp, order_id)
 + coalesce((select cast(sum(n) as bigint) from (select cast(order_purchase_timestamp as date) d, count(*) n from e_orders group by 1) z
    where z.d < cast(o.order_purchase_timestamp as date)), 0) - 1 row_index from e_orders o""")
def _(t):
    o = t.orders.select("order_id", x.us("order_purchase_timestamp").alias("t"))
    d = ranks.cumulative(ranks.distinct_counts(o, [], "t"), [], "t", ["_n"]).select("t", F.col("_n_before").alias("earlier"))
    ties = ranks.cumulative(ranks.distinct_counts(o, ["t"], "order_id"), ["t"], "order_id", ["_n"])
    return ties.join(d, "t").select("order_id", (F.col("earlier") + F.col("_n_before")).alias("row_index"))


# ---------------------------------------------------------------- C aggregations and gold
_CORE_OUT = ", ".join(f"round({k}, 6) {k}" if k not in gold.CORE_FEATURES[:3] else k for k in gold.CORE_FEATURES)


def _round_core(df, first):
    return df.select(*first, *[F.col(k) if k in gold.CORE_FEATURES[:3] else rnd(k).alias(k) for k in gold.CORE_FEATURES])


@query("c1_order_core_v1", f"select order_id, {_CORE_OUT} from o_core")
def _(t):
    return _round_core(gold.order_core(t.items), ["order_id"])


@query("c2_ml_delivery_features_core", f"select order_id, prediction_time, has_order_items, {_CORE_OUT} from o_features")
def _(t):
    return _round_core(gold.features_core(t.orders, t.items), ["order_id", "prediction_time", "has_order_items"])


@query("c3_delivery_service_outcomes", "select * from o_outcomes")
def _(t):
    return gold.service_outcomes(t.orders)


@query("c4_supervised_core", f"select order_id, prediction_time, {_CORE_OUT}, late_delivery_calendar_day from o_sup")
def _(t):
    d = gold.supervised_cohort(t.orders, t.items)
    return _round_core(d, ["order_id", "prediction_time", "late_delivery_calendar_day"])


@query("c5_payment_aggregate", """
select order_id, count(*) payment_records, count(distinct payment_type) payment_types, round(sum(payment_value), 4) payment_total,
 max(payment_installments) max_installments from e_payments group by 1""")
def _(t):
    return t.payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_records"), F.countDistinct("payment_type").alias("payment_types"),
        rnd(F.sum("payment_value"), 4).alias("payment_total"), F.max("payment_installments").alias("max_installments"))


@query("c6_product_attribute_aggregate", """
select order_id, max(cast(product_category_name is null as int)) any_category_missing, max(cast(product_weight_g is null as int)) any_weight_missing,
 max(product_weight_g) max_weight_g, round(sum(product_weight_g), 4) sum_weight_g, round(avg(product_photos_qty), 6) mean_photos
from e_items left join e_products using (product_id) group by 1""")
def _(t):
    d = joins.checked_join(t.items, t.products, ["product_id"])
    return d.groupBy("order_id").agg(
        F.max(x.flag(F.col("product_category_name").isNull())).alias("any_category_missing"),
        F.max(x.flag(F.col("product_weight_g").isNull())).alias("any_weight_missing"),
        F.max("product_weight_g").alias("max_weight_g"), rnd(F.sum("product_weight_g"), 4).alias("sum_weight_g"),
        rnd(F.avg("product_photos_qty")).alias("mean_photos"))


@query("c7_null_preserving_sum", """
select seller_id, order_id, sum(product_weight_g) weight_or_null, coalesce(sum(product_weight_g), 0.0::double) weight_or_zero
from e_items left join e_products using (product_id) group by 1, 2""")
def _(t):
    d = t.items.join(t.products, "product_id", "left").groupBy("seller_id", "order_id")
    w = F.sum("product_weight_g")
    return d.agg(w.alias("weight_or_null"), F.coalesce(w, F.lit(0.0)).alias("weight_or_zero"))


@query("c8_completeness_flags", """
select order_id, count(product_weight_g) items_with_weight, cast(count(product_weight_g) = count(*) as int) weight_complete
from e_items left join e_products using (product_id) group by 1""")
def _(t):
    n = F.count("product_weight_g")
    return t.items.join(t.products, "product_id", "left").groupBy("order_id").agg(
        n.alias("items_with_weight"), (n == F.count(F.lit(1))).cast("int").alias("weight_complete"))


@query("c9_any_all", """
select order_id, cast(bool_or(freight_value = 0) as int) any_free, cast(bool_and(freight_value > 0) as int) all_paid from e_items group by 1""")
def _(t):
    return t.items.groupBy("order_id").agg(F.bool_or(F.col("freight_value") == 0).cast("int").alias("any_free"),
                                           F.bool_and(F.col("freight_value") > 0).cast("int").alias("all_paid"))


def weighted_mean(v, w):
    """Weighted mean; the simple mean when the weights sum to 0."""
    return F.when(F.sum(w) > 0, F.sum(F.col(v) * F.col(w)) / F.sum(w)).otherwise(F.avg(v))


@query("c10_weighted_mean", """
select year, month, uf, round(case when sum(n_posts) > 0 then sum(mean_price * n_posts) / sum(n_posts) else avg(mean_price) end, 6) price
from e_fuel group by 1, 2, 3""")
def _(t):
    return t.fuel.groupBy("year", "month", "uf").agg(rnd(weighted_mean("mean_price", "n_posts")).alias("price"))


@query("c11_exact_quantiles", """
select seller_id, round(quantile_cont(freight_value, 0.25), 6) q25, round(quantile_cont(freight_value, 0.5), 6) q50,
 round(quantile_cont(freight_value, 0.75), 6) q75, round(quantile_cont(freight_value, 0.9), 6) q90,
 round(quantile_cont(freight_value, 0.75) - quantile_cont(freight_value, 0.25), 6) iqr from e_items group by 1""")
def _(t):
    q = ranks.exact_quantiles(t.items, ["seller_id"], "freight_value", {"q25": .25, "q50": .5, "q75": .75, "q90": .9})
    return q.select("seller_id", *[rnd(k).alias(k) for k in ("q25", "q50", "q75", "q90")],
                    rnd(F.col("q75") - F.col("q25")).alias("iqr"))


@query("c11_median_mad", """
select m.seller_id, round(any_value(med), 6) median, round(median(abs(price - med)), 6) mad
from e_items i join (select seller_id, median(price) med from e_items group by 1) m using (seller_id) group by 1""")
def _(t):
    d = ranks.median_mad(t.items, ["seller_id"], "price")
    return d.select("seller_id", rnd("median").alias("median"), rnd("mad").alias("mad"))


@query("c12_global_thresholds", """
select 'q75' name, round(quantile_cont(price, 0.75), 6) price_at, round(quantile_cont(freight_value, 0.75), 6) freight_at from e_items
union all select 'q80', round(quantile_cont(price, 0.8), 6), round(quantile_cont(freight_value, 0.8), 6) from e_items
union all select 'q90', round(quantile_cont(price, 0.9), 6), round(quantile_cont(freight_value, 0.9), 6) from e_items""")
def _(t):
    p = {"q75": .75, "q80": .8, "q90": .9}
    long = ranks.melt(t.items, [], ["price", "freight_value"])
    q = ranks.exact_quantiles(long, ["variable"], "value", p).unpivot(["variable"], list(p), "name", "v")
    w = q.groupBy("name").pivot("variable", ["price", "freight_value"]).agg(F.first("v"))
    return w.select("name", rnd("price").alias("price_at"), rnd("freight_value").alias("freight_at"))


def _late_by(name, category, sql_from, build):
    @query(f"c13_late_rate_by_{name}", f"""
select {category}, orders, late_orders, round(100.0::double * late_orders / orders, 6) late_rate_pct,
  round(100.0::double * orders / sum(orders) over (), 6) share_pct
from (select {category}, count(*) orders, cast(sum(late) as bigint) late_orders from (select distinct order_id, {category}, late from {sql_from}) group by 1)""")
    def _(t):
        return cohorts.late_rate_by(build(t), category)


_late_by("customer_state", "customer_state", "o_task join e_customers using (customer_id)",
         lambda t: gold.task_orders(t.orders).join(t.customers, "customer_id"))
_late_by("payment_type", "payment_type", "o_task join e_payments using (order_id)",
         lambda t: gold.task_orders(t.orders).join(t.payments, "order_id"))
_late_by("category", "product_category_name", "o_task join e_items using (order_id) join e_products using (product_id)",
         lambda t: gold.task_orders(t.orders).join(t.items, "order_id").join(t.products, "product_id"))
_late_by("seller_state", "seller_state", "o_task join e_items using (order_id) join e_sellers using (seller_id)",
         lambda t: gold.task_orders(t.orders).join(t.items, "order_id").join(t.sellers, "seller_id"))

_PARTS = {"month": ("cast(month(order_purchase_timestamp) as int)", F.month), "weekday":
          ("cast(isodow(order_purchase_timestamp) - 1 as int)", F.weekday), "hour": ("cast(hour(order_purchase_timestamp) as int)", F.hour)}
for _name, (_sql, _fn) in _PARTS.items():
    @query(f"c14_rate_by_{_name}", f"""
select {_sql} "{_name}", count(*) orders, cast(sum(late) as bigint) late_orders, round(100 * avg(late), 6) late_rate_pct from o_task group by 1""")
    def _(t, fn=_fn, name=_name):
        return cohorts.rate_by_part(gold.task_orders(t.orders), fn("order_purchase_timestamp"), name)


@query("c15_seller_volume_bands", """
select band, count(*) sellers, cast(sum(n) as bigint) order_pairs, round(avg(l/n), 6) mean_rate, round(stddev_samp(l/n), 6) std_rate,
  round(sum(l)/sum(n), 6) pooled_rate, round(median(l/n), 6) median_rate
from (select *, case when n <= 1 then '1' when n <= 5 then '2-5' when n <= 20 then '6-20' when n <= 100 then '21-100' else '>100' end band
 from (select seller_id, count(*) n, sum(late)::double l from (select distinct order_id, seller_id, late from o_task join e_items using (order_id)) group by 1))
group by 1""")
def _(t):
    return cohorts.seller_volume_bands(gold.task_orders(t.orders).join(t.items, "order_id"))


@query("c16_profile_by_class", """
select variable, late, count(v) n, round(avg(v), 5) mean, round(stddev_samp(v), 5) std, round(quantile_cont(v, 0.5), 5) median,
  round(quantile_cont(v, 0.95), 5) p95
from (select late_delivery_calendar_day::int late, unnest(['total_price','total_freight','item_count']) variable,
  unnest([total_price, total_freight, item_count::double]) v from o_sup) group by 1, 2""")
def _(t):
    d = gold.supervised_cohort(t.orders, t.items).withColumn("late", F.col("late_delivery_calendar_day").cast("int"))
    return cohorts.profile_by_class(d, ["total_price", "total_freight", "item_count"], "late", {"median": .5, "p95": .95})


_MONTHLY = """(select strftime(order_purchase_timestamp, '%Y-%m') "month", count(*) orders, count(*) filter (order_status = 'delivered') delivered,
  count(*) filter (ok) observable, count(*) filter (ok and cast(order_delivered_customer_date as date) > cast(order_estimated_delivery_date as date)) late
 from (select *, order_status = 'delivered' and order_delivered_customer_date is not null ok from e_orders) group by 1)"""


@query("c17_monthly_cohort", f"""
select "month", orders, delivered, observable, round(100.0::double * observable / orders, 6) coverage_pct, late,
 round(100.0::double * late / nullif(observable, 0), 6) late_pct from {_MONTHLY}""")
def _(t):
    return cohorts.monthly_cohort(t.orders)


@query("c18_month_over_month", f"""
select "month", late_pct, lag(late_pct) over (order by "month") previous, round(late_pct - lag(late_pct) over (order by "month"), 6) delta
from (select "month", round(100.0::double * late / nullif(observable, 0), 6) late_pct from {_MONTHLY})""")
def _(t):
    m = cohorts.monthly_cohort(t.orders).select("month", "late_pct")
    return cohorts.month_over_month(m, "late_pct").withColumn("delta", rnd("delta"))


@query("c19_current_vs_prior", f"""
select "month", orders, late, prior_orders, prior_late, round(cr, 6) current_rate, round(pr, 6) prior_rate, round(100 * (cr - pr), 6) delta_pp,
  round(cr / nullif(pr, 0), 6) rate_ratio, case when prior_orders >= 1000 and prior_late >= 200 then 1 else 0 end prior_supported
from (select *, late::double / nullif(orders, 0) cr, prior_late::double / nullif(prior_orders, 0) pr from
 (select "month", observable orders, late, cast(coalesce(sum(observable) over w, 0) as bigint) prior_orders, cast(coalesce(sum(late) over w, 0) as bigint) prior_late
  from {_MONTHLY} window w as (order by "month" rows between unbounded preceding and 1 preceding)))""")
def _(t):
    m = cohorts.monthly_cohort(t.orders).select("month", F.col("observable").alias("orders"), "late")
    return cohorts.current_vs_prior(m)
