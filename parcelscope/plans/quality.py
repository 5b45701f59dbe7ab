"""Data-quality queries (D)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.functions import columns as x
from parcelscope.functions.columns import n_if, rnd
from parcelscope.operators import checks as q
from parcelscope.operators import gold, joins, profiles, ranks, readiness, registries
from parcelscope.plans.registry import query, shared
from parcelscope.plans.relational import _DIRTY, _dirty_items
from parcelscope.sources import bronze
from parcelscope.sources.bronze import SILVER_TYPES


def _check(name, expr, source, bad="FAIL"):
    return (f"select '{name}' check_name, case when n = 0 then 'PASS' else '{bad}' end status, cast(n as varchar) observed, "
            f"'0' expected from (select cast({expr} as bigint) n from {source})")


ENT = ["orders", "items", "customers", "sellers", "products", "payments", "reviews", "geolocation", "translation"]


def _counts(kind):
    status = "case when n = m then 'PASS' else 'FAIL' end"
    return " union all ".join(f"select '{kind}_ROW_COUNT__{n}' check_name, {status} status, cast(n as varchar) observed, cast(m as varchar) expected from (select count(*) n, (select count(*) from e_{n}) m from e_{n})" for n in ENT)


@query("d1_row_count_checks", f"{_counts('BRONZE')} union all {_counts('SILVER')}")
def _(t):
    """Bronze rows against the inventory of the source, typed silver rows against bronze."""
    inventory = bronze.table_inventory({n: getattr(t, n) for n in ENT})
    out = []
    for n in ENT:
        raw = bronze.to_bronze(getattr(t, n), n)
        listed = inventory.filter(F.col("table_name") == n).select(F.col("n_rows").alias("n"))
        out.append(q.equal_check(f"BRONZE_ROW_COUNT__{n}", q.row_count(raw), listed))
        out.append(q.equal_check(f"SILVER_ROW_COUNT__{n}", q.row_count(bronze.silver_type(raw, {"items": "order_items", "translation": "product_category_translation"}.get(n, n))), q.row_count(raw)))
    return q.union(out)


KEYS = {"orders": ["order_id"], "customers": ["customer_id"], "sellers": ["seller_id"], "products": ["product_id"],
        "items": ["order_id", "order_item_id"], "payments": ["order_id", "payment_sequential"]}


@query("d2_key_uniqueness", " union all ".join(
    _check(f"UNIQUE__{n}", f"count(*) - count(distinct ({', '.join(k)}))" if len(k) > 1 else f"count(*) - count(distinct {k[0]})", f"e_{n}")
    for n, k in KEYS.items()))
def _(t):
    return q.uniqueness_checks({n: (getattr(t, n), k) for n, k in KEYS.items()})


RELATIONS = [("items_orders", "items", "orders", "order_id"), ("items_products", "items", "products", "product_id"),
             ("items_sellers", "items", "sellers", "seller_id"), ("payments_orders", "payments", "orders", "order_id"),
             ("reviews_orders", "reviews", "orders", "order_id"), ("orders_customers", "orders", "customers", "customer_id"),
             ("products_translation", "products", "translation", "product_category_name")]


@query("d3_referential_integrity", " union all ".join(
    _check(f"FK__{n}", "count(*)", f"e_{a} where {k} is not null and {k} not in (select {k} from e_{b})") for n, a, b, k in RELATIONS))
def _(t):
    return q.orphan_checks([(n, getattr(t, a), getattr(t, b), k) for n, a, b, k in RELATIONS])


@query("d4_cast_loss", _check("CAST_LOSS__price", "count(*) filter (length(price) > 0 and try_cast(price as double) is null)", _DIRTY)
       + " union all " + _check("CAST_LOSS__freight_value", "0 * count(*)", _DIRTY))
def _(t):
    return q.zero_checks(_dirty_items(t), q.cast_loss(_dirty_items(t), {"price": "double", "freight_value": "double"}))


@query("d5_gold_grain", _check("GOLD_FEATURE_GRAIN", "count(*) - count(distinct order_id)", "o_features") + " union all "
       + _check("GOLD_OUTCOME_GRAIN", "count(*) - count(distinct order_id)", "o_outcomes") + """
 union all select 'GOLD_FEATURE_ROWS', case when a = b then 'PASS' else 'FAIL' end, cast(a as varchar), cast(b as varchar)
 from (select (select count(*) from o_features) a, (select count(*) from e_orders) b)""")
def _(t):
    f, o = gold.features_core(t.orders, t.items), gold.service_outcomes(t.orders)
    return q.union([q.zero_checks(f, {"GOLD_FEATURE_GRAIN": q.duplicate_keys(f, ["order_id"])}),
                    q.zero_checks(o, {"GOLD_OUTCOME_GRAIN": q.duplicate_keys(o, ["order_id"])}),
                    q.equal_check("GOLD_FEATURE_ROWS", q.row_count(f), q.row_count(t.orders))])


@query("d6_gold_identities", _check("IDENTITY_PRICE_RANGE", "count(*) filter (abs(price_range - (max_price - min_price)) > 1e-10)", "o_features")
       + " union all " + _check("IDENTITY_MERCHANDISE_PLUS_FREIGHT", "count(*) filter (abs(merchandise_plus_freight - (total_price + total_freight)) > 1e-10)", "o_features"))
def _(t):
    f = gold.features_core(t.orders, t.items)
    return q.zero_checks(f, {
        "IDENTITY_PRICE_RANGE": n_if(F.abs(F.col("price_range") - (F.col("max_price") - F.col("min_price"))) > 1e-10),
        "IDENTITY_MERCHANDISE_PLUS_FREIGHT": n_if(F.abs(F.col("merchandise_plus_freight") - (F.col("total_price") + F.col("total_freight"))) > 1e-10)})


@query("d7_relation_flag_consistency", _check("RELATION_FLAG", "count(*) filter (has_order_items <> (item_count is not null and item_count > 0))", "o_features"))
def _(t):
    f = gold.features_core(t.orders, t.items)
    return q.zero_checks(f, {"RELATION_FLAG": n_if(F.col("has_order_items") != (F.coalesce(F.col("item_count"), F.lit(0)) > 0))})


@query("d8_supervised_target", _check("TARGET_NOT_NULL", "count(*) filter (late_delivery_calendar_day is null)", "o_sup") + " union all "
       + _check("STATUS_DELIVERED", "count(*) filter (lower(trim(order_status)) <> 'delivered')", "o_sup join e_orders using (order_id)"))
def _(t):
    s = gold.supervised_cohort(t.orders, t.items)
    j = s.join(t.orders.select("order_id", "order_status"), "order_id")
    return q.union([q.zero_checks(s, {"TARGET_NOT_NULL": n_if(F.col("late_delivery_calendar_day").isNull())}),
                    q.zero_checks(j, {"STATUS_DELIVERED": n_if(~gold.is_delivered())})])


_CONTRACT = {"orders": "orders", "items": "order_items", "customers": "customers", "sellers": "sellers", "products": "products",
             "payments": "payments", "reviews": "reviews", "geolocation": "geolocation", "translation": "product_category_translation"}


@query("d9_schema_contract", " union all ".join(
    f"select '{n}' table_name, {m} missing_columns, 0 extra_columns, count(*) n_rows from e_{n}" for n, m in zip(ENT, [0, 0, 0, 0, 0, 0, 1, 0, 0])))
def _(t):
    out = []
    for n in ENT:
        df = getattr(t, n)
        d = q.schema_diff(df, list(SILVER_TYPES[_CONTRACT[n]]))
        out.append(df.agg(F.lit(n).alias("table_name"), F.lit(len(d["missing"])).alias("missing_columns"),
                          F.lit(len(d["extra"])).alias("extra_columns"), F.count(F.lit(1)).alias("n_rows")))
    return q.union(out)


@query("d10_dtype_conformity", f"""
select 'price' column_name, 'double' declared, count(*) filter (length(price) > 0) "values", count(try_cast(nullif(price, '') as double)) castable from {_DIRTY}
union all select 'order_item_id', 'bigint', count(*), count(*) from e_items
union all select 'freight_value', 'double', count(*), count(*) from e_items""")
def _(t):
    return q.dtype_conformity(_dirty_items(t), {"price": "double", "order_item_id": "bigint", "freight_value": "double"})


@query("d11_required_not_null", _check("NOT_NULL__order_id", "count(*) - count(order_id)", "e_orders") + " union all "
       + _check("NOT_NULL__order_approved_at", "count(*) - count(order_approved_at)", "e_orders") + " union all "
       + _check("NOT_NULL__customer_id", "count(*) - count(customer_id)", "e_orders"))
def _(t):
    cols = ["order_id", "order_approved_at", "customer_id"]
    return q.zero_checks(t.orders, {f"NOT_NULL__{k}": n_if(F.col(k).isNull()) for k in cols})


@query("d12_full_row_duplicates", """select cast(coalesce(sum(n - 1), 0) as bigint) duplicates from (select count(*) n from e_geolocation group by
 geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city, geolocation_state)""")
def _(t):
    return q.full_row_duplicates(t.geolocation)


_STATUS_DIRTY = "case when order_id % 307 = 0 then 'returned' else order_status end"


@query("d13_domain_check", f"select s as \"value\", count(*) n from (select {_STATUS_DIRTY} s from e_orders) where s not in "
       "('created','approved','invoiced','processing','shipped','delivered','unavailable','canceled') group by 1")
def _(t):
    return q.domain_violations(t.orders.select(F.expr(_STATUS_DIRTY).alias("s")), "s", q.ALLOWED_STATUS)


def _range_sql():
    out = []
    for (tab, col), (lo, lo_in, hi, hi_in) in q.NUMERIC_RULES.items():
        bad = [f"{col} {'<' if lo_in else '<='} {lo}"] if lo is not None else []
        bad += [f"{col} {'>' if hi_in else '>='} {hi}"] if hi is not None else []
        out.append(_check(f"RANGE__{tab}__{col}", f"count(*) filter ({' or '.join(bad)})", f"e_{tab}"))
    return " union all ".join(out)


@query("d14_numeric_ranges", _range_sql())
def _(t):
    return q.range_checks({n: getattr(t, n) for n in ENT})


@query("d15_suspicious_zeros", " union all ".join([
    _check("ZERO__payment_value", "count(*) filter (payment_value = 0)", "e_payments", "WARN"),
    _check("ZERO__payment_installments", "count(*) filter (payment_installments = 0)", "e_payments", "WARN"),
    _check("ZERO__product_weight_g", "count(*) filter (product_weight_g = 0)", "e_products", "WARN"),
    _check("ZERO__freight_value", "count(*) filter (freight_value = 0)", "e_items", "WARN")]))
def _(t):
    def z(df, *cols):
        return q.zero_checks(df, {f"ZERO__{k}": n_if(F.col(k) == 0) for k in cols}, "WARNING")
    return q.union([z(t.payments, "payment_value", "payment_installments"), z(t.products, "product_weight_g"), z(t.items, "freight_value")])


_BAD_TIME = "case when order_id % 211 = 0 then 'not a date' else {} end"


@query("d16_datetime_parse", """select 'PARSE__order_purchase_timestamp' check_name, case when n = 0 then 'PASS' else 'FAIL' end status,
 cast(n as varchar) observed, '0' expected from (select count(*) filter (order_id % 211 = 0) n from e_orders)""")
def _(t):
    b = t.orders.select(F.expr(_BAD_TIME.format("cast(order_purchase_timestamp as string)")).alias("v"))
    return q.zero_checks(b, {"PARSE__order_purchase_timestamp": n_if(F.col("v").isNotNull() & x.try_ts("v").isNull())})


@query("d17_temporal_order", " union all ".join(
    f"select '{n}' rule, count(*) filter ({a} is not null and {b} is not null) comparable, count(*) filter ({a} > {b}) violations from e_orders"
    for n, a, b in q.TEMPORAL_RULES))
def _(t):
    return q.temporal_order(t.orders)


@query("d18_promised_lead_positive", _check("PROMISED_LEAD_POSITIVE", "count(*) filter (order_estimated_delivery_date <= order_purchase_timestamp)", "e_orders"))
def _(t):
    return q.zero_checks(t.orders, {"PROMISED_LEAD_POSITIVE": n_if(F.col("order_estimated_delivery_date") <= F.col("order_purchase_timestamp"))})


@query("d19_zip_in_several_states", """
select geolocation_zip_code_prefix zip, count(distinct geolocation_state) states, count(*) n_rows from e_geolocation group by 1 having count(distinct geolocation_state) > 1""")
def _(t):
    g = t.geolocation.groupBy(F.col("geolocation_zip_code_prefix").alias("zip")).agg(
        F.countDistinct("geolocation_state").alias("states"), F.count(F.lit(1)).alias("n_rows"))
    return g.filter("states > 1")


@query("d20_finite_numbers", " union all ".join(
    _check(f"FINITE__{c}", f"count(*) filter (not isfinite({c}))", f"(select case when order_id % 509 = 0 then 'nan'::double when order_id % 503 = 0 then 'inf'::double else {c} end {c} from e_items)")
    for c in ("price", "freight_value")))
def _(t):
    cols = ["price", "freight_value"]
    d = t.items.select(*[F.expr(f"case when order_id % 509 = 0 then double('NaN') when order_id % 503 = 0 then double('Infinity') else {k} end").alias(k) for k in cols])
    return q.zero_checks(d, {f"FINITE__{k}": n_if(~x.is_finite(k)) for k in cols})


_P_COLS = ["product_category_name", "product_weight_g", "product_length_cm", "product_height_cm"]
_LIMITS = {"product_category_name": (1.0, "WARN"), "product_weight_g": (5.0, "FAIL"), "product_length_cm": (0.5, "FAIL"), "product_height_cm": (0.0, "FAIL")}


def _compl_sql(tab, cols):
    return " union all ".join(
        f"select '{tab}' table_name, '{k}' column_name, count(*) n_rows, count(*) - count({k}) missing, round(100.0::double * (count(*) - count({k})) / count(*), 6) missing_pct from e_{tab}"
        for k in cols)


@query("d21_completeness", "select *, case when missing_pct <= lim then 'PASS' else sev end status from (" + " union all ".join(
    f"select *, {lim}::double lim, '{sev}' sev from ({_compl_sql('products', [k])})" for k, (lim, sev) in _LIMITS.items()) + ")")
def _(t):
    p = profiles.graded_completeness(profiles.completeness(t.products, _P_COLS, "products"), _LIMITS)
    lim = F.create_map(*[F.lit(v) for k, (a, _) in _LIMITS.items() for v in (k, a)])
    sev = F.create_map(*[F.lit(v) for k, (_, b) in _LIMITS.items() for v in (k, b)])
    return p.withColumns({"lim": lim[F.col("column_name")], "sev": sev[F.col("column_name")]})


@query("d22_source_coverage", """
select 'order_items' relation, count(*) orders, count(*) filter (order_id not in (select order_id from e_items)) missing from e_orders
union all select 'payments', count(*), count(*) filter (order_id not in (select order_id from e_payments)) from e_orders
union all select 'customer_geo', count(*), count(*) filter (customer_zip_code_prefix not in (select geolocation_zip_code_prefix from e_geolocation)) from e_orders join e_customers using (customer_id)""")
def _(t):
    def cov(name, left, right, key):
        p = joins.presence_join(left, right, [key], "has")
        return p.agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("orders"), n_if(~F.col("has")).alias("missing"))
    geo = t.geolocation.select(F.col("geolocation_zip_code_prefix").alias("customer_zip_code_prefix")).distinct()
    o = t.orders.select("order_id", "customer_id")
    return q.union([cov("order_items", o, t.items.select("order_id").distinct(), "order_id"),
                    cov("payments", o, t.payments.select("order_id").distinct(), "order_id"),
                    cov("customer_geo", o.join(t.customers, "customer_id"), geo, "customer_zip_code_prefix")])


def _num_sql(tab, col):
    qs = ", ".join(f"round(quantile_cont(v, {p}), 4) {n}" for n, p in profiles.PROFILE_PROBS.items())
    src = f"(select cast({col} as double) v from e_{tab})"
    return f"""select '{tab}' table_name, '{col}' variable, count(v) n, count(*) - count(v) missing, count(distinct v) unique_values, round(avg(v), 4) mean,
 round(stddev_samp(v), 4) std, round(min(v), 4) min, round(max(v), 4) max, round(skewness(v), 4) skew, round(kurtosis(v), 4) kurtosis,
 round(mad(v), 4) mad, {qs}, round(100.0::double * (select max(k) from (select count(*) k from {src} where v is not null group by v)) / count(v), 4) dominant_pct,
 (select count(*) from {src}, (select quantile_cont(v, .25) a, quantile_cont(v, .75) b from {src}) f where v < a - 1.5*(b-a) or v > b + 1.5*(b-a)) iqr_outliers,
 (select count(*) from {src}, (select median(v) m, mad(v) d from {src}) f where abs(0.6745 * (v - m) / nullif(d, 0)) > 3.5) mad_outliers from {src}"""


_NUM = {"items": ["price", "freight_value"], "products": ["product_weight_g", "product_length_cm", "product_photos_qty"]}


@query("d23_numeric_profile", " union all ".join(_num_sql(a, b) for a, cs in _NUM.items() for b in cs))
def _(t):
    return q.union([profiles.numeric_profile(getattr(t, a), cs, a) for a, cs in _NUM.items()])


#: Percent of non-null values from which a dominant value makes a variable near-constant (a parameter of the contract).
NEAR_CONSTANT_PCT = 95.0


def _near_sql(tab, col):
    return f"""select '{tab}' table_name, '{col}' variable, count(*) distinct_n, round(100.0::double * max(k) / sum(k), 6) dominant_pct, cast(count(*) <= 1 or 100.0::double * max(k) / sum(k) >= {NEAR_CONSTANT_PCT} as int) near_constant
 from (select {col} v, count(*) k from e_{tab} where {col} is not null group by 1)"""


_NEAR = {**_NUM, "items": [*_NUM["items"], "order_item_id"], "payments": ["payment_sequential", "payment_value"]}


@query("d24_near_constant", " union all ".join(_near_sql(a, b) for a, cs in _NEAR.items() for b in cs))
def _(t):
    return q.union([profiles.near_constant(getattr(t, a), cs, a, NEAR_CONSTANT_PCT) for a, cs in _NEAR.items()])


def _cat_sql(tab, col):
    lv = f"(select {col} v, count(*) n from e_{tab} group by 1)"
    return f"""select '{tab}' table_name, '{col}' variable, cast(coalesce(sum(n) filter (v is null), 0) as bigint) missing, count(v) levels, max(n) filter (v is not null) dominant_n,
 count(*) filter (v is not null and n = 1) singletons, round(100.0::double * (max(n) filter (v is not null)) / (sum(n) filter (v is not null)), 6) dominant_pct,
 round((select -sum(p * log2(p)) from (select n::double / sum(n) over () p from {lv} where v is not null)), 6) entropy_bits,
 (select v from {lv} where v is not null order by n desc, v limit 1) top_level from {lv}"""


@query("d25_categorical_profile", " union all ".join(
    _cat_sql(a, b) for a, b in [("customers", "customer_state"), ("orders", "order_status"), ("payments", "payment_type"), ("products", "product_category_name")]))
def _(t):
    return q.union([profiles.categorical_profile(getattr(t, a), [b], a) for a, b in
                    [("customers", "customer_state"), ("orders", "order_status"), ("payments", "payment_type"), ("products", "product_category_name")]])


@query("d25_categorical_frequency", """select order_status as level, count(*) n, round(100.0::double * count(*) / (select count(*) from e_orders), 6) share_pct from e_orders group by 1""")
def _(t):
    return profiles.categorical_frequency(t.orders, "order_status")


_MISS = """(select o.order_id, strftime(order_purchase_timestamp, '%Y-%m') "month", cast(coalesce(any_cat, 0) as int) any_category_missing, cast(coalesce(any_w, 0) as int) any_weight_missing,
 cast(i.order_id is null as int) no_items from e_orders o left join (select order_id, max(cast(product_category_name is null as int)) any_cat, max(cast(product_weight_g is null as int)) any_w
 from e_items left join e_products using (product_id) group by 1) i using (order_id))"""


def _missing_by_order(t):
    d = t.items.join(t.products, "product_id", "left").groupBy("order_id").agg(
        F.max(x.flag(F.col("product_category_name").isNull())).alias("c"), F.max(x.flag(F.col("product_weight_g").isNull())).alias("w"))
    o = t.orders.select("order_id", x.month_key("order_purchase_timestamp").alias("month"))
    return o.join(d, "order_id", "left").select("order_id", "month", F.coalesce("c", F.lit(0)).alias("any_category_missing"),
                                               F.coalesce("w", F.lit(0)).alias("any_weight_missing"), x.flag(F.col("c").isNull()).alias("no_items"))


_IND = ["any_category_missing", "any_weight_missing", "no_items"]


@query("d26_missingness_by_month", f"""
select i indicator, "month", orders, n, round(100.0::double * n / orders, 6) pct from (
 select "month", count(*) orders, unnest({_IND}) i, unnest([{', '.join(f'cast(sum({k}) as bigint)' for k in _IND)}]) n from {_MISS} group by 1)""")
def _(t):
    g = _missing_by_order(t).groupBy("month").agg(F.count(F.lit(1)).alias("orders"), *[F.sum(k).alias(k) for k in _IND])
    return g.unpivot(["month", "orders"], _IND, "indicator", "n").withColumn("pct", rnd(100.0 * F.col("n") / F.col("orders")))


@query("d26_missingness_stability", f"""
select i indicator, count(*) n_months, round(max(p) - min(p), 6) range_pp from (select unnest({_IND}) i, unnest([{', '.join(f'100.0::double * sum({k}) / count(*)' for k in _IND)}]) p
 from {_MISS} group by "month" having count(*) >= 100) group by 1""")
def _(t):
    g = _missing_by_order(t).groupBy("month").agg(F.count(F.lit(1)).alias("orders"), *[(100.0 * F.sum(k) / F.count(F.lit(1))).alias(k) for k in _IND])
    return (g.filter("orders >= 100").unpivot(["month"], _IND, "indicator", "p").groupBy("indicator")
            .agg(F.count(F.lit(1)).alias("n_months"), rnd(F.max("p") - F.min("p")).alias("range_pp")))


@query("d27_tail_flags", "select table_name, variable, cast(100.0 * iqr_outliers / n > 1 as int) heavy_tail from (" + " union all ".join(
    _num_sql("items", b) for b in _NUM["items"]) + ")")
def _(t):
    p = profiles.numeric_profile(t.items, _NUM["items"], "items")
    return p.select("table_name", "variable", (100.0 * F.col("iqr_outliers") / F.col("n") > 1).cast("int").alias("heavy_tail"))


@query("d28_missing_cells", " union all ".join(
    f"select '{n}' table_name, count(*) * {len(cs)} cells, " + " + ".join(f"count(*) - count({c})" for c in cs) + f" missing_cells from e_{n}"
    for n, cs in {"products": _P_COLS, "customers": ["customer_id", "customer_state"], "orders": ["order_approved_at", "order_delivered_customer_date"]}.items()))
def _(t):
    spec = {"products": _P_COLS, "customers": ["customer_id", "customer_state"], "orders": ["order_approved_at", "order_delivered_customer_date"]}
    return q.union([profiles.completeness(getattr(t, n), cs, n).groupBy("table_name").agg(
        F.sum("n_rows").alias("cells"), F.sum("missing").alias("missing_cells")) for n, cs in spec.items()])


shared("o_exposure", """
select i.*, k.purchase_month, p.product_id is not null product_resolved, p.product_category_name is null category_missing,
 product_weight_g is null or product_length_cm is null or product_height_cm is null or product_width_cm is null physical_missing,
 s.seller_id is not null seller_resolved, coalesce(seller_zip_code_prefix in (select geolocation_zip_code_prefix from e_geolocation), false) seller_geo
from e_items i join o_task k using (order_id) left join e_products p using (product_id) left join e_sellers s using (seller_id)""")
shared("o_ready", """
select k.order_id, purchase_month, cast(i.order_id is not null as int) has_items, cast(i.order_id is not null as int) item_core_complete,
 coalesce(a, 0) all_products_resolved, coalesce(b, 0) all_categories_known, coalesce(c, 0) all_physical_known, coalesce(d, 0) all_sellers_resolved, coalesce(e, 0) all_sellers_geo,
 cast(k.order_id in (select order_id from e_payments) as int) has_payment, cast(u.customer_id is not null as int) customer_resolved,
 cast(coalesce(customer_zip_code_prefix in (select geolocation_zip_code_prefix from e_geolocation), false) as int) customer_geo
from o_task k left join e_customers u using (customer_id) left join (select order_id, cast(bool_and(product_resolved) as int) a, cast(bool_and(product_resolved and not category_missing) as int) b,
 cast(bool_and(product_resolved and not physical_missing) as int) c, cast(bool_and(seller_resolved) as int) d, cast(bool_and(seller_geo) as int) e from o_exposure group by 1) i using (order_id)""")


@query("d29_conditional_completeness", """
select 'TASK_ITEM_EXPOSURE' scope, count(*) denominator, count(*) filter (category_missing) category_missing, count(*) filter (physical_missing) physical_missing from o_exposure where product_resolved
""" + "".join(f""" union all select '{s}', count(*), count(*) filter (c), count(*) filter (p) from (select {k}, bool_or(category_missing) c, bool_or(physical_missing) p from o_exposure where product_resolved group by 1)"""
              for s, k in [("TASK_UNIQUE_PRODUCT", "product_id"), ("TASK_ORDER", "order_id"), ("TASK_UNIQUE_SELLER", "seller_id")]))
def _(t):
    return readiness.conditional_completeness(readiness.exposure(gold.task_orders(t.orders), t))


_EVENTS = ["order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"]


@query("d30_event_completeness", " union all ".join(
    f"select 'task' table_name, '{k}' column_name, count(*) n_rows, count(*) - count({k}) missing, round(100.0::double * (count(*) - count({k})) / count(*), 6) missing_pct from o_task" for k in _EVENTS))
def _(t):
    return profiles.completeness(gold.task_orders(t.orders), _EVENTS, "task")


def _ready(t):
    return readiness.order_readiness(gold.task_orders(t.orders), t)


@query("d31_order_readiness", f"select order_id, purchase_month, {', '.join(readiness.READY_FLAGS)} from o_ready")
def _(t):
    return _ready(t)


_RF = readiness.READY_FLAGS
_READY_SQL = f"""select {{g}} readiness, orders, ready, round(100.0::double * ready / orders, 6) ready_pct from (
 select {{g}} count(*) orders, unnest({_RF}) readiness, unnest([{', '.join(f'cast(sum({k}) as bigint)' for k in _RF)}]) ready from o_ready {{by}})"""


@query("d31_readiness_summary", _READY_SQL.format(g="", by=""))
def _(t):
    return readiness.readiness_summary(_ready(t), [])


@query("d31_readiness_by_month", _READY_SQL.format(g="purchase_month, ", by="group by purchase_month"))
def _(t):
    return readiness.readiness_summary(_ready(t), ["purchase_month"])


def _reason(c, scope, st, n, d, src):
    return f"select '{c}' component, '{scope}' scope, '{st}' state, count(*) filter ({n}) n, count(*) filter ({d}) denominator, round(100.0::double * count(*) filter ({n}) / count(*) filter ({d}), 6) pct from {src}"


@query("d32_missing_reasons", " union all ".join([
    _reason("order_items", "TASK_ORDER", "RELATION_MISSING", "has_items = 0", "true", "o_ready"),
    _reason("payments", "TASK_ORDER", "RELATION_MISSING", "has_payment = 0", "true", "o_ready"),
    _reason("customer", "TASK_ORDER", "RELATION_MISSING", "customer_resolved = 0", "true", "o_ready"),
    _reason("customer_geolocation", "TASK_ORDER", "RELATION_MISSING", "customer_resolved = 1 and customer_geo = 0", "customer_resolved = 1", "o_ready"),
    _reason("product", "TASK_ITEM", "RELATION_MISSING", "not product_resolved", "true", "o_exposure"),
    _reason("product_category", "TASK_ITEM", "ATTRIBUTE_MISSING", "product_resolved and category_missing", "product_resolved", "o_exposure"),
    _reason("product_physical", "TASK_ITEM", "ATTRIBUTE_MISSING", "product_resolved and physical_missing", "product_resolved", "o_exposure"),
    _reason("seller", "TASK_ITEM", "RELATION_MISSING", "not seller_resolved", "true", "o_exposure"),
    _reason("seller_geolocation", "TASK_ITEM", "RELATION_MISSING", "seller_resolved and not seller_geo", "seller_resolved", "o_exposure")]))
def _(t):
    return readiness.missing_reasons(_ready(t), readiness.exposure(gold.task_orders(t.orders), t))


@query("d33_source_vs_task", """
select metric, round(s, 6) source_missing_pct, round(k, 6) task_missing_pct, round(k - s, 6) diff_pp from (
select 'product_category' metric, (select 100.0::double * count(*) filter (product_category_name is null) / count(*) from e_products) s, (select 100.0::double * count(*) filter (category_missing) / count(*) from o_exposure) k
union all select 'order_approved_at', (select 100.0::double * count(*) filter (order_approved_at is null) / count(*) from e_orders), (select 100.0::double * count(*) filter (order_approved_at is null) / count(*) from o_task))""")
def _(t):
    task = gold.task_orders(t.orders)

    def pct(df, cond, metric, name):
        return df.agg(F.lit(metric).alias("metric"), (100.0 * n_if(cond) / F.count(F.lit(1))).alias(name))
    cat, appr = F.col("product_category_name").isNull(), F.col("order_approved_at").isNull()
    s = pct(t.products, cat, "product_category", "s").unionByName(pct(t.orders, appr, "order_approved_at", "s"))
    k = (pct(readiness.exposure(task, t), F.col("category_missing"), "product_category", "k")
         .unionByName(pct(task, appr, "order_approved_at", "k")))
    return s.join(k, "metric").select("metric", rnd("s").alias("source_missing_pct"), rnd("k").alias("task_missing_pct"),
                                      rnd(F.col("k") - F.col("s")).alias("diff_pp"))


@query("d34_multi_entity_structure", """
select count(*) orders, count(*) filter (item_count > 1) multi_item, count(*) filter (unique_product_count > 1) multi_product, count(*) filter (unique_seller_count > 1) multi_seller,
 count(*) filter (pay > 1) multi_payment, round(avg(item_count), 6) mean_items from o_task join o_core using (order_id) left join (select order_id, count(*) pay from e_payments group by 1) using (order_id)""")
def _(t):
    pay = t.payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("pay"))
    d = gold.task_orders(t.orders).join(gold.order_core(t.items), "order_id").join(pay, "order_id", "left")
    return d.agg(F.count(F.lit(1)).alias("orders"), n_if(F.col("item_count") > 1).alias("multi_item"), n_if(F.col("unique_product_count") > 1).alias("multi_product"),
                 n_if(F.col("unique_seller_count") > 1).alias("multi_seller"), n_if(F.col("pay") > 1).alias("multi_payment"), rnd(F.avg("item_count")).alias("mean_items"))


@query("d35_cohort_funnel", """
select 'source_orders' step, count(*) orders from e_orders union all select 'status_delivered', count(*) from e_orders where order_status = 'delivered'
union all select 'delivery_observed', count(*) from e_orders where order_status = 'delivered' and order_delivered_customer_date is not null
union all select 'label_observed', count(*) from o_task union all select 'with_items', count(*) from o_ready where has_items = 1
union all select 'with_geography', count(*) from o_ready where has_items = 1 and customer_geo = 1 and all_sellers_geo = 1""")
def _(t):
    return readiness.funnel(t.orders, _ready(t))


@query("d36_scorecard", f"""
select count(*) checks, count(*) filter (status = 'PASS') pass, count(*) filter (status = 'FAIL') fail, count(*) filter (status = 'WARN') warn,
 case when count(*) filter (status = 'FAIL') > 0 then 'FAIL' else 'PASS' end gate_status from ({_range_sql()} union all {_check("ZERO__freight_value", "count(*) filter (freight_value = 0)", "e_items", "WARN")})""")
def _(t):
    z = q.zero_checks(t.items, {"ZERO__freight_value": n_if(F.col("freight_value") == 0)}, "WARNING")
    return q.scorecard(q.range_checks({n: getattr(t, n) for n in ENT}).unionByName(z))


@query("d37_exception_rows", """
select product_id, 'WEIGHT_ZERO' dq_check from e_products where product_weight_g = 0 union all select product_id, 'WEIGHT_MISSING' from e_products where product_weight_g is null
union all select product_id, 'CATEGORY_MISSING' from e_products where product_category_name is null""")
def _(t):
    return q.exception_rows(t.products, {"WEIGHT_ZERO": F.col("product_weight_g") == 0, "WEIGHT_MISSING": F.col("product_weight_g").isNull(),
                                         "CATEGORY_MISSING": F.col("product_category_name").isNull()}, "product_id")


@query("d38_financial_reconciliation", """
select case when g <= 0.01 then '<=0.01' when g <= 1 then '<=1' when g <= 10 then '<=10' else '>10' end band, count(*) orders, round(sum(g), 4) total_gap
from (select round(abs(p - merchandise_plus_freight), 4) g from (select order_id, sum(payment_value) p from e_payments group by 1) join o_core using (order_id)) group by 1""")
def _(t):
    p = t.payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    return q.reconciliation(p, gold.order_core(t.items), "order_id", "paid", "merchandise_plus_freight")


@query("d39_missingness_by_class", f"""
select late, i indicator, n, round(100.0::double * n / orders, 6) pct from (select late, count(*) orders, unnest({_IND}) i, unnest([{', '.join(f'cast(sum({k}) as bigint)' for k in _IND)}]) n
from {_MISS} join o_task using (order_id) group by 1)""")
def _(t):
    d = _missing_by_order(t).join(gold.task_orders(t.orders).select("order_id", "late"), "order_id")
    g = d.groupBy("late").agg(F.count(F.lit(1)).alias("orders"), *[F.sum(k).alias(k) for k in _IND]).unpivot(["late", "orders"], _IND, "indicator", "n")
    return g.select("late", "indicator", "n", rnd(100.0 * F.col("n") / F.col("orders")).alias("pct"))


_IDS = {"items": ["order_id", "product_id", "seller_id"], "customers": ["customer_id", "customer_unique_id"]}


@query("d40_identifier_cardinality", " union all ".join(
    f"select '{n}' table_name, '{k}' column_name, count(*) n_rows, count(distinct {k}) distinct_values, round(count(distinct {k})::double / count(*), 6) unique_ratio from e_{n}"
    for n, ks in _IDS.items() for k in ks))
def _(t):
    return q.union([profiles.identifier_cardinality(getattr(t, n), ks, n) for n, ks in _IDS.items()])


@query("d41_geolocation_quality", """
select count(*) n_rows, count(*) filter (geolocation_lat not between -90 and 90) lat_out, count(*) filter (not (geolocation_lat between -35.5 and 6.5 and geolocation_lng between -75.5 and -32.0)) out_of_box,
 count(distinct geolocation_zip_code_prefix) zips, (select count(*) from (select geolocation_zip_code_prefix from e_geolocation group by 1 having max(geolocation_lat) - min(geolocation_lat) > 0.025)) wide_zips,
 (select count(*) from e_customers where customer_zip_code_prefix not in (select geolocation_zip_code_prefix from e_geolocation)) customers_without,
 (select count(*) from e_sellers where seller_zip_code_prefix not in (select geolocation_zip_code_prefix from e_geolocation)) sellers_without from e_geolocation""")
def _(t):
    g = t.geolocation
    lat, lng, z = F.col("geolocation_lat"), F.col("geolocation_lng"), "geolocation_zip_code_prefix"
    per = g.groupBy(z).agg(F.count(F.lit(1)).alias("n"), (F.max(lat) - F.min(lat)).alias("spread"), n_if(~lat.between(-90, 90)).alias("lat_out"),
                           n_if(~(lat.between(-35.5, 6.5) & lng.between(-75.5, -32.0))).alias("box_out"))

    def without(df, col):
        return df.join(per.select(F.col(z).alias(col)), col, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    a = per.agg(F.sum("n").alias("n_rows"), F.sum("lat_out").alias("lat_out"), F.sum("box_out").alias("out_of_box"),
                F.count(F.lit(1)).alias("zips"), n_if(F.col("spread") > 0.025).alias("wide_zips"))
    return a.select("*", without(t.customers, "customer_zip_code_prefix").scalar().alias("customers_without"),
                    without(t.sellers, "seller_zip_code_prefix").scalar().alias("sellers_without"))


@query("d42_column_registry_profile", " union all ".join(_cat_sql(a, b) for a, b in [("sellers", "seller_state"), ("sellers", "seller_city"), ("reviews", "review_comment_title")]))
def _(t):
    return q.union([profiles.categorical_profile(t.sellers, ["seller_state", "seller_city"], "sellers"),
                    profiles.categorical_profile(t.reviews, ["review_comment_title"], "reviews")])


@query("d42_text_lengths", """select 'customer_city' variable, min(length(customer_city)) min_len, max(length(customer_city)) max_len, round(avg(length(customer_city)), 6) mean_len from e_customers
union all select 'customer_state', min(length(customer_state)), max(length(customer_state)), round(avg(length(customer_state)), 6) from e_customers""")
def _(t):
    return profiles.text_lengths(t.customers, ["customer_city", "customer_state"])


def _all_columns(t):
    return reduce(DataFrame.unionByName, [profiles.completeness(getattr(t, n), [k for k in SILVER_TYPES[_CONTRACT[n]] if k in getattr(t, n).columns], n) for n in ENT])


_COLS = [(n, k) for n in ENT for k in SILVER_TYPES[_CONTRACT[n]] if k != "review_comment_message"]
_RULE = {(a, b): s for a, b, s in registries.AVAILABILITY}
_REG_SQL = " union all ".join(f"select '{n}' tab, '{k}' col, '{_RULE.get((n, k)) or _RULE[(n, '*')]}' availability, count(*) - count({k}) missing, count(*) n_rows from e_{n}" for n, k in _COLS)


@query("d43_availability_registry", f"select availability, count(*) columns, cast(sum(n_rows) as bigint) cells, cast(sum(missing) as bigint) missing_cells from ({_REG_SQL}) group by 1")
def _(t):
    r = registries.column_registry(t.spark, _all_columns(t))
    return r.groupBy("availability").agg(F.count(F.lit(1)).alias("columns"), F.sum("n_rows").alias("cells"), F.sum("missing").alias("missing_cells"))


_FEAT = ", ".join(f"('{a}', '{m}', '{s}')" for a, m, s in registries.DERIVED_FEATURES)


@query("d44_feature_contract", f"""
select module, feature, case when bool_or(availability in ('FORBIDDEN_FUTURE', 'TARGET_SOURCE_ONLY')) then 'FORBIDDEN' when bool_or(availability like 'HOLD%') then 'BLOCKED' else 'READY' end status,
 cast(sum(missing) as bigint) source_missing from (select feature, module, unnest(string_split(sources, ';')) k from (values {_FEAT}) f(feature, module, sources)) left join ({_REG_SQL}) on k = tab || '.' || col group by 1, 2""")
def _(t):
    return registries.feature_contract(t.spark, registries.column_registry(t.spark, _all_columns(t)))


_GR = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in registries.GRAIN)


@query("d45_grain_compatibility", f"""select source_grain, grain_compatibility, count(*) columns, max(n_rows) n_rows from ({_REG_SQL}) join (values {_GR}) g(tab, source_grain, grain_compatibility) using (tab) group by 1, 2""")
def _(t):
    g = t.spark.createDataFrame(registries.GRAIN, "table_name string, source_grain string, grain_compatibility string")
    return _all_columns(t).join(g, "table_name").groupBy("source_grain", "grain_compatibility").agg(
        F.count(F.lit(1)).alias("columns"), F.max("n_rows").alias("n_rows"))


@query("d46_foreign_key_map", " union all ".join(
    f"select '{a}' source_table, '{k}' source_field, '{b}' target_table, count(distinct {k}) source_keys, (select count(distinct {k}) from e_{b}) target_keys from e_{a}" for _, a, b, k in RELATIONS))
def _(t):
    def one(a, b, k):
        src, dst = getattr(t, a), getattr(t, b)
        return src.agg(F.lit(a).alias("source_table"), F.lit(k).alias("source_field"), F.lit(b).alias("target_table"), F.countDistinct(k).alias("source_keys")).withColumn(
            "target_keys", dst.agg(F.countDistinct(k)).scalar())
    return q.union([one(a, b, k) for _, a, b, k in RELATIONS])


@query("d47_raw_audit_summary", """
select count(*) orders, strftime(min(order_purchase_timestamp), '%Y-%m-%d %H:%M:%S') first_purchase, strftime(max(order_purchase_timestamp), '%Y-%m-%d %H:%M:%S') last_purchase,
 round(100.0::double * count(*) filter (order_status = 'delivered') / count(*), 6) delivered_pct, (select round(100 * avg(late), 6) from o_task) late_pct from e_orders""")
def _(t):
    late = gold.task_orders(t.orders).agg(rnd(100 * F.avg("late")))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return t.orders.agg(F.count(F.lit(1)).alias("orders"), F.date_format(F.min("order_purchase_timestamp"), fmt).alias("first_purchase"),
                        F.date_format(F.max("order_purchase_timestamp"), fmt).alias("last_purchase"),
                        x.share(F.col("order_status") == "delivered").alias("delivered_pct")).withColumn("late_pct", late.scalar())
