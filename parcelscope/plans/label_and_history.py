"""Labels and observability (E); point-in-time history and curves (F/G ids: e*, g*)."""

from pyspark.sql import functions as F

from parcelscope.functions import columns as x
from parcelscope.functions.columns import DAY_US, n_if, rnd, us
from parcelscope.operators import gold, joins, label, pit, ranks
from parcelscope.plans.registry import query, shared

shared("o_labels", """
select *, cast(order_delivered_customer_date > order_estimated_delivery_date as int) timestamp_strict,
 cast(cast(order_delivered_customer_date as date) > cast(order_estimated_delivery_date as date) as int) calendar_day,
 cast(cast(order_delivered_customer_date as date) > cast(order_estimated_delivery_date as date) + 1 as int) calendar_day_plus_1_grace,
 (epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 3600000000.0::double margin_hours from o_task""")
_L = label.LABELS


def _labelled(t):
    return label.with_labels(gold.task_orders(t.orders))


@query("e1_three_labels", f"select order_id, {', '.join(_L)} from o_labels")
def _(t):
    return _labelled(t).select("order_id", *_L)


_Z = "1.959963984540054::double"


@query("e2_label_comparison", f"""
select label, n orders, k late_orders, round(100*p, 6) late_rate_pct, round(100*((p+z*z/(2*n))/(1+z*z/n) - z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n)), 6) ci_low_pct,
 round(100*((p+z*z/(2*n))/(1+z*z/n) + z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n)), 6) ci_high_pct, round(greatest(k, n-k)::double/n, 6) majority_accuracy
from (select *, k::double/n p, {_Z} z from (select count(*) n, unnest({_L}) label, unnest([{', '.join(f'cast(sum({k}) as bigint)' for k in _L)}]) k from o_labels))""")
def _(t):
    return label.label_comparison(_labelled(t))


@query("e3_label_confusion", """select timestamp_strict, calendar_day, count(order_id) n from (values (0,0),(0,1),(1,0),(1,1)) g(timestamp_strict, calendar_day)
left join o_labels using (timestamp_strict, calendar_day) group by 1, 2""")
def _(t):
    return joins.crosstab(_labelled(t), "timestamp_strict", "calendar_day", [0, 1], [0, 1])


_DIS = """(select count(*) orders, count(*) filter (timestamp_strict <> calendar_day) disagreements,
 count(*) filter (timestamp_strict <> calendar_day and cast(order_delivered_customer_date as date) = cast(order_estimated_delivery_date as date)) same_day,
 count(*) filter (calendar_day = 1 and timestamp_strict = 0) calendar_late_strict_ontime from o_labels)"""


@query("e3_label_disagreement", f"select *, round(100.0::double * same_day / nullif(disagreements, 0), 6) same_day_share_pct from {_DIS}")
def _(t):
    return label.disagreement(_labelled(t))


_TS = ["order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"]


def _tod(k):
    return f"""select '{k}' column_name, count({k}) rows_known, count(distinct strftime({k}, '%H:%M:%S')) unique_times,
 round(100.0::double * count(*) filter (strftime({k}, '%H:%M:%S') = '00:00:00') / count({k}), 6) midnight_pct from o_task"""


@query("e4_time_of_day", " union all ".join(_tod(k) for k in _TS))
def _(t):
    return label.time_of_day(gold.task_orders(t.orders), _TS)


_MQ = {"p01": .01, "p25": .25, "p50": .5, "p75": .75, "p99": .99}


@query("e5_margin_profile", " union all ".join(
    f"select '{v}' variable, count(*) n, round(avg({v}), 5) mean, " + ", ".join(f"round(quantile_cont({v}::double, {p}), 5) {k}" for k, p in _MQ.items()) + " from o_labels"
    for v in ("margin_hours", "lateness_calendar_days")))
def _(t):
    long = ranks.melt(_labelled(t), [], ["margin_hours", "lateness_calendar_days"])
    a = long.groupBy("variable").agg(F.count("value").alias("n"), rnd(F.avg("value"), 5).alias("mean"))
    return a.join(ranks.exact_quantiles(long, ["variable"], "value", _MQ), "variable").select("variable", "n", "mean", *[rnd(k, 5).alias(k) for k in _MQ])


def _bucket_sql(bands):
    case = "case " + " ".join(f"when lateness_calendar_days <= {b} then '{n}'" for b, n in bands[:-1]) + f" else '{bands[-1][1]}' end"
    vals = ", ".join(f"({i}, '{n}')" for i, (_, n) in enumerate(bands))
    return f"select position, bucket, count(order_id) n from (values {vals}) b(position, bucket) left join (select order_id, {case} k from o_task) on k = bucket group by 1, 2"


@query("e6_margin_buckets", _bucket_sql(label.MARGIN_BUCKETS))
def _(t):
    d = gold.task_orders(t.orders).select(label.banded("lateness_calendar_days", label.MARGIN_BUCKETS).alias("bucket"))
    return joins.fixed_buckets(d, "bucket", [n for _, n in label.MARGIN_BUCKETS])


@query("e6_delay_bands", _bucket_sql(label.DELAY_BANDS))
def _(t):
    d = gold.task_orders(t.orders).select(label.banded("lateness_calendar_days", label.DELAY_BANDS).alias("bucket"))
    return joins.fixed_buckets(d, "bucket", [n for _, n in label.DELAY_BANDS])


@query("e7_monthly_label_rates", "select purchase_month, count(*) orders, " + ", ".join(
    f"cast(sum({k}) as bigint) {k}_late, round(100.0::double * sum({k}) / count(*), 6) {k}_pct" for k in _L) + " from o_labels group by 1")
def _(t):
    cols = [c for k in _L for c in (F.sum(k).alias(f"{k}_late"), rnd(100.0 * F.sum(k) / F.count(F.lit(1))).alias(f"{k}_pct"))]
    return _labelled(t).groupBy("purchase_month").agg(F.count(F.lit(1)).alias("orders"), *cols)


_OBS = """(select order_id, strftime(order_purchase_timestamp, '%Y-%m') purchase_month, case
 when a is null and e <= z and not term then 'OUTCOME_UNOBSERVED_BY_DATASET_END' when a is null and e > z and not term then 'RIGHT_CENSORING_CANDIDATE'
 when a is not null and order_status <> 'delivered' then 'OUTCOME_PRESENT_STATUS_MISMATCH' when term then 'NOT_APPLICABLE_TERMINAL_NON_DELIVERY'
 when a is not null then 'OBSERVED_DELIVERED' else 'OTHER_REVIEW' end observation_class from (select *, order_delivered_customer_date a, order_estimated_delivery_date e,
 order_status in ('canceled','unavailable') term, (select max(order_delivered_customer_date) from e_orders) z from e_orders))"""


@query("e8_observation_class", f"select order_id, observation_class from {_OBS}")
def _(t):
    return label.observation_class(t.orders).select("order_id", "observation_class")


@query("e8_observation_summary", f"select observation_class, count(*) orders, round(100.0::double * count(*) / (select count(*) from e_orders), 6) pct_source from {_OBS} group by 1")
def _(t):
    g = label.observation_class(t.orders).groupBy("observation_class").agg(F.count(F.lit(1)).alias("orders"))
    return g.withColumn("pct_source", rnd(100.0 * F.col("orders") / g.agg(F.sum("orders")).scalar()))


@query("e9_observability_by_month", f"select purchase_month, count(*) orders, count(*) filter (observation_class = 'OBSERVED_DELIVERED') observed, round(100.0::double * count(*) filter (observation_class = 'OBSERVED_DELIVERED') / count(*), 6) observed_pct from {_OBS} group by 1")
def _(t):
    ok = F.col("observation_class") == "OBSERVED_DELIVERED"
    return label.observation_class(t.orders).groupBy(x.month_key("order_purchase_timestamp").alias("purchase_month")).agg(
        F.count(F.lit(1)).alias("orders"), n_if(ok).alias("observed"), x.share(ok).alias("observed_pct"))


@query("e10_label_recommendation", f"""
select disagreements, round(100.0::double * same_day / disagreements, 6) same_day_share_pct, m midnight_pct, case when m >= 99 and disagreements > 0 and 100.0 * same_day / disagreements >= 95
 then 'CALENDAR_DAY_RECOMMENDED_PENDING_BUSINESS_CONFIRMATION' else 'BUSINESS_RULE_REVIEW_REQUIRED' end recommendation from {_DIS}, (select midnight_pct m from ({_tod(_TS[2])}))""")
def _(t):
    return label.recommendation(label.disagreement(_labelled(t)), label.time_of_day(gold.task_orders(t.orders), [_TS[2]]))


_FOLDS = """(select m purchase_month, cast(strptime(m || '-01', '%Y-%m-%d') as timestamp) cut from (select distinct purchase_month m from o_task))"""


@query("e11_label_maturity_folds", f"""
select *, case when train_rows = 0 then 'EMPTY' when train_pos = 0 or train_pos = train_rows then 'SINGLE_CLASS_TRAIN' when test_pos = 0 or test_pos = test_rows then 'SINGLE_CLASS_TEST' else 'READY' end status
from (select f.purchase_month "month", count(*) filter (k.purchase_month = f.purchase_month) test_rows, count(*) filter (k.purchase_month = f.purchase_month and late = 1) test_pos,
 count(*) filter (order_purchase_timestamp < cut and order_delivered_customer_date < cut) train_rows, count(*) filter (order_purchase_timestamp < cut and order_delivered_customer_date < cut and late = 1) train_pos,
 count(*) filter (order_purchase_timestamp < cut and order_delivered_customer_date >= cut) immature_rows from {_FOLDS} f, o_task k group by 1)""")
def _(t):
    return label.maturity_folds(gold.task_orders(t.orders))


# fixed values: counts of the frozen label contract
_FROZEN = {"orders": 96470, "positive_orders": 6534, "negative_orders": 89936}


@query("e12_frozen_contract", f"""
select k check_name, case when o = e then 'PASS' else 'FAIL' end status, cast(o as varchar) observed, cast(e as varchar) expected from (
 select unnest(['orders','positive_orders','negative_orders','calendar_late_strict_ontime','classes_add_up']) k, unnest([n, p, n - p, c, n]) o, unnest([96470, 6534, 89936, 0, n]) e
 from (select count(*) n, cast(sum(calendar_day) as bigint) p, count(*) filter (calendar_day = 1 and timestamp_strict = 0) c from o_labels))""")
def _(t):
    n, p = F.count(F.lit(1)), F.sum("calendar_day").cast("long")
    a = _labelled(t).agg(n.alias("orders"), p.alias("positive_orders"), (n - p).alias("negative_orders"),
                         n_if((F.col("calendar_day") == 1) & (F.col("timestamp_strict") == 0)).alias("calendar_late_strict_ontime"))
    want = {**{k: F.lit(v).cast("long") for k, v in _FROZEN.items()}, "calendar_late_strict_ontime": F.lit(0).cast("long")}
    rows = [F.struct(F.lit(k).alias("check_name"), F.col(k).alias("o"), v.alias("e")) for k, v in want.items()]
    rows.append(F.struct(F.lit("classes_add_up").alias("check_name"), (F.col("positive_orders") + F.col("negative_orders")).alias("o"), F.col("orders").alias("e")))
    d = a.select(F.inline(F.array(*rows)))
    return d.select("check_name", F.when(F.col("o") == F.col("e"), "PASS").otherwise("FAIL").alias("status"),
                    F.col("o").cast("string").alias("observed"), F.col("e").cast("string").alias("expected"))


# ---------------------------------------------------------------- G history
shared("o_pair", "select distinct order_id, seller_id from e_items")
shared("o_buy", "select seller_id, order_purchase_timestamp bt from o_pair join e_orders using (order_id)")
shared("o_done", "select seller_id, order_delivered_customer_date dt, late from o_pair join o_task using (order_id)")
shared("o_cur", "select order_id, seller_id, order_purchase_timestamp t0 from o_pair join o_task using (order_id)")
shared("o_history", """
select c.*, coalesce(b.n, 0) seller_prior_order_count, coalesce(b.n30, 0) seller_order_volume_30d, coalesce(o.n, 0) seller_prior_outcome_count, coalesce(o.l, 0) seller_prior_late_count,
 coalesce(o.n30, 0) seller_outcomes_30d, coalesce(o.l30, 0) seller_late_30d, coalesce(o.n90, 0) seller_outcomes_90d, coalesce(o.l90, 0) seller_late_90d,
 epoch_us(b.mx) latest_prior_purchase_us, epoch_us(o.mx) latest_prior_outcome_us from o_cur c
left join (select order_id, seller_id, count(*) n, count(*) filter (bt >= t0 - interval 30 day) n30, max(bt) mx from o_cur join o_buy using (seller_id) where bt < t0 group by 1, 2) b using (order_id, seller_id)
left join (select order_id, seller_id, count(*) n, count(*) filter (late = 1) l, count(*) filter (dt >= t0 - interval 30 day) n30, count(*) filter (late = 1 and dt >= t0 - interval 30 day) l30,
 count(*) filter (dt >= t0 - interval 90 day) n90, count(*) filter (late = 1 and dt >= t0 - interval 90 day) l90, max(dt) mx from o_cur join o_done using (seller_id) where dt < t0 group by 1, 2) o using (order_id, seller_id)""")
_H = pit.HISTORY_COUNTS


def _history(t):
    return t.stage("history", lambda: pit.seller_history(t.orders, t.items, gold.task_orders(t.orders)))


@query("g1_seller_history", f"""select order_id, seller_id, {', '.join(_H)}, latest_prior_purchase_us, latest_prior_outcome_us, round(seller_prior_late_count::double / nullif(seller_prior_outcome_count, 0), 6) seller_prior_late_rate,
 round(seller_late_30d::double / nullif(seller_outcomes_30d, 0), 6) seller_late_rate_30d, round(seller_late_90d::double / nullif(seller_outcomes_90d, 0), 6) seller_late_rate_90d from o_history""")
def _(t):
    rates = ["seller_prior_late_rate", "seller_late_rate_30d", "seller_late_rate_90d"]
    return _history(t).select("order_id", "seller_id", *_H, "latest_prior_purchase_us", "latest_prior_outcome_us", *[rnd(r).alias(r) for r in rates])


@query("g2_leakage_counters", """
select count(*) n_rows, count(*) filter (latest_prior_purchase_us >= epoch_us(t0)) purchase_leaks, count(*) filter (latest_prior_outcome_us >= epoch_us(t0)) outcome_leaks,
 count(*) filter (seller_prior_late_count > seller_prior_outcome_count) late_above_observed, count(*) - count(distinct (order_id, seller_id)) duplicate_keys from o_history""")
def _(t):
    h = _history(t)
    return h.agg(F.count(F.lit(1)).alias("n_rows"), n_if(F.col("latest_prior_purchase_us") >= F.col("t0")).alias("purchase_leaks"),
                 n_if(F.col("latest_prior_outcome_us") >= F.col("t0")).alias("outcome_leaks"),
                 n_if(F.col("seller_prior_late_count") > F.col("seller_prior_outcome_count")).alias("late_above_observed"),
                 (F.count(F.lit(1)) - F.countDistinct(F.struct("order_id", "seller_id"))).alias("duplicate_keys"))


@query("g3_history_bruteforce_audit")
def _(t):
    brute = pit.history_brute_force(t.orders, t.items, gold.task_orders(t.orders), one_in=20)
    j = brute.alias("b").join(_history(t).alias("h"), ["order_id", "seller_id"])
    return j.agg(F.count(F.lit(1)).alias("sampled"), *[n_if(~F.col(f"b.{k}").eqNullSafe(F.col(f"h.{k}"))).alias(f"{k}_mismatches") for k in _H])


@query("g4_history_coverage", """
select 'ORDER_SELLER' grain, count(*) denominator, count(*) filter (seller_prior_order_count > 0) has_purchase, count(*) filter (seller_prior_outcome_count > 0) has_outcome from o_history
union all select 'ORDER_ANY', count(*), count(*) filter (a), count(*) filter (b) from (select order_id, bool_or(seller_prior_order_count > 0) a, bool_or(seller_prior_outcome_count > 0) b from o_history group by 1)
union all select 'ORDER_ALL', count(*), count(*) filter (a), count(*) filter (b) from (select order_id, bool_and(seller_prior_order_count > 0) a, bool_and(seller_prior_outcome_count > 0) b from o_history group by 1)""")
def _(t):
    p, o = F.col("seller_prior_order_count") > 0, F.col("seller_prior_outcome_count") > 0
    per = _history(t).groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), n_if(p).alias("np"), n_if(o).alias("no"))

    def row(grain, n, a, b):
        return per.agg(F.lit(grain).alias("grain"), n.alias("denominator"), a.alias("has_purchase"), b.alias("has_outcome"))
    n = F.count(F.lit(1))
    return (row("ORDER_SELLER", F.sum("n"), F.sum("np"), F.sum("no"))
            .unionByName(row("ORDER_ANY", n, n_if(F.col("np") > 0), n_if(F.col("no") > 0)))
            .unionByName(row("ORDER_ALL", n, n_if(F.col("np") == F.col("n")), n_if(F.col("no") == F.col("n")))))


@query("g5_history_profile", " union all ".join(
    f"select '{k}' variable, min({k}) min, round(median({k}), 6) median, round(quantile_cont({k}::double, .95), 6) p95, round(quantile_cont({k}::double, .99), 6) p99, max({k}) max, round(100.0::double * count(*) filter ({k} = 0) / count(*), 6) zero_pct from o_history" for k in _H))
def _(t):
    long = ranks.melt(_history(t), [], _H)
    a = long.groupBy("variable").agg(F.min("value").cast("long").alias("min"), F.max("value").cast("long").alias("max"), x.share(F.col("value") == 0).alias("zero_pct"))
    q = ranks.exact_quantiles(long, ["variable"], "value", {"median": .5, "p95": .95, "p99": .99})
    return a.join(q, "variable").select("variable", "min", "max", "zero_pct", *[rnd(k).alias(k) for k in ("median", "p95", "p99")])


shared("o_curve_ev", "select order_purchase_timestamp et, cast(coalesce(c, 0) as bigint) cents from e_orders left join (select order_id, sum(cast(round(freight_value*100) as bigint)) c from e_items group by 1) using (order_id)")
shared("o_curve", """
select k.order_id, k.purchase_month, cast((epoch_us(k.order_purchase_timestamp) - epoch_us(et) - 1) // 86400000000 as int) lag, count(*) volume, cast(sum(cents) as bigint) freight_cents
from o_task k join o_curve_ev on et < k.order_purchase_timestamp and et >= k.order_purchase_timestamp - interval 90 day group by 1, 2, 3""")


def _curve_events(t):
    """All purchases with their order freight in cents (integers keep prefix differences exact)."""
    f = t.items.groupBy("order_id").agg(F.sum(F.round(F.col("freight_value") * 100).cast("long")).alias("c"))
    return t.orders.join(f, "order_id", "left").select(us("order_purchase_timestamp").alias("t"), F.lit(1).cast("long").alias("volume"),
                                                       F.coalesce("c", F.lit(0)).alias("freight_cents"))


_CHANNELS = ["volume", "freight_cents"]


def _targets(t):
    return gold.task_orders(t.orders).select("order_id", us("order_purchase_timestamp").alias("t0"))


def _curves(t):
    """Curves of all targets as arrays. They are swept anew where they are used: that costs less than keeping them."""
    return pit.day_curves(_curve_events(t), _targets(t).distinct(), _CHANNELS)


def _total(array):
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, v: a + v)


@query("g6_volume_curve", """select k.order_id, cast(coalesce(sum(volume), 0) as bigint) total_90, cast(coalesce(sum(volume * (lag + 1)), 0) as bigint) lag_moment, coalesce(max(volume), 0) peak
from o_task k left join o_curve using (order_id) group by 1""")
def _(t):
    v = F.col("volume")
    d = _curves(t).select("order_id", _total(v).alias("_n"), _total(F.transform(v, lambda x, i: x * (i + 1))).alias("_m"), F.array_max(v).alias("_p"))
    return d.groupBy("order_id").agg(F.sum("_n").alias("total_90"), F.sum("_m").alias("lag_moment"), F.max("_p").alias("peak"))


@query("g7_freight_curve_by_month", """select m.purchase_month, l.lag, cast(coalesce(sum(volume), 0) as bigint) volume, cast(coalesce(sum(freight_cents), 0) as bigint) freight_cents
from (select distinct purchase_month from o_task) m cross join (select cast(i as int) lag from range(0, 90) r(i)) l left join o_curve c on c.purchase_month = m.purchase_month and c.lag = l.lag group by 1, 2""")
def _(t):
    m = x.month_key(F.timestamp_micros("t0")).alias("purchase_month")
    return pit.curve_cells(_curves(t), _CHANNELS).groupBy(m, "lag").agg(F.sum("volume").alias("volume"), F.sum("freight_cents").alias("freight_cents"))


@query("g8_window_totals", """select k.order_id, cast(coalesce(sum(volume) filter (lag < 30), 0) as bigint) v30, cast(coalesce(sum(volume) filter (lag < 60), 0) as bigint) v60, cast(coalesce(sum(volume), 0) as bigint) v90, 1 nested
from o_task k left join o_curve using (order_id) group by 1""")
def _(t):
    days = (30, 60, 90)
    d = _curves(t).select("order_id", *[_total(F.slice("volume", 1, k)).alias(f"v{k}") for k in days])
    g = d.groupBy("order_id").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in days])
    return g.withColumn("nested", ((F.col("v30") <= F.col("v60")) & (F.col("v60") <= F.col("v90"))).cast("int"))


@query("g9_direct_curve_check")
def _(t):
    ch = _CHANNELS
    b = pit.direct_curves(_curve_events(t), _targets(t), ch, one_in=20).select("order_id", "lag", *[F.col(k).alias(f"d_{k}") for k in ch])
    a = pit.curve_cells(_curves(t).filter(pit.in_sample(20)), ch).filter("volume > 0").select("order_id", "lag", *ch)
    j = joins.membership_join(a, b, ["order_id", "lag"])
    return j.agg(F.count(F.lit(1)).alias("compared"), n_if(~F.col("volume").eqNullSafe(F.col("d_volume"))).alias("volume_mismatches"),
                 n_if(~F.col("freight_cents").eqNullSafe(F.col("d_freight_cents"))).alias("freight_mismatches"))


@query("g10_history_support", """
select purchase_month, count(*) orders, """ + ", ".join(f"count(*) filter (order_purchase_timestamp - interval {d} day >= z) full_{d}d" for d in (30, 60, 90))
       + " from o_task, (select min(order_purchase_timestamp) z from e_orders) group by 1")
def _(t):
    start = t.orders.agg(F.min(us("order_purchase_timestamp"))).scalar()
    d = gold.task_orders(t.orders).withColumns({"_t": us("order_purchase_timestamp"), "_z": start})
    return d.groupBy("purchase_month").agg(F.count(F.lit(1)).alias("orders"), *[n_if(F.col("_t") - k * DAY_US >= F.col("_z")).alias(f"full_{k}d") for k in (30, 60, 90)])


@query("g11_calendar_features", """
select order_id, cast(hour(p) as int) purchase_hour, cast(isodow(p) - 1 as int) purchase_weekday, cast(day(p) as int) purchase_day, cast(month(p) as int) purchase_month, cast(quarter(p) as int) purchase_quarter,
 cast(isodow(p) >= 6 as int) is_weekend from (select order_id, order_purchase_timestamp p from e_orders)""")
def _(t):
    p = "order_purchase_timestamp"
    return t.orders.select("order_id", F.hour(p).alias("purchase_hour"), F.weekday(p).alias("purchase_weekday"), F.dayofmonth(p).alias("purchase_day"),
                           F.month(p).alias("purchase_month"), F.quarter(p).alias("purchase_quarter"), (F.weekday(p) >= 5).cast("int").alias("is_weekend"))


@query("g12_promised_lead_days", "select order_id, datediff('day', cast(order_purchase_timestamp as date), cast(order_estimated_delivery_date as date)) promised_lead_days from e_orders")
def _(t):
    return t.orders.select("order_id", F.datediff(x.day("order_estimated_delivery_date"), x.day("order_purchase_timestamp")).alias("promised_lead_days"))


@query("g13_feature_recomputation", "select count(*) orders, 0 missing_in_one, 0 count_mismatches, 0 value_mismatches from o_core")
def _(t):
    """Second route: distinct sets instead of grouped counts, decimals instead of doubles."""
    a = gold.order_core(t.items)
    s = t.items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).alias("p"),
                                                      F.sum(F.col("freight_value").cast("decimal(18,2)")).alias("f"), F.max("price").alias("mx"))
    sellers = t.items.select("order_id", "seller_id").distinct().groupBy("order_id").agg(F.count(F.lit(1)).alias("r_sellers"))
    b = s.groupBy("order_id").agg(F.sum("n").alias("r_items"), F.count(F.lit(1)).alias("r_products"), F.sum("p").cast("double").alias("r_price"),
                                  F.sum("f").cast("double").alias("r_freight"), F.max("mx").alias("r_max")).join(sellers, "order_id")
    j = joins.membership_join(a, b, ["order_id"])
    cnt = (~F.col("item_count").eqNullSafe(F.col("r_items")) | ~F.col("unique_product_count").eqNullSafe(F.col("r_products"))
           | ~F.col("unique_seller_count").eqNullSafe(F.col("r_sellers")))
    val = ((F.abs(F.col("total_price") - F.col("r_price")) > 1e-6) | (F.abs(F.col("total_freight") - F.col("r_freight")) > 1e-6) | (F.col("max_price") != F.col("r_max")))
    return j.agg(F.count(F.lit(1)).alias("orders"), n_if(F.col("membership") != "both").alias("missing_in_one"), n_if(cnt).alias("count_mismatches"), n_if(val).alias("value_mismatches"))
