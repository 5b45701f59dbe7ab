"""Expected freight and shipping-friction queries (I)."""

from pyspark.sql import functions as F

from parcelscope.functions import columns as x
from parcelscope.functions.columns import n_if, ratio, rnd
from parcelscope.operators import freight as fr
from parcelscope.operators import geo, models, ranks
from parcelscope.operators.checks import union
from parcelscope.plans.registry import query, shared
from parcelscope.plans.routes_and_context import routes, task


def _l(k):
    return f"case when {k} >= 0 then ln(1 + {k}) end"


shared("o_log", f"""select *, {_l('seller_freight')} log_freight, {_l('distance_km')} log_distance, {_l('seller_weight_g')} log_weight, {_l('seller_volume_cm3')} log_volume, {_l('seller_price')} log_price from o_routes""")
shared("o_months", "select year_month ym, row_number() over (order by year_month) i from (select distinct year_month from o_routes)")
shared("o_f0", "select ym, count(log_freight) n_train, median(log_freight) med from o_months join o_log on year_month < ym where i > 3 group by 1")
shared("o_exp", """select order_id, year_month, cast(sum(cast(round(p, 8) as decimal(28, 8))) as double) expected_freight_oot, cast(sum(cast(round(seller_freight, 8) as decimal(28, 8))) as double) total_freight, cast(sum(cast(round(seller_price, 8) as decimal(28, 8))) as double) total_price
 from (select *, case when med is not null then greatest(0, exp(med) - 1) end p from o_log left join o_f0 on ym = year_month) group by 1, 2""")
_E = "1e-8::double"
shared("o_fric", f"""select e.*, k.late, freight_burden / 1.0 b0, ln((total_freight + {_E}) / (expected_freight_oot + {_E})) freight_log_ratio, total_freight / expected_freight_oot freight_expected_ratio,
 total_freight - expected_freight_oot freight_residual_abs, (total_freight - expected_freight_oot) / expected_freight_oot freight_residual_relative
 from (select *, case when total_price > 0 and total_freight >= 0 then total_freight / (total_price + total_freight) end freight_burden, case when total_price > 0 and total_freight >= 0 then total_freight / total_price end freight_to_price_ratio,
  case when total_price > 0 and total_freight >= 0 then ln((total_freight + {_E}) / (total_price + {_E})) end log_freight_to_price_ratio from o_exp) e join o_task k using (order_id)""")
shared("o_mm", "select year_month m, med, 1.4826::double * median(abs(freight_log_ratio - med)) sm from o_fric join (select year_month y, median(freight_log_ratio) med from o_fric group by 1) on y = year_month group by 1, 2")
shared("o_z", f"""select f.*, case when sm > {_E} then (freight_log_ratio - med) / sm end freight_log_ratio_month_z, order_delivered_customer_date, order_estimated_delivery_date,
 (epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400000000.0::double gap from o_fric f left join o_mm on m = year_month join o_task using (order_id)""")


def logged(t):
    return fr.log_features(routes(t))


def expected(t):
    return t.stage("expected", lambda: fr.order_expected(fr.expected_median(logged(t))), "order_id")


def friction_rows(t):
    """Expected and observed freight of orders with their label and times: what friction is derived from, row by row."""
    def build():
        return expected(t).join(task(t).select("order_id", "late", "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"), "order_id")
    return t.stage("friction_rows", build, "order_id")


def friction(t):
    return fr.friction_core(friction_rows(t).drop("order_purchase_timestamp"))


def friction_z(t):
    """Friction with the month's robust z and the gaps: only the months' medians are staged, the rest is one step on a row."""
    return with_z(t, friction(t))


def with_z(t, f):
    stats = t.stage("friction_months", lambda: ranks.median_mad(friction(t), ["year_month"], "freight_log_ratio"))
    return fr.service_performance(fr.robust_month_z(f, stats=stats))


_LF = ["log_freight", "log_distance", "log_weight", "log_volume", "log_price"]


@query("i1_log_features", f"select order_id, seller_id, {', '.join(f'round({k}, 6) {k}' for k in _LF)} from o_log")
def _(t):
    return logged(t).select("order_id", "seller_id", *[rnd(k).alias(k) for k in _LF])


@query("i2_expanding_folds", """select ym test_month, (select count(*) from o_routes r where r.year_month = ym) n_test, (select count(log_freight) from o_log l where l.year_month < ym) n_train,
 (select min(ym) from o_months) train_start, (select max(z.ym) from o_months z where z.i = o.i - 1) train_end from o_months o where i > 3""")
def _(t):
    return fr.fold_plan(logged(t))


@query("i3_f0_expanding_median", "select ym fold, n_train, round(med, 6) median from o_f0")
def _(t):
    r = logged(t)
    months = fr.months_of(r)
    return ranks.expanding_median(r, "year_month", "log_freight", months).filter(F.col("fold").isin(months[3:])).withColumn("median", rnd("median"))


@query("i4_f1_single_feature_ols", """select ym fold, round(regr_intercept(log_freight, log_price), 6) intercept, round(regr_slope(log_freight, log_price), 6) slope
from o_months join o_log on year_month < ym where i > 3 and log_freight is not null and log_price is not null group by 1 having count(*) >= 100""")
def _(t):
    r = logged(t)
    c = models.expanding_ols(r, "year_month", fr.months_of(r), ["log_price"], "log_freight")
    return t.spark.createDataFrame([(m, round(float(b[0]), 6), round(float(b[1]), 6)) for m, b in c.items()], "fold string, intercept double, slope double")


@query("i4_f1_expected_linear")
def _(t):
    return fr.order_expected(fr.expected_linear(logged(t))).select("order_id", "year_month", rnd("expected_freight_oot").alias("expected_freight_oot"))


def boosted(t):
    """Route rows with F2's prediction: 100 rounds, a fit for each month."""
    return t.stage("boosted", lambda: fr.expected_boosted(logged(t)))


@query("i5_f2_expected_boosted")
def _(t):
    return fr.order_expected(boosted(t)).select("order_id", "year_month", rnd("expected_freight_oot").alias("expected_freight_oot"))


@query("i6_order_expected", """select order_id, year_month, round(expected_freight_oot, 8) expected_freight_oot, round(total_freight, 8) total_freight, round(total_freight - expected_freight_oot, 8) freight_residual,
 round(case when expected_freight_oot > 0 then total_freight / expected_freight_oot end, 6) freight_ratio_to_expected from o_exp""")
def _(t):
    # sums have eight decimals; fewer would round ties
    r8 = ("expected_freight_oot", "total_freight", "freight_residual")
    return expected(t).select("order_id", "year_month", *[rnd(k, 8).alias(k) for k in r8], rnd("freight_ratio_to_expected").alias("freight_ratio_to_expected"))


@query("i7_regression_metrics", """select count(*) n_rows, count(e) n, round(avg(abs(e)), 6) mae, round(sqrt(avg(e*e)), 6) rmse, round(1 - sum(e*e) / (var_pop(total_freight) filter (e is not null) * count(e)), 6) r2,
 round(count(e)::double / count(*), 6) coverage, round(median(abs(e)), 6) median_ae from (select *, total_freight - expected_freight_oot e from o_exp)""")
def _(t):
    return fr.regression_metrics(expected(t), "total_freight", "expected_freight_oot")


@query("i7_model_comparison")
def _(t):
    r = logged(t)

    def m(name, scored):
        return fr.regression_metrics(fr.back_transform(scored), "seller_freight", "pred_freight").withColumn("model", F.lit(name))
    return union([m("F0", fr.expected_median(r)), m("F1", fr.expected_linear(r)), m("F2", boosted(t))])


def second_route(t):
    """The expanding median by another way: cells between approximate quantiles, summed on the driver."""
    r = logged(t)
    med = ranks.expanding_median_by_edges(r, "year_month", "log_freight", fr.months_of(r)[3:])
    return fr.order_expected(r.join(F.broadcast(med.select(F.col("fold").alias("year_month"), F.col("median").alias("pred_log"))), "year_month", "left"))


@query("i8_parity_audit", """select count(*) "both", 0 left_only, 0 right_only, 0 null_mismatch, 0 value_mismatch, 0.0::double max_abs_diff from o_exp""")
def _(t):
    return fr.parity_audit(expected(t), second_route(t), "order_id", "expected_freight_oot")


@query("i8_parity_by_month", """select year_month, count(*) n, count(expected_freight_oot) n_compared, case when count(expected_freight_oot) > 0 then 0.0::double end median_difference,
 case when count(expected_freight_oot) > 0 then 0.0::double end max_abs_diff from o_exp group by 1""")
def _(t):
    """Both routes of the expanding median by month, with the median of their signed differences."""
    left, right = expected(t), second_route(t)
    return fr.parity_by_period(left, right, "order_id", "year_month", "expected_freight_oot")


@query("i9_availability_reason", """select availability_reason, serving_model, count(*) n, round(count(*)::double / (select count(*) from e_orders), 6) share from (
 select case when expected_freight_oot is not null then 'AVAILABLE' when e.order_id is null then 'NO_ROUTE_ORDER_MEMBERSHIP' when year_month in (select ym from o_months where i <= 3) then 'WARMUP_MIN_TRAIN_MONTHS' else 'UNEXPECTED_POST_WARMUP_MISSING' end availability_reason,
 case when expected_freight_oot is not null then 'M1_ELIGIBLE' else 'M0_FALLBACK' end serving_model from e_orders o left join o_exp e on e.order_id = o.order_id) group by 1, 2""")
def _(t):
    e = expected(t)
    a = fr.availability(t.orders, e, fr.months_of(task(t).select(F.col("purchase_month").alias("year_month")))[:3])
    g = a.groupBy("availability_reason", "serving_model").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", rnd(F.col("n") / t.orders.agg(F.count(F.lit(1))).scalar()))


_FC = ["freight_burden", "freight_to_price_ratio", "log_freight_to_price_ratio", "freight_residual_abs", "freight_expected_ratio", "freight_residual_relative", "freight_log_ratio"]


@query("i10_friction_core", f"select order_id, {', '.join(f'round({k}, 8) {k}' for k in _FC)} from o_fric")
def _(t):
    return friction(t).select("order_id", *[rnd(k, 8).alias(k) for k in _FC])


@query("i11_monthly_robust_z", "select order_id, year_month, round(freight_log_ratio_month_z, 5) freight_log_ratio_month_z from o_z")
def _(t):
    return friction_z(t).select("order_id", "year_month", rnd("freight_log_ratio_month_z", 5).alias("freight_log_ratio_month_z"))


@query("i12_identity_checks", """select 0 burden_identity_violations, 0 burden_out_of_range, 0 months_off_centre, count(distinct year_month) filter (freight_log_ratio_month_z is not null) months_checked from o_z""")
def _(t):
    return fr.identity_checks(friction_z(t))


_QP = {"p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95}
_QF = ["freight_burden", "freight_to_price_ratio", "freight_expected_ratio", "freight_log_ratio_month_z"]


@query("i13_friction_quantiles", " union all ".join(f"select '{k}' field, " + ", ".join(f"round(quantile_cont({k}, {p}), 5) {n}" for n, p in _QP.items()) + " from o_z" for k in _QF))
def _(t):
    return fr.quantile_table(friction_z(t), _QF, _QP, 5)


@query("i14_high_burden_flags", " union all ".join(f"select '{q}' threshold, round(a, 6) burden_at, count(*) filter (freight_burden >= a) flagged, count(freight_burden) n from o_z, (select quantile_cont(freight_burden, {p}) a from o_z) group by a" for q, p in [("q75", .75), ("q80", .8), ("q90", .9)]))
def _(t):
    z = friction(t)
    out = []
    for name, p in [("q75", .75), ("q80", .8), ("q90", .9)]:
        d = fr.with_thresholds(z, {"_a": ("freight_burden", p)})
        out.append(d.agg(F.lit(name).alias("threshold"), rnd(F.first("_a")).alias("burden_at"), n_if(F.col("freight_burden") >= F.col("_a")).alias("flagged"), F.count("freight_burden").alias("n")))
    return union(out)


def _bin_sql(col, n, src):
    edges = "list_sort(list_distinct([" + ", ".join(f"quantile_cont({col}::double, {i / n})" for i in range(n + 1)) + "]))"
    return f"(select s.*, greatest(len(list_filter(edges, lambda e: e < {col})) - 1, 0) bin from {src} s, (select {edges} edges from {src}) where {col} is not null)"


@query("i14_quartile_segments", f"select bin, count(*) n, round(avg(freight_burden), 5) freight_burden_mean, round(median(total_price), 5) total_price_median, round(median(freight_burden), 5) freight_burden_median from {_bin_sql('total_price', 4, 'o_fric')} group by 1")
def _(t):
    return fr.binned_medians(friction(t), "total_price", 4, ["freight_burden"])


_ROUTE_SEGMENTS = ["distance_freight_weighted_km", "total_weight_g", "total_volume_cm3"]


@query("i14_route_quartile_segments", " union all ".join(
    f"select '{k}' variable, bin, count(*) n, round(avg(freight_burden), 5) freight_burden_mean, round(median({k}), 5) variable_median, round(median(freight_burden), 5) freight_burden_median "
    f"from {_bin_sql(k, 4, f'(select freight_burden, {k} from o_fric join o_oroutes using (order_id))')} group by 2" for k in _ROUTE_SEGMENTS))
def _(t):
    """Quartiles of distance, weight and volume of the orders with a route."""
    o = friction(t).select("order_id", "freight_burden").join(geo.order_routes(routes(t)).select("order_id", *_ROUTE_SEGMENTS), "order_id")
    return fr.segment_medians(o, _ROUTE_SEGMENTS, 4, "freight_burden")


@query("i15_route_structure_groups", " union all ".join(f"select '{k}' group_variable, g::int group_level, count(*) n, round(avg(freight_burden), 6) burden_mean, round(median(freight_burden), 6) burden_median from (select cast({e} as int) g, freight_burden from o_fric join o_oroutes using (order_id)) where g is not null group by 2"
                                                        for k, e in [("multi_seller_order", "route_sellers_total > 1"), ("any_interstate_route", "any_interstate_route")]))
def _(t):
    o = geo.order_routes(routes(t)).select("order_id", (F.col("route_sellers_total") > 1).cast("int").alias("multi_seller_order"), "any_interstate_route")
    long = friction(t).join(o, "order_id").unpivot(["freight_burden"], ["multi_seller_order", "any_interstate_route"], "group_variable", "group_level").filter("group_level is not null")
    k = ["group_variable", "group_level"]
    a = long.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("freight_burden")).alias("burden_mean"))
    m = ranks.exact_quantiles(long, k, "freight_burden", {"burden_median": .5})
    return a.join(m.withColumn("burden_median", rnd("burden_median")), k)


_SUMMARY = ["distance_freight_weighted_km", "total_weight_g", "total_volume_cm3"]


def route_summary(t):
    """What the burden frame takes from the orders' routes."""
    return geo.order_routes(routes(t)).select("order_id", *_SUMMARY, (F.col("route_sellers_total") > 1).cast("int").alias("multi_seller"), F.col("any_interstate_route").alias("interstate"), "single_seller_order")


def with_logs(d):
    return d.withColumns({"log_price": x.guarded_log1p("total_price"), "log_distance": x.guarded_log1p("distance_freight_weighted_km"),
                          "log_weight": x.guarded_log1p("total_weight_g"), "log_volume": x.guarded_log1p("total_volume_cm3")})


def burden_frame(t):
    """Order-level burden with log design columns."""
    return with_logs(friction(t).join(route_summary(t), "order_id"))


@query("i16_scenario_effect")
def _(t):
    d = burden_frame(t)
    xs = ["log_price", "log_distance", "log_weight", "interstate"]
    fit = models.logit(d, "freight_burden", xs)
    rows = {f"{k}_PLUS_10PCT": {k: fr.log1p_scaled(k, 0.1)} for k in ("log_price", "log_distance", "log_weight")}
    rows["interstate_0_TO_1"] = {"interstate": F.lit(1)}
    return union([fr.scenario_effect(d, fit, alter).select(F.lit(n).alias("scenario"), "n", *[rnd(k, 8).alias(k) for k in ("mean", "median", "p10", "p90")]) for n, alter in rows.items()])


@query("i17_service_performance", """select order_id, round(gap, 8) delivery_gap_days_continuous, datediff('day', cast(order_estimated_delivery_date as date), cast(order_delivered_customer_date as date)) delivery_gap_days_calendar,
 round(greatest(gap, 0), 8) positive_tardiness_days, round(greatest(-gap, 0), 8) early_days from (select *, (epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400000000.0::double gap from o_task)""")
def _(t):
    c = ("delivery_gap_days_continuous", "positive_tardiness_days", "early_days")
    return fr.service_performance(task(t)).select("order_id", "delivery_gap_days_calendar", *[rnd(k, 8).alias(k) for k in c])


@query("i18_definition_consistency", """select count(*) n, count(*) filter (late = 1 and d > 0) late_and_positive, count(*) filter (late = 0 and d <= 0) ontime_and_nonpositive, count(*) filter ((late = 1) <> (d > 0)) calendar_mismatch,
 count(*) filter ((late = 1) <> (order_delivered_customer_date > order_estimated_delivery_date)) continuous_mismatch from (select *, lateness_calendar_days d from o_task)""")
def _(t):
    late, d, g = F.col("late") == 1, F.col("delivery_gap_days_calendar"), F.col("delivery_gap_days_continuous")
    return fr.service_performance(task(t)).agg(F.count(F.lit(1)).alias("n"), n_if(late & (d > 0)).alias("late_and_positive"), n_if(~late & (d <= 0)).alias("ontime_and_nonpositive"),
                                               n_if(late != (d > 0)).alias("calendar_mismatch"), n_if(late != (g > 0)).alias("continuous_mismatch"))


@query("i19_service_monthly", """select purchase_month, count(*) orders, round(100 * avg(late), 6) late_pct, round(avg(g), 5) gap_mean, round(median(g), 5) gap_median, round(avg(greatest(g, 0)), 5) tardiness_mean
from (select *, (epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400000000.0::double g from o_task) group by 1""")
def _(t):
    s = fr.service_performance(task(t))
    g = "delivery_gap_days_continuous"
    a = s.groupBy("purchase_month").agg(F.count(F.lit(1)).alias("orders"), rnd(100 * F.avg("late")).alias("late_pct"), rnd(F.avg(g), 5).alias("gap_mean"), rnd(F.avg("positive_tardiness_days"), 5).alias("tardiness_mean"))
    return a.join(ranks.exact_quantiles(s, ["purchase_month"], g, {"gap_median": .5}).withColumn("gap_median", rnd("gap_median", 5)), "purchase_month")


@query("i20_cost_anomaly_deciles", f"""select bin, count(*) n, round(avg(late), 5) late_mean, round(avg(gap), 5) delivery_gap_days_continuous_mean, round(median(freight_log_ratio_month_z), 5) freight_log_ratio_month_z_median,
 round(median(late), 5) late_median, round(median(gap), 5) delivery_gap_days_continuous_median from {_bin_sql('freight_log_ratio_month_z', 10, 'o_z')} group by 1""")
def _(t):
    return fr.binned_medians(friction_z(t), "freight_log_ratio_month_z", 10, ["late", "delivery_gap_days_continuous"])


@query("i21_cost_service_quadrants", """select q cost_service_quadrant, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 6) pct, round(median(freight_burden), 6) burden_median from (
 select *, case when z <= a and late = 0 then 'BENCHMARK_LOW_COST_GOOD_SERVICE' when z <= a and late = 1 then 'LOW_COST_POOR_SERVICE' when z >= b and late = 0 then 'PREMIUM_COST_GOOD_SERVICE' when z >= b and late = 1 then 'OPERATIONAL_LEAKAGE_CANDIDATE' else 'MIDDLE' end q
 from (select *, freight_log_ratio_month_z z from o_z), (select quantile_cont(freight_log_ratio_month_z, .25) a, quantile_cont(freight_log_ratio_month_z, .75) b from o_z) where z is not null) group by 1""")
def _(t):
    z = friction_z(t).filter("freight_log_ratio_month_z is not null")
    d = fr.with_thresholds(z, {"_lo": ("freight_log_ratio_month_z", .25), "_hi": ("freight_log_ratio_month_z", .75)})
    d = d.withColumn("cost_service_quadrant", fr.quadrant(F.col("freight_log_ratio_month_z"), F.col("late"), F.col("_lo"), F.col("_hi")))
    k = "cost_service_quadrant"
    g = d.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    g = ranks.attach(g, g.agg(F.sum("n").alias("_all")), []).select(k, "n", rnd(100.0 * F.col("n") / F.col("_all")).alias("pct"))
    return g.join(ranks.exact_quantiles(d, [k], "freight_burden", {"burden_median": .5}).withColumn("burden_median", rnd("burden_median")), k)


@query("i22_critical_friction", " union all ".join(f"""select {q}::double q, count(*) filter (ok) eligible, count(*) filter (ok and z >= c and freight_burden >= b and late = 1) critical, round(100.0::double * count(*) filter (ok and z >= c and freight_burden >= b and late = 1) / count(*) filter (ok), 6) critical_pct
 from (select *, freight_log_ratio_month_z z, freight_log_ratio_month_z is not null and freight_burden is not null ok from o_z), (select quantile_cont(freight_log_ratio_month_z, {q}) c, quantile_cont(freight_burden, {q}) b from o_z)""" for q in (.75, .8, .9)))
def _(t):
    z = friction_z(t)
    return union([fr.critical_friction(z, q) for q in (.75, .8, .9)])


@query("i23_m1_feature_set", """select order_id, round(expected_freight_oot, 8) expected_freight_oot, round(freight_burden, 6) freight_burden, round(freight_expected_ratio, 6) q, round(freight_log_ratio_month_z, 5) z, cast(expected_freight_oot is not null as int) available from o_z""")
def _(t):
    return friction_z(t).select("order_id", rnd("expected_freight_oot", 8).alias("expected_freight_oot"), rnd("freight_burden").alias("freight_burden"), rnd("freight_expected_ratio").alias("q"),
                                rnd("freight_log_ratio_month_z", 5).alias("z"), F.col("expected_freight_oot").isNotNull().cast("int").alias("available"))


@query("i24_residual_drift", "select year_month, count(*) n, round(avg(freight_residual_abs), 9) residual_mean, round(median(freight_residual_abs), 5) residual_median, round(stddev_samp(freight_residual_abs), 5) residual_std from o_fric where freight_residual_abs is not null group by 1")
def _(t):
    d = friction(t).filter("freight_residual_abs is not null")
    e = "freight_residual_abs"
    # residuals have eight decimals: their sum is exact and does not depend on the order of rows
    mean = F.sum(F.col(e).cast("decimal(28,8)")).cast("double") / F.count(e)
    a = d.groupBy("year_month").agg(F.count(F.lit(1)).alias("n"), rnd(mean, 9).alias("residual_mean"), rnd(F.stddev_samp(e), 5).alias("residual_std"))
    return a.join(ranks.exact_quantiles(d, ["year_month"], e, {"residual_median": .5}).withColumn("residual_median", rnd("residual_median", 5)), "year_month")


@query("i24_expected_calibration", f"select bin, count(*) n, round(median(total_freight), 5) median_observed, round(median(expected_freight_oot), 5) median_predicted, round(sum(total_freight) / sum(expected_freight_oot), 5) calibration_ratio from {_bin_sql('expected_freight_oot', 10, 'o_fric')} group by 1")
def _(t):
    d = ranks.qcut(friction(t).filter("expected_freight_oot is not null"), "expected_freight_oot", 10)
    m = ranks.exact_quantiles(ranks.melt(d, ["bin"], ["total_freight", "expected_freight_oot"]), ["bin", "variable"], "value", {"m": .5})
    w = m.groupBy("bin").pivot("variable", ["total_freight", "expected_freight_oot"]).agg(F.first("m"))
    a = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), rnd(ratio(F.sum("total_freight"), F.sum("expected_freight_oot")), 5).alias("calibration_ratio"))
    return a.join(w.select("bin", rnd("total_freight", 5).alias("median_observed"), rnd("expected_freight_oot", 5).alias("median_predicted")), "bin")


@query("i25_model_evidence")
def _(t):
    r = logged(t)
    return fr.model_evidence({"F0": fr.expected_median(r), "F1": fr.expected_linear(r), "F2": boosted(t)})
