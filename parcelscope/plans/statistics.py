"""Statistical analysis queries (J)."""

from pyspark.sql import functions as F

from parcelscope.functions.columns import days_between, n_if, rnd
from parcelscope.operators import freight as fr
from parcelscope.operators import drift_lattice, geo, gold, models, ranks
from parcelscope.operators import statistics as st
from parcelscope.operators.checks import union
from parcelscope.plans.freight_and_friction import _bin_sql, friction_rows, route_summary, with_logs, with_z
from parcelscope.plans.registry import query, shared
from parcelscope.plans.routes_and_context import routes

_LN = "case when {k} >= 0 then ln(1 + {k}) end"
shared("o_frame", f"""select z.*, round(distance_freight_weighted_km, 6) km, total_weight_g w, {_LN.format(k='z.total_price')} log_price, {_LN.format(k='distance_freight_weighted_km')} log_distance, {_LN.format(k='total_weight_g')} log_weight,
 any_interstate_route interstate from o_z z join o_oroutes using (order_id)""")


def frame(t):
    """Orders with friction, label, durations and route logs: the analysis frame."""
    def build():
        s = geo.primary_seller(routes(t)).select("order_id", "seller_id", "seller_state", F.col("customer_state").alias("state"), F.col("customer_city_norm").alias("city"))
        return friction_rows(t).join(route_summary(t), "order_id").join(s, "order_id", "left")
    # only what can't be derived from a row is staged
    d = t.stage("frame_rows", build, "order_id")
    d = with_logs(fr.friction_core(d)).withColumns({"km": rnd("distance_freight_weighted_km"), "actual_delivery_days": days_between(gold.DELIVERED, gold.PURCHASE),
                                                    "promised_delivery_days": days_between(gold.PROMISED, gold.PURCHASE)})
    return with_z(t, d)


_PC = ["freight_burden", "log_price", "log_distance", "log_weight", "freight_log_ratio"]
_PAIRS = [(a, b) for i, a in enumerate(_PC) for b in _PC[i + 1:]]


@query("j1_pearson_pairs", " union all ".join(f"select '{a}' a, '{b}' b, count(*) filter ({a} is not null and {b} is not null) n, round(corr({a}, {b}), 6) r from o_frame" for a, b in _PAIRS))
def _(t):
    return st.pearson_pairs(frame(t), _PC)


def _sp(a, b):
    return f"""select '{a}' a, '{b}' b, count(*) n, round(corr(x, y), 6) rho from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0::double x, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0::double y
 from o_frame where {a} is not null and {b} is not null)"""


_SP = [("km", "freight_burden"), ("w", "total_freight"), ("total_price", "freight_burden")]


@query("j1_spearman_pairs", " union all ".join(_sp(a, b) for a, b in _SP))
def _(t):
    d = frame(t).withColumn("w", F.col("total_weight_g"))
    return union([st.spearman(d, a, b) for a, b in _SP])


_UV = ["freight_burden", "total_freight", "km"]


@query("j2_univariate_audit", " union all ".join(f"""select '{k}' variable, count({k}) n, round(avg({k}), 5) mean, round(stddev_samp({k}), 5) std, round(quantile_cont({k}, .05), 5) p05, round(quantile_cont({k}, .25), 5) p25, round(median({k}), 5) median,
 round(quantile_cont({k}, .75), 5) p75, round(quantile_cont({k}, .95), 5) p95, round(quantile_cont({k}, .75) - quantile_cont({k}, .25), 5) iqr, round(stddev_samp({k}) / avg({k}), 5) cv from o_frame""" for k in _UV))
def _(t):
    return st.univariate(frame(t), _UV)


@query("j3_quantile_bins", f"select bin, count(*) n, min(w) lo, max(w) hi from {_bin_sql('w', 10, 'o_frame')} group by 1")
def _(t):
    d = ranks.qcut(frame(t).filter("total_weight_g is not null"), "total_weight_g", 10)
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("total_weight_g").alias("lo"), F.max("total_weight_g").alias("hi"))


@query("j4_decile_curve", f"select bin, count(*) n, round(avg(freight_burden), 5) freight_burden_mean, round(median(km), 5) km_median, round(median(freight_burden), 5) freight_burden_median from {_bin_sql('km', 10, 'o_frame')} group by 1")
def _(t):
    return fr.binned_medians(frame(t), "km", 10, ["freight_burden"])


@query("j5_bootstrap_decile_medians")
def _(t):
    d = ranks.qcut(frame(t).filter("km is not null"), "km", 10)
    return st.bootstrap_median_interval(d, ["bin"], "freight_burden").select("bin", *[rnd(k).alias(k) for k in ("median", "ci_low", "ci_high")])


_SPECS = {"S0": ["log_distance"], "S1": ["log_distance", "log_weight"], "S2": ["log_distance", "log_weight", "log_price"], "S3": ["log_distance", "log_weight", "log_price", "interstate"],
          "S3B": ["log_distance", "log_volume", "log_price", "interstate", "multi_seller"]}


def _y(t):
    return frame(t).withColumn("log_total_freight", F.log1p("total_freight"))


@query("j6_ols_simple", "select round(regr_intercept(y, log_price), 5) intercept, round(regr_slope(y, log_price), 5) slope, round(regr_r2(y, log_price), 5) r2, count(*) n from (select ln(1 + total_freight) y, log_price from o_frame)")
def _(t):
    f = models.ols(_y(t), "log_total_freight", ["log_price"])
    return t.spark.createDataFrame([(round(float(f.coef[0]), 5), round(float(f.coef[1]), 5), round(float(f.stats["r2"]), 5), f.n)], "intercept double, slope double, r2 double, n long")


@query("j6_ols_nested_specs")
def _(t):
    rows = []
    for k, xs in _SPECS.items():
        f = models.ols(_y(t), "log_total_freight", xs)
        rows += [(k, n, float(c), f.n, float(f.stats["r2"]), float(f.stats["adj_r2"])) for n, c in zip(f.names, f.coef, strict=True)]
    return t.spark.createDataFrame(rows, "spec string, term string, coef double, n long, r2 double, adj_r2 double")


@query("j7_ols_hc1")
def _(t):
    return models.ols(frame(t), "delivery_gap_days_continuous", ["freight_log_ratio_month_z", "log_distance", "log_price"]).frame(t.spark, "HC1")


@query("j8_ols_cluster_one_way")
def _(t):
    return models.ols(_y(t), "log_total_freight", _SPECS["S2"], ["city"]).frame(t.spark, "CLUSTER_CITY")


@query("j9_ols_cluster_two_way")
def _(t):
    d = _y(t).filter("single_seller_order = 1")
    return models.ols(d, "log_total_freight", _SPECS["S2"], ["seller_id", "city"]).frame(t.spark, "CLUSTER_SELLER_CITY")


_LOGITS = {"R0": ["log_distance"], "R1": ["log_distance", "freight_log_ratio"], "R_A": ["log_distance", "log_weight", "freight_log_ratio"],
           "R_B": ["log_distance", "log_weight", "freight_log_ratio", "promised_delivery_days"]}


def _logits(t):
    return {k: models.logit(frame(t), "late", xs) for k, xs in _LOGITS.items()}


@query("j10_logit_nested")
def _(t):
    c = st.coefficients(t.spark, _logits(t))
    return c.withColumn("odds_ratio", F.exp("coef"))


@query("j11_fractional_logit_months")
def _(t):
    d = frame(t)
    years = [r[0] for r in d.select(F.substring("year_month", 1, 4)).distinct().orderBy(F.substring("year_month", 1, 4)).collect()][1:]
    dummies = {f"y{y}": (F.substring("year_month", 1, 4) == y).cast("double") for y in years}
    months = {f"m{m:02d}": (F.substring("year_month", 6, 2) == f"{m:02d}").cast("double") for m in range(2, 13)}
    xs = ["log_price", "log_distance", "log_weight", "interstate"]
    e = d.withColumns({**dummies, **months})
    return st.coefficients(t.spark, {"M0": models.logit(e, "freight_burden", xs[:2]), "M1": models.logit(e, "freight_burden", xs),
                                     "M2": models.logit(e, "freight_burden", [*xs, *dummies, *months])})


@query("j12_fdr")
def _(t):
    return models.benjamini_hochberg(st.coefficients(t.spark, {k: v for k, v in _logits(t).items() if k in ("R1", "R_B")}))


@query("j13_mean_difference", " union all ".join(f"""select '{k}' variable, count({k}) filter (late = 1) n1, count({k}) filter (late = 0) n0, round(avg({k}) filter (late = 1), 6) mean1, round(avg({k}) filter (late = 0), 6) mean0,
 round((avg({k}) filter (late = 1) - avg({k}) filter (late = 0)) / sqrt((var_samp({k}) filter (late = 1) + var_samp({k}) filter (late = 0)) / 2), 6) smd from (select late, log_distance, log_price, interstate::double interstate from o_frame)""" for k in ("log_distance", "log_price", "interstate")))
def _(t):
    return st.mean_difference(frame(t), "late", ["log_distance", "log_price", "interstate"])


_GRP = """(select *, case when freight_expected_ratio <= a then 'LOW_FREIGHT' when freight_expected_ratio >= b then 'HIGH_FREIGHT' else 'NORMAL_FREIGHT' end g from o_fric,
 (select quantile_cont(freight_expected_ratio, .1) a, quantile_cont(freight_expected_ratio, .9) b from o_fric) where freight_expected_ratio is not null)"""


def _groups(t):
    q = "freight_expected_ratio"
    d = fr.with_thresholds(frame(t).filter(F.col(q).isNotNull()), {"_a": (q, .1), "_b": (q, .9)})
    return d.withColumn("group", F.when(F.col(q) <= F.col("_a"), "LOW_FREIGHT").when(F.col(q) >= F.col("_b"), "HIGH_FREIGHT").otherwise("NORMAL_FREIGHT"))


@query("j14_beta_posterior")
def _(t):
    g = _groups(t).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("k"))
    return st.beta_posteriors(g, "NORMAL_FREIGHT")


@query("j15_residual_groups", f"""select g as "group", count(*) n, cast(sum(late) as bigint) k, round((1.0 + sum(late))::double / (2 + count(*)), 6) posterior_mean from {_GRP} group by 1""")
def _(t):
    n, k = F.count(F.lit(1)), F.sum("late")
    return _groups(t).groupBy("group").agg(n.alias("n"), k.alias("k"), rnd((1 + k) / (2 + n)).alias("posterior_mean"))


def _curved(t):
    v = F.col("freight_log_ratio")
    q = ranks.exact_quantiles(frame(t), [], "freight_log_ratio", {f"k{i}": p for i, p in enumerate((.05, .35, .65, .95))}).first()
    knots = [float(x) for x in q]
    d = frame(t).filter(v.isNotNull()).withColumns({"q2": v * v, **st.spline_basis(v, knots)})
    return d, knots


@query("j16_nonlinear_logit")
def _(t):
    d, _k = _curved(t)
    fits = {"LINEAR": models.logit(d, "late", ["freight_log_ratio", "log_distance"]), "QUADRATIC": models.logit(d, "late", ["freight_log_ratio", "q2", "log_distance"]),
            "SPLINE": models.logit(d, "late", ["freight_log_ratio", "s0", "s1", "log_distance"])}
    q = fits["QUADRATIC"]
    turning = -float(q.coef[1]) / (2 * float(q.coef[2])) if q.coef[2] else None
    return st.compare_fits(t.spark, fits).withColumn("turning_point", F.when(F.col("model") == "QUADRATIC", F.lit(turning)))


@query("j17_random_intercept")
def _(t):
    xs = ["log_distance", "log_weight", "freight_log_ratio"]
    d = models.standardised(frame(t).filter("state is not null"), xs, ddof=1)
    return st.random_intercept(d, "actual_delivery_days", [f"{k}_z" for k in xs], "state")


@query("j18_tercile_heterogeneity")
def _(t):
    d = ranks.qcut(frame(t).filter("km is not null"), "km", 3, out="tercile")
    return st.coefficients(t.spark, {f"T{i}": models.logit(d.filter(F.col("tercile") == i), "late", ["freight_log_ratio", "log_price"]) for i in range(3)})


@query("j19_standardised", """select order_id, round((total_price - avg(total_price) over ()) / stddev_pop(total_price) over (), 5) price_z0, round((total_price - avg(total_price) over ()) / stddev_samp(total_price) over (), 5) price_z1 from o_frame""")
def _(t):
    a = models.standardised(frame(t).select("order_id", "total_price"), ["total_price"], 0).withColumnRenamed("total_price_z", "z0")
    b = models.standardised(a, ["total_price"], 1)
    return b.select("order_id", rnd("z0", 5).alias("price_z0"), rnd("total_price_z", 5).alias("price_z1"))


@query("j20_rank_audit")
def _(t):
    return st.rank_audit(gold.order_core(t.items).select(*[F.col(k).cast("double").alias(k) for k in gold.CORE_FEATURES]), gold.CORE_FEATURES)


_DV = ["freight_burden", "total_freight"]


def _drift_sql(k):
    s = f"(select {k} v, cast(year_month >= '2000-01' as int) cur from o_frame where {k} is not null)"
    cum = (f"(select v, sum(c) over (order by v) / sum(c) over () fc, sum(r) over (order by v) / sum(r) over () fr, lead(v) over (order by v) nv "
           f"from (select v, count(*) filter (cur = 1) c, count(*) filter (cur = 0) r from {s} group by 1))")
    ed = f"(select list_sort(list_distinct([{', '.join(f'quantile_cont(v, {i / 10})' for i in range(11))}])) ed, quantile_cont(v, .75) - quantile_cont(v, .25) iqr from {s} where cur = 0)"
    cells = (f"(select bin, greatest(c / sum(c) over (), 1e-6) p, greatest(r / sum(r) over (), 1e-6) q from (select bin, sum(cur)::double c, sum(1 - cur)::double r from "
             f"(select cur, least(greatest(len(list_filter(ed, lambda e: e < v)) - 1, 0), len(ed) - 2) bin from {s}, {ed}) group by 1))")
    return f"""select '{k}' variable, (select round(max(abs(fc - fr)), 6) from {cum}) ks, (select round(sum((p - q) * ln(p / q)), 6) from {cells}) psi, (select round(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 6) from {cells}) js,
 (select round(sum(abs(fc - fr) * (nv - v)), 5) from {cum}) wasserstein, (select round(sum(abs(fc - fr) * (nv - v)) / (select iqr from {ed}), 5) from {cum}) wasserstein_iqr"""


@query("j21_distribution_drift", " union all ".join(_drift_sql(k) for k in _DV))
def _(t):
    d = frame(t).withColumn("cur", (F.col("year_month") >= "2000-01").cast("int"))
    out = st.drift(ranks.melt(d, ["cur"], _DV), ["variable"], "value", "cur")
    return out.withColumns({k: rnd(k, 5) for k in ("wasserstein", "wasserstein_iqr")})


# fixed values: support limits of the published monthly diagnostic
_SUPPORT = (1000, 200)
_MONTHLY = f"""with v as ({" union all ".join(f"select '{k}' variable, year_month m, round({k}::double, 6) v from o_frame where {k} is not null and year_month is not null" for k in _DV)}),
 f as (select variable, m, count(*) n_current from v group by 1, 2),
 x as (select variable, m, v, 1 cur from v union all select v.variable, f.m, v, 0 from v join f on v.variable = f.variable and v.m < f.m),
 h as (select variable, m, count(*) n_earlier, list_sort(list_distinct([{', '.join(f'round(quantile_cont(v, {i / 10}), 8)' for i in range(11))}])) ed, quantile_cont(v, .75) - quantile_cont(v, .25) iqr, quantile_cont(v, .5) med from x where cur = 0 group by 1, 2),
 o as (select variable, m, quantile_cont(v, .5) own from x where cur = 1 group by 1, 2),
 g as (select variable, m, v, count(*) filter (cur = 1) c, count(*) filter (cur = 0) r from x group by 1, 2, 3),
 u as (select variable, m, v, sum(c) over w / sum(c) over t fc, sum(r) over w / sum(r) over t fr, lead(v) over (partition by variable, m order by v) nv from g
  window w as (partition by variable, m order by v), t as (partition by variable, m)),
 d as (select variable, m, max(abs(fc - fr)) ks, sum(abs(fc - fr) * (nv - v)) wd from u group by 1, 2),
 b as (select x.variable, x.m, least(greatest(len(list_filter(ed, lambda e: e < v)) - 1, 0), greatest(len(ed) - 2, 0)) bin, sum(cur)::double c, sum(1 - cur)::double r from x join h on x.variable = h.variable and x.m = h.m group by 1, 2, 3),
 p as (select variable, m, greatest(c / sum(c) over t, 1e-6) p, greatest(r / sum(r) over t, 1e-6) q from b window t as (partition by variable, m)),
 s as (select variable, m, sum((p - q) * ln(p / q)) psi, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2 js from p group by 1, 2),
 y as (select year_month m, sum(late)::double y, count(late)::double n from o_frame where year_month is not null group by 1),
 l as (select m, 100 * (y / n - sum(y) over w / sum(n) over w) target from y window w as (order by m rows between unbounded preceding and 1 preceding))
select d.variable, d.m year_month, n_current, n_earlier, round(ks, 6) ks, round(psi, 6) psi, round(sqrt(greatest(js, 0)), 5) js_distance, round(wd, 5) wasserstein, round(wd / nullif(iqr, 0), 5) wasserstein_iqr,
 round((own - med) / nullif(iqr, 0), 6) median_shift, round(target, 6) target_delta_pp, n_earlier >= {_SUPPORT[0]} and n_current >= {_SUPPORT[1]} supported
from d join h using (variable, m) join o using (variable, m) join s using (variable, m) join f using (variable, m) join l on l.m = d.m"""


@query("j21_monthly_drift", _MONTHLY)
def _(t):
    # six decimals: sums that differ in their last bit are one value
    d = frame(t).withColumns({k: rnd(F.col(k).cast("double"), 6) for k in _DV})
    return drift_lattice.period_drift(d, "year_month", _DV, "late", least_earlier=_SUPPORT[0], least_own=_SUPPORT[1])


@query("j22_marginal_grid")
def _(t):
    d, knots = _curved(t)
    fit = models.logit(d, "late", ["freight_log_ratio", "s0", "s1", "log_distance"])
    return st.marginal_grid(d, fit, "freight_log_ratio", lambda g: {"freight_log_ratio": g, **st.spline_basis(g, knots)})


@query("j_late_share_by_group", f"""select g as "group", round(100 * avg(late), 6) late_pct, count(*) filter (late = 1) late_orders from {_GRP} group by 1""")
def _(t):
    return _groups(t).groupBy("group").agg(rnd(100 * F.avg("late")).alias("late_pct"), n_if(F.col("late") == 1).alias("late_orders"))
