"""Expected freight out of time, shipping-friction measures and service performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.columns import EPS, c, guarded_log1p, is_finite, n_if, ratio, rnd
from parcelscope.operators import fold_boosting, models, ranks

FEATURES = ["log_distance", "log_weight", "log_volume", "log_price", "seller_item_count"]
MIN_TRAIN_MONTHS = 3
# fixed value: normal-consistency factor of the MAD
MAD_SCALE = 1.4826


def log_features(r: DataFrame) -> DataFrame:
    """Guarded logs of freight, distance, weight, volume and price on route rows."""
    return r.withColumns({"log_freight": guarded_log1p("seller_freight"), "log_distance": guarded_log1p("distance_km"),
                          "log_weight": guarded_log1p("seller_weight_g"), "log_volume": guarded_log1p("seller_volume_cm3"),
                          "log_price": guarded_log1p("seller_price")})


def months_of(df: DataFrame, period: str = "year_month") -> list[str]:
    """The sorted list of periods (a few hundred at most)."""
    return [r[0] for r in df.select(period).filter(F.col(period).isNotNull()).distinct().orderBy(period).collect()]


def fold_plan(r: DataFrame, min_months: int = MIN_TRAIN_MONTHS) -> DataFrame:
    """Expanding monthly folds: test month, first and last training month, row counts."""
    from pyspark.sql import Window
    g = r.groupBy(F.col("year_month").alias("test_month")).agg(F.count(F.lit(1)).alias("n_test"), F.count("log_freight").alias("_k"))
    w = Window.orderBy("test_month")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = g.select("test_month", "n_test", F.sum("_k").over(before).alias("n_train"), F.first("test_month").over(w).alias("train_start"),
                 F.lag("test_month").over(w).alias("train_end"), F.row_number().over(w).alias("_i"))
    return d.filter(F.col("_i") > min_months).drop("_i")


def expected_median(r: DataFrame, min_months: int = MIN_TRAIN_MONTHS) -> DataFrame:
    """exact median of earlier months' log freight as the prediction of a month."""
    months = months_of(r)
    med = ranks.expanding_median(r, "year_month", "log_freight", months).filter(F.col("fold").isin(months[min_months:]))
    # one row a fold: routes keep their layout by order
    return r.join(F.broadcast(med.select(F.col("fold").alias("year_month"), F.col("median").alias("pred_log"))), "year_month", "left")


def expected_linear(r: DataFrame, features: list[str] | None = None) -> DataFrame:
    """F1: least squares on complete earlier rows (at least 100), scored on the month's complete rows."""
    features = features or FEATURES
    months = months_of(r)
    coefs = models.expanding_ols(r, "year_month", months, features, "log_freight", MIN_TRAIN_MONTHS)
    return models.apply_fold_coefficients(r, "year_month", features, coefs, "pred_log")


def expected_boosted(r: DataFrame, rounds: int = 100, depth: int = 5, bins: int = 64) -> DataFrame:
    """boosted trees on the rows of all earlier months, a fit for every month; missing features take a side of their own.

    Rows of a month after the first three get a prediction, with or without a label; at least one earlier label is needed.
    """
    fits = fold_boosting.fit_folds(r, "year_month", months_of(r)[MIN_TRAIN_MONTHS:], {"F2": FEATURES}, "log_freight",
                                   fold_boosting.Settings(rounds=rounds, depth=depth, bins=bins))
    return r.withColumn("pred_log", fits.predict("year_month", "F2"))


def model_evidence(scored: dict[str, DataFrame], features: list[str] | None = None) -> DataFrame:
    """Row errors of F0, F1 and F2 on the rows that all of them predict, the gain of F2, its largest rank correlation with
    a feature, the range of its monthly median residual, and whether the residual is fit for use (R2 over 0.25, correlation under 0.45).

    ``scored`` maps F0, F1 and F2 to route rows with ``order_id``, ``seller_id`` and ``pred_log``.
    """
    from parcelscope.operators.statistics import spearman
    keys = ["order_id", "seller_id"]
    d = back_transform(scored["F2"]).withColumnRenamed("pred_freight", "F2")
    for name in ("F0", "F1"):
        d = d.join(back_transform(scored[name]).select(*keys, F.col("pred_freight").alias(name)), keys)
    d = d.na.drop(subset=["seller_freight", "F0", "F1", "F2"]).withColumn("residual", F.col("seller_freight") - F.col("F2"))
    n = F.count(F.lit(1))
    err = {k: F.avg(F.abs(F.col("seller_freight") - F.col(k))) for k in ("F0", "F1", "F2")}
    a = d.agg(n.alias("n"), *[rnd(e).alias(f"mae_{k.lower()}") for k, e in err.items()], *[rnd(100 * (1 - err["F2"] / F.nullif(err[k], F.lit(0.0)))).alias(f"gain_over_{k.lower()}_pct") for k in ("F0", "F1")],
              rnd(1 - F.sum(F.col("residual") ** 2) / F.nullif(F.var_pop("seller_freight") * n, F.lit(0.0))).alias("r2_f2"))
    from parcelscope.operators.checks import union
    rho = union([spearman(d, "residual", k) for k in features or FEATURES]).agg(F.max(F.abs("rho")).alias("max_residual_rho"))
    med = ranks.exact_quantiles(d, ["year_month"], "residual", {"m": .5}).agg(rnd(F.max("m") - F.min("m")).alias("median_drift_range"))
    out = ranks.attach(ranks.attach(a, rho, []), med, [])
    ok = F.coalesce((F.col("r2_f2") > 0.25) & (F.col("max_residual_rho") < 0.45), F.lit(False))
    return out.withColumn("residual_status", F.when(ok, "VALID_FOR_DOWNSTREAM").otherwise("NOT_VALID_FOR_DOWNSTREAM"))


def back_transform(scored: DataFrame) -> DataFrame:
    return scored.withColumn("pred_freight", F.when(F.expm1("pred_log") < 0, 0.0).otherwise(F.expm1("pred_log")))


def order_expected(scored: DataFrame) -> DataFrame:
    """Order sums of predicted and observed freight; all-NULL predictions stay NULL.

    Sums are of decimals, so that they don't depend on the order of rows: their ties decide bins.
    """
    g = back_transform(scored).groupBy("order_id", "year_month").agg(
        *[F.sum(F.round(k, 8).cast("decimal(28,8)")).cast("double").alias(n) for k, n in
          (("pred_freight", "expected_freight_oot"), ("seller_freight", "total_freight"), ("seller_price", "total_price"))])
    return g.withColumns({"freight_residual": F.col("total_freight") - F.col("expected_freight_oot"),
                          "freight_ratio_to_expected": F.when(F.col("expected_freight_oot") > 0, F.col("total_freight") / F.col("expected_freight_oot"))})


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """MAE, exact median AE, RMSE, R2 and coverage; rows without a prediction only count for coverage."""
    d = df.withColumn("_e", F.col(y) - F.col(p))
    ok = F.col("_e").isNotNull()
    yy = F.when(ok, F.col(y))
    n = F.count("_e")
    a = d.agg(F.count(F.lit(1)).alias("n_rows"), n.alias("n"), rnd(F.avg(F.abs("_e"))).alias("mae"), rnd(F.sqrt(F.avg(F.col("_e") ** 2))).alias("rmse"),
              rnd(1 - F.sum(F.col("_e") ** 2) / F.nullif(F.var_pop(yy) * n, F.lit(0.0))).alias("r2"), rnd(n / F.count(F.lit(1))).alias("coverage"))
    m = ranks.exact_quantiles(d.select(F.abs("_e").alias("_a")), [], "_a", {"median_ae": 0.5})
    return ranks.attach(a, m.select(rnd("median_ae").alias("median_ae")), [])


def parity_audit(left: DataFrame, right: DataFrame, key: str, value: str, atol: float = 1e-10, rtol: float = 1e-12) -> DataFrame:
    """Row-level comparison of two producers: membership, NULL pattern, tolerance, largest difference."""
    from parcelscope.operators.joins import membership_join
    j = membership_join(left.select(key, F.col(value).alias("_a")), right.select(key, F.col(value).alias("_b")), [key])
    both = F.col("membership") == "both"
    gap = F.abs(F.col("_a") - F.col("_b"))
    return j.agg(n_if(both).alias("both"), n_if(F.col("membership") == "left_only").alias("left_only"), n_if(F.col("membership") == "right_only").alias("right_only"),
                 n_if(both & (F.col("_a").isNull() != F.col("_b").isNull())).alias("null_mismatch"),
                 n_if(both & (gap > atol + rtol * F.abs(F.col("_b")))).alias("value_mismatch"), F.coalesce(F.round(F.max(gap), 6), F.lit(0.0)).alias("max_abs_diff"))


def parity_by_period(left: DataFrame, right: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Per period of ``left``: rows, rows that both producers fill, exact median of the differences and the largest one."""
    j = left.select(key, period, F.col(value).alias("_a")).join(right.select(key, F.col(value).alias("_b")), key, "left").withColumn("_gap", F.col("_a") - F.col("_b"))
    a = j.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.count("_gap").alias("n_compared"), rnd(F.max(F.abs("_gap"))).alias("max_abs_diff"))
    m = ranks.exact_quantiles(j.filter("_gap is not null"), [period], "_gap", {"m": .5}).select(period, (rnd("m") + F.lit(0.0)).alias("median_difference"))
    return a.join(m, period, "left")


def availability(gold_orders: DataFrame, expected: DataFrame, warmup: list[str]) -> DataFrame:
    """Why expected freight is (not) available, and which model serves the order."""
    j = gold_orders.select("order_id").join(expected.select("order_id", "year_month", "expected_freight_oot", F.lit(True).alias("_in")), "order_id", "left")
    known = F.col("expected_freight_oot").isNotNull()
    reason = (F.when(known, "AVAILABLE").when(F.col("_in").isNull(), "NO_ROUTE_ORDER_MEMBERSHIP").when(F.col("year_month").isNull(), "MISSING_TIME_KEY")
              .when(F.col("year_month").isin(warmup), "WARMUP_MIN_TRAIN_MONTHS").otherwise("UNEXPECTED_POST_WARMUP_MISSING"))
    return j.select("order_id", reason.alias("availability_reason"), F.when(known, "M1_ELIGIBLE").otherwise("M0_FALLBACK").alias("serving_model"))


# ---------------------------------------------------------------- friction
def friction_core(df: DataFrame) -> DataFrame:
    """Burden, freight/price, residuals, ratio to expected and its log, with validity flags."""
    price, freight, exp = F.col("total_price"), F.col("total_freight"), F.col("expected_freight_oot")

    def fine(v, cond):
        return F.coalesce(v.isNotNull() & is_finite(v) & cond, F.lit(False))
    vp, vf, ve = fine(price, price > 0), fine(freight, freight >= 0), fine(exp, exp > 0)
    pair = vf & ve
    return df.withColumns({
        "valid_price": vp.cast("int"), "valid_freight": vf.cast("int"), "valid_expected_freight": ve.cast("int"),
        "freight_burden": F.when(vp & vf & (price + freight > 0), freight / (price + freight)),
        "freight_to_price_ratio": F.when(vp & vf, freight / price),
        "log_freight_to_price_ratio": F.when(vp & vf, F.log((freight + EPS) / (price + EPS))),
        "freight_residual_abs": F.when(pair, freight - exp), "freight_expected_ratio": F.when(pair, freight / exp),
        "freight_residual_relative": F.when(pair, (freight - exp) / exp), "freight_log_ratio": F.when(pair, F.log((freight + EPS) / (exp + EPS)))})


def robust_month_z(df: DataFrame, value: str = "freight_log_ratio", month: str = "year_month", stats: DataFrame | None = None) -> DataFrame:
    """(value - month median) / (1.4826 MAD), only where the scaled MAD is usable; ``stats`` may hold the months' median and mad."""
    stats = (ranks.median_mad(df, [month], value) if stats is None else stats).withColumn("scaled_mad", MAD_SCALE * F.col("mad"))
    stats = stats.withColumn("robust_scale_usable", (F.col("scaled_mad") > EPS).cast("int"))
    d = df.join(F.broadcast(stats.withColumnRenamed("median", "median_log_ratio")), month, "left")
    return d.withColumn("freight_log_ratio_month_z", F.when(F.col("robust_scale_usable") == 1, (F.col(value) - F.col("median_log_ratio")) / F.col("scaled_mad")))


def identity_checks(z: DataFrame) -> DataFrame:
    """Burden = r / (1 + r); monthly medians of the robust z near 0."""
    r = F.col("freight_to_price_ratio")
    a = z.agg(n_if(F.abs(F.col("freight_burden") - r / (1 + r)) > 1e-10).alias("burden_identity_violations"),
              n_if((F.col("freight_burden") < 0) | (F.col("freight_burden") > 1)).alias("burden_out_of_range"))
    m = ranks.exact_quantiles(z, ["year_month"], "freight_log_ratio_month_z", {"m": 0.5})
    return ranks.attach(a, m.agg(n_if(F.abs("m") > 1e-9).alias("months_off_centre"), F.count(F.lit(1)).alias("months_checked")), [])


def quantile_table(df: DataFrame, fields: list[str], probs: dict[str, float], digits: int = 6) -> DataFrame:
    """Exact quantiles of several fields, one row per field."""
    q = ranks.exact_quantiles(ranks.melt(df, [], fields, "field", "value"), ["field"], "value", probs)
    return q.select("field", *[rnd(k, digits).alias(k) for k in probs])


def with_thresholds(df: DataFrame, spec: dict[str, tuple[str, float]]) -> DataFrame:
    """Attach exact global thresholds as columns: name -> (field, probability)."""
    out = df
    for name, (field, p) in spec.items():
        out = ranks.attach(out, ranks.exact_quantiles(df.select(field), [], field, {name: p}), [])
    return out


def service_performance(df: DataFrame) -> DataFrame:
    """Continuous and calendar gaps to the promise, positive tardiness and early days."""
    from parcelscope.functions.columns import day, days_between
    from parcelscope.operators.gold import DELIVERED, PROMISED
    gap = days_between(DELIVERED, PROMISED)
    return df.withColumns({"delivery_gap_days_continuous": gap, "delivery_gap_days_calendar": F.datediff(day(DELIVERED), day(PROMISED)),
                           "positive_tardiness_days": F.when(gap > 0, gap).when(gap.isNotNull(), 0.0), "early_days": F.when(gap < 0, -gap).when(gap.isNotNull(), 0.0)})


def quadrant(z: Column, late: Column, lo: Column, hi: Column) -> Column:
    """Five cost-service classes from the cost-anomaly quartiles and the label."""
    return (F.when((z <= lo) & (late == 0), "BENCHMARK_LOW_COST_GOOD_SERVICE").when((z <= lo) & (late == 1), "LOW_COST_POOR_SERVICE")
            .when((z >= hi) & (late == 0), "PREMIUM_COST_GOOD_SERVICE").when((z >= hi) & (late == 1), "OPERATIONAL_LEAKAGE_CANDIDATE").otherwise("MIDDLE"))


def critical_friction(df: DataFrame, q: float) -> DataFrame:
    """Late orders with cost anomaly and burden both at or above their q-quantile."""
    z, b, late = (F.col(k) for k in ("freight_log_ratio_month_z", "freight_burden", "late"))
    d = with_thresholds(df, {"_cq": ("freight_log_ratio_month_z", q), "_bq": ("freight_burden", q)})
    ok = z.isNotNull() & b.isNotNull() & late.isNotNull()
    crit = ok & (z >= F.col("_cq")) & (b >= F.col("_bq")) & (late == 1)
    return d.agg(F.lit(q).alias("q"), n_if(ok).alias("eligible"), n_if(crit).alias("critical"), rnd(100 * ratio(n_if(crit), n_if(ok))).alias("critical_pct"))


def binned_medians(df: DataFrame, by: str, bins: int, values: list[str], digits: int = 5) -> DataFrame:
    """Quantile bins of ``by``: rows, mean and exact median of each value per bin."""
    d = ranks.qcut(df.filter(c(by).isNotNull()), by, bins, out="bin")
    cols = [by, *values]
    a = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[rnd(F.avg(k), digits).alias(f"{k}_mean") for k in values])
    m = ranks.exact_quantiles(ranks.melt(d, ["bin"], cols), ["bin", "variable"], "value", {"m": .5})
    w = m.groupBy("bin").agg(*[F.max(F.when(F.col("variable") == k, rnd("m", digits))).alias(f"{k}_median") for k in cols])
    return a.join(w, "bin")


def segment_medians(df: DataFrame, by: list[str], bins: int, value: str, digits: int = 5) -> DataFrame:
    """Quantile bins of every column of ``by`` in one long form: rows, mean and exact medians per variable and bin."""
    long = ranks.melt(df, [value], by).filter(F.col("value").isNotNull()).withColumnsRenamed({"value": "_by", value: "_value"})
    d = ranks.qcut(long, "_by", bins, ["variable"])
    keys = ["variable", "bin"]
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("_value"), digits).alias(f"{value}_mean"))
    m = ranks.exact_quantiles(d.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("_what"), F.col(k).cast("double").alias("_x")) for k in ("_by", "_value")]))).filter("_x is not null"), [*keys, "_what"], "_x", {"m": .5})
    w = m.groupBy(*keys).agg(*[F.max(F.when(F.col("_what") == k, rnd("m", digits))).alias(name) for k, name in (("_by", "variable_median"), ("_value", f"{value}_median"))])
    return a.join(w, keys, "left")


def scenario_effect(df: DataFrame, fit: models.Fit, alter: dict[str, Column]) -> DataFrame:
    """Change of the predicted share when some design columns are replaced: mean, median, p10, p90."""
    from parcelscope.functions.columns import sigmoid
    base = df.withColumn("const", F.lit(1.0)).na.drop(subset=[k for k in fit.names if k != "const"])
    d = base.withColumn("_p", sigmoid(fit.predict())).withColumns(alter).withColumn("delta", sigmoid(fit.predict()) - F.col("_p"))
    q = ranks.exact_quantiles(d.select("delta"), [], "delta", {"median": .5, "p10": .1, "p90": .9})
    return ranks.attach(d.agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean")), q, [])


def log1p_scaled(log_col: str, change: float) -> Column:
    """log1p of a value that grows by ``change``, from the log1p column."""
    return F.log1p(F.expm1(log_col) * (1 + change))


