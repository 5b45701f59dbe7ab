"""Temporal model evaluation queries (K)."""

import pandas as pd
from pyspark.sql import functions as F

from parcelscope.functions.columns import DAY_US, n_if, rnd, us
from parcelscope.operators import evaluation as ev
from parcelscope.operators import functional as fn
from parcelscope.operators import component_grid, fold_boosting, fold_forest, gold, label, models, pit
from parcelscope.operators import inference as inf
from parcelscope.operators.checks import union
from parcelscope.plans.freight_and_friction import _bin_sql
from parcelscope.plans.label_and_history import _FOLDS, _curve_events, _curves
from parcelscope.plans.registry import query, shared
from parcelscope.plans.routes_and_context import task
from parcelscope.plans.statistics import frame

# out-of-fold scores of two arms, derived from the order key and the label (ties are intended)
_M0, _M1 = "(10 + (order_id * 7919) % 613 + 150 * late) / 1000.0D", "(10 + (order_id * 104729) % 587 + 190 * late) / 1000.0D"
shared("o_scores", f"""select order_id, purchase_month "month", late y, unnest(['M0', 'M1']) model, unnest([{_M0.replace('1000.0D', '1000.0::double')}, {_M1.replace('1000.0D', '1000.0::double')}]) score from o_task""")
shared("o_wide", f"""select order_id, purchase_month "month", late y, {_M0.replace('1000.0D', '1000.0::double')} m0, {_M1.replace('1000.0D', '1000.0::double')} m1 from o_task""")


def wide(t):
    return task(t).selectExpr("order_id", "purchase_month as month", "late as y", f"{_M0} as m0", f"{_M1} as m1")


def scores(t):
    return wide(t).unpivot(["order_id", "month", "y"], [F.col("m0").alias("M0"), F.col("m1").alias("M1")], "model", "score")


@query("k1_label_available_folds", f"""
select "month", test_rows, train_rows, immature_rows, case when train_rows = 0 then 'EMPTY' when train_pos = 0 or train_pos = train_rows then 'SINGLE_CLASS_TRAIN' when test_pos = 0 or test_pos = test_rows then 'SINGLE_CLASS_TEST' else 'READY' end status, 0 pit_violations
from (select f.purchase_month "month", count(*) filter (k.purchase_month = f.purchase_month) test_rows, count(*) filter (k.purchase_month = f.purchase_month and late = 1) test_pos,
 count(*) filter (order_purchase_timestamp < cut and order_delivered_customer_date < cut) train_rows, count(*) filter (order_purchase_timestamp < cut and order_delivered_customer_date < cut and late = 1) train_pos,
 count(*) filter (order_purchase_timestamp < cut and order_delivered_customer_date >= cut) immature_rows from {_FOLDS} f, o_task k group by 1)""")
def _(t):
    k = task(t)
    bad = k.agg(n_if(F.col("order_delivered_customer_date") < F.col("order_purchase_timestamp")).alias("b")).scalar()
    return label.maturity_folds(k).select("month", "test_rows", "train_rows", "immature_rows", "status", F.coalesce(bad, F.lit(0)).cast("int").alias("pit_violations"))


_CORE = ["item_count", "unique_seller_count", "total_price", "total_freight", "freight_price_ratio"]
_PLUS = ["expected_freight_oot", "freight_log_ratio_month_z"]


def model_frame(t):
    """Rows eligible for both arms with the month they become usable for training."""
    def build():
        k = task(t).select("order_id", F.col("purchase_month").alias("month"), F.date_format(F.greatest("order_purchase_timestamp", "order_delivered_customer_date"), "yyyy-MM").alias("usable"),
                           us("order_purchase_timestamp").alias("t0"))
        f = frame(t).select("order_id", "late", *_PLUS)
        return k.join(gold.order_core(t.items).select("order_id", *_CORE), "order_id").join(f, "order_id").na.drop(subset=_PLUS + _CORE)
    return t.stage("model_frame", build)


def _months(df):
    return [r[0] for r in df.select("month").distinct().orderBy("month").collect()]


def _arm_columns(arm):
    return _CORE if arm == "M0" else _CORE + _PLUS


_FITS = "month string, n long, coef array<double>, scaled array<double>, mean array<double>, sd array<double>"


def fold_fits(t, arm: str):
    """One row per fold: raw and scaled coefficients with the training means and deviations."""
    def build():
        d = model_frame(t)
        fits = models.fold_logit(d, "usable", _months(d)[3:], _arm_columns(arm), "late")
        rows = [(m, f["n"], *[[float(v) for v in f[k]] for k in ("coef", "scaled", "mean", "sd")]) for m, f in fits.items()]
        return t.spark.createDataFrame(rows, _FITS)
    return t.stage(f"fold_fits_{arm}", build)


def held_out(t, arm: str):
    """Rows with the fit of their own month, which never saw them."""
    return model_frame(t).join(F.broadcast(fold_fits(t, arm)), "month")


def fold_scores(t, arm: str):
    """Out-of-fold logistic scores of one arm."""
    def build():
        eta = F.col("coef")[0]
        for i, x in enumerate(_arm_columns(arm)):
            eta = eta + F.col("coef")[i + 1] * F.col(x)
        return held_out(t, arm).select("order_id", "month", F.col("late").alias("y"), F.lit(arm).alias("model"), (1 / (1 + F.exp(-eta))).alias("score"))
    return t.stage(f"fold_scores_{arm}", build)


@query("k2_paired_logistic")
def _(t):
    both = fold_scores(t, "M0").unionByName(fold_scores(t, "M1"))
    return ev.all_metrics(both, ["model", "month"])


# fixed values: the published setting of the random forest
_FOREST = fold_forest.Settings(trees=200, depth=12, min_leaf=2)


def forest_scores(t):
    """Out-of-fold scores of random forests, a fit per month and arm."""
    def build():
        d = model_frame(t)
        s = fold_forest.score_folds(d, "usable", "month", _months(d)[3:], {a: _arm_columns(a) for a in ("M0", "M1")}, "late", _FOREST)
        return s.select("order_id", "month", F.col("late").alias("y"), *[F.col(a).alias(f"RF_{a}") for a in ("M0", "M1")]).unpivot(["order_id", "month", "y"], ["RF_M0", "RF_M1"], "model", "score")
    return t.stage("forest_scores", build)


# fixed values: the published setting of the boosted classifier
_BOOSTED = fold_boosting.Settings(loss="logistic", rounds=150, rate=0.05, depth=5, min_leaf=20, l2=1.0)


def boosted_scores(t):
    """Out-of-fold scores of boosted trees, a fit per month, both arms in the same passes."""
    def build():
        d = model_frame(t)
        fits = fold_boosting.fit_folds(d, "usable", _months(d)[3:], {a: _arm_columns(a) for a in ("M0", "M1")}, "late", _BOOSTED)
        s = d.select("order_id", "month", F.col("late").alias("y"), *[fits.predict("month", a).alias(a) for a in ("M0", "M1")])
        return s.unpivot(["order_id", "month", "y"], [F.col(a).alias(f"GBT_{a}") for a in ("M0", "M1")], "model", "score").filter("score is not null")
    return t.stage("boosted_scores", build)


def benchmark_metrics(t):
    """Monthly metrics of every algorithm and arm."""
    def build():
        s = union([fold_scores(t, a).withColumn("model", F.concat(F.lit("LOGISTIC_"), "model")) for a in ("M0", "M1")]
                  + [x(t).select("order_id", "month", "y", "model", "score") for x in (forest_scores, boosted_scores)])
        return ev.all_metrics(s, ["model", "month"])
    return t.stage("benchmark_metrics", build)


@query("k3_algorithm_benchmark")
def _(t):
    return ev.rank_algorithms(benchmark_metrics(t))


@query("k3_arm_deltas")
def _(t):
    return ev.arm_deltas(benchmark_metrics(t), t.spark)


shared("o_rank", """select model, "month", n, p, round(ap / nullif(p, 0), 6) ap, round(u / nullif(p * (n - p), 0), 6) auc from (select model, "month", max(nt) n, max(pt) p, sum(c_p * (pt - pb) / (nt - nb)) ap, sum(c_p * ((nb - pb) + (c_n - c_p) / 2)) u from (
 select *, sum(c_n) over w2 nt, sum(c_p) over w2 pt, coalesce(sum(c_n) over w1, 0) nb, coalesce(sum(c_p) over w1, 0) pb from (select model, "month", score, count(*)::double c_n, sum(y)::double c_p from o_scores group by 1, 2, 3)
 window w1 as (partition by model, "month" order by score rows between unbounded preceding and 1 preceding), w2 as (partition by model, "month")) group by 1, 2)""")
_K = ["model", "month"]


@query("k4_average_precision", 'select model, "month", cast(n as bigint) n, cast(p as bigint) positives, ap from o_rank')
def _(t):
    return ev.ranking_metrics(scores(t), _K).drop("auc")


@query("k5_roc_auc", 'select model, "month", auc from o_rank')
def _(t):
    return ev.ranking_metrics(scores(t), _K).select("model", "month", "auc")


@query("k6_probability_metrics", 'select model, "month", round(avg((score - y) * (score - y)), 6) brier, round(-avg(y * ln(score) + (1 - y) * ln(1 - score)), 6) log_loss, round(avg(y), 6) prevalence from o_scores group by 1, 2')
def _(t):
    return ev.probability_metrics(scores(t), _K)


@query("k7_recall_at_fraction", " union all ".join(f"""select model, "month", {f}::double fraction, cast(greatest(1, ceil(max(n) * {f}::double)) as bigint) k, cast(sum(y) filter (rn <= greatest(1, ceil(n * {f}::double))) as bigint) hits,
 round(sum(y) filter (rn <= greatest(1, ceil(n * {f}::double)))::double / nullif(sum(y), 0), 6) recall from (select *, count(*) over (partition by model, "month") n, row_number() over (partition by model, "month" order by score desc, order_id) rn from o_scores) group by 1, 2""" for f in (.05, .1, .2)))
def _(t):
    return ev.recall_at(scores(t), _K, [.05, .1, .2])


@query("k8_macro_summary", 'select model, count(ap) "months", round(avg(ap), 6) mean_ap, round(median(ap), 6) median_ap, round(avg(auc), 6) mean_auc from o_rank group by 1')
def _(t):
    m = ev.ranking_metrics(scores(t), _K)
    return m.groupBy("model").agg(F.count("ap").alias("months"), rnd(F.avg("ap")).alias("mean_ap"), rnd(F.median("ap")).alias("median_ap"), rnd(F.avg("auc")).alias("mean_auc"))


_DEL = """(select a."month", b.ap - a.ap delta from o_rank a join o_rank b on a."month" = b."month" where a.model = 'M0' and b.model = 'M1' and a.ap is not null)"""


def deltas(t, metric="ap", higher=True):
    m = t.stage("fold_metrics", lambda: ev.all_metrics(scores(t), _K))
    return ev.oriented_deltas(m, "M0", "M1", metric, higher)


@query("k9_paired_wins", f'select count(*) "months", count(*) filter (delta > 1e-12) wins, count(*) filter (abs(delta) <= 1e-12) ties, count(*) filter (delta < -1e-12) losses, round(avg(delta), 6) mean_delta from {_DEL}')
def _(t):
    return ev.win_table(deltas(t))


def _named(t):
    """Monthly deltas of every metric over the months that have them all, so that one draw of months fits all series."""
    by = {m: {r["month"]: float(r["delta"]) for r in deltas(t, m, h).na.drop(subset=["delta"]).collect()} for m, h in (("ap", True), ("auc", True), ("brier", False), ("log_loss", False))}
    months = sorted(set.intersection(*map(set, by.values())))
    return {m: [d[x] for x in months] for m, d in by.items()}


@query("k10_bootstrap_interval")
def _(t):
    return inf.bootstrap_interval(t.spark, _named(t))


@query("k11_block_bootstrap")
def _(t):
    n = _named(t)
    return union([inf.bootstrap_interval(t.spark, n, block=b, circular=c).withColumn("circular", F.lit(c)) for b in (2, 3, 4) for c in (False, True)])


@query("k12_max_t_band")
def _(t):
    n = _named(t)
    return union([inf.max_t_band(t.spark, n, block=b).withColumn("block", F.lit(b)) for b in (2, 3, 4)])


@query("k13_deletion_robustness", " union all ".join(f"""select {k} removed, x."month" first_removed, round((select sum(delta) from {_DEL}) / 1.0 - s, 9) mean_x, round(((select sum(delta) from {_DEL}) - s) / ((select count(*) from {_DEL}) - {k}), 6) mean_delta
 from (select "month", sum(delta) over (order by "month" rows between current row and {k - 1} following) s, count(*) over (order by "month" rows between current row and {k - 1} following) c from {_DEL}) x where c = {k}""" for k in (1, 2, 3)).replace(f"round((select sum(delta) from {_DEL}) / 1.0 - s, 9) mean_x, ", ""))
def _(t):
    return inf.deletion_robustness(deltas(t), [1, 2, 3]).withColumn("mean_delta", rnd("mean_delta"))


@query("k14_sign_flip", f"""with d as (select row_number() over (order by "month") - 1 i, round(delta, 9) delta from {_DEL}), n as (select count(*) n, abs(sum(delta)) obs from d),
 x as (select id, delta, ((((id * 1597334677 + i * 3812015801 + 7) % 2147483648) * 1103515 + 12345) % 2147483648 * 1103515 + 12345) % 2147483648 v from range(0, 50000) r(id), d),
 f as (select id, sum(case when (v >> 20) & 1 = 1 then abs(delta) else -abs(delta) end) s from x group by 1)
select any_value(n) n, count(*) patterns, round(avg(cast(abs(s) >= obs - 1e-12 as int)), 6) p_value from f, n""")
def _(t):
    return inf.sign_flip(t.spark, inf.series(deltas(t).select("month", rnd("delta", 9).alias("delta"))))


@query("k15_sign_test")
def _(t):
    return inf.sign_test(deltas(t))


@query("k15_wilcoxon", f"""select count(*) n, round(coalesce(sum(r) filter (delta > 0), 0), 4) w_plus, round((coalesce(sum(r) filter (delta > 0), 0) - count(*) * (count(*) + 1) / 4.0::double) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0::double - sum((c * c - 1) / 48.0::double)), 5) z
from (select delta, c, rank() over (order by a) + (c - 1) / 2.0::double r from (select delta, a, count(*) over (partition by a) c from (select round(delta, 6) delta, abs(round(delta, 6)) a from {_DEL} where round(delta, 6) <> 0)))""")
def _(t):
    return inf.wilcoxon(deltas(t).select("month", rnd("delta").alias("delta")))


def _arm(m):
    return f"(select *, score s from o_scores where model = '{m}')"


_CB = " union all ".join(f"select '{m}' model, bin, count(*) n, avg(score) mean_score, avg(y) observed from {_bin_sql('score', 10, _arm(m) + ' z').replace('from ' + _arm(m) + ' z s,', 'from ' + _arm(m) + ' s,')} group by 2" for m in ("M0", "M1"))


@query("k16_calibration_bins", f"select model, bin, n, round(mean_score, 6) mean_score, round(observed, 6) observed from ({_CB})")
def _(t):
    return ev.calibration_bins(scores(t), ["model"]).withColumns({k: rnd(k) for k in ("mean_score", "observed")})


@query("k16_calibration_error", f"select model, cast(sum(n) as bigint) n, round(sum(n * abs(mean_score - observed)) / sum(n), 6) ece, round(max(abs(mean_score - observed)), 6) mce from ({_CB}) group by 1")
def _(t):
    return ev.calibration_error(ev.calibration_bins(scores(t), ["model"]), ["model"])


# the same bins within each month: edges are quantiles of the month's scores, 12 decimals keep means over 16 rows from ties
_CBM = """select model, "month", bin, count(*) n, avg(score) mean_score, avg(y) observed from (
 select s.*, greatest(len(list_filter(edges, lambda e: e < round(score, 12))) - 1, 0) bin from o_scores s join (
  select model, "month", list_sort(list_distinct([""" + ", ".join(f"round(quantile_cont(score::double, {i / 10}), 12)" for i in range(11)) + """])) edges from o_scores where score is not null group by 1, 2)
 using (model, "month") where score is not null) group by 1, 2, 3"""


@query("k16_calibration_bins_by_month", f"""select model, "month", bin, n, round(mean_score, 12) mean_score, round(observed, 12) observed from ({_CBM})""")
def _(t):
    return ev.calibration_bins(scores(t), ["model", "month"], digits=12).withColumns({k: rnd(k, 12) for k in ("mean_score", "observed")})


@query("k16_calibration_error_by_month", f"""select model, "month", cast(sum(n) as bigint) n, round(sum(n * abs(mean_score - observed)) / sum(n), 12) ece, round(max(abs(mean_score - observed)), 12) mce from ({_CBM}) group by 1, 2""")
def _(t):
    keys = ["model", "month"]
    return ev.calibration_error(ev.calibration_bins(scores(t), keys, digits=12), keys, 12)


@query("k17_brier_decomposition", f"""select b.model, round(any_value(br), 6) brier, round(sum(n * (mean_score - observed) * (mean_score - observed)) / sum(n), 6) reliability, round(sum(n * (observed - yb) * (observed - yb)) / sum(n), 6) resolution, round(any_value(yb * (1 - yb)), 6) uncertainty,
 round(1 - any_value(br / (yb * (1 - yb))), 6) skill, round(any_value(pb - yb), 6) in_the_large from ({_CB}) b join (select model, avg(y) yb, avg(score) pb, avg((score - y) * (score - y)) br from o_scores group by 1) a on a.model = b.model group by 1""")
def _(t):
    return ev.brier_decomposition(scores(t), ["model"])


@query("k18_calibration_line")
def _(t):
    out = []
    for m in ("M0", "M1"):
        s = scores(t).filter(F.col("model") == m)
        f = ev.calibration_line(s)
        ece = ev.calibration_error(ev.calibration_bins(s, ["model"]), ["model"]).first()["ece"]
        out.append((m, float(f.coef[0]), float(f.coef[1]), ece, ev.acceptance(float(f.coef[0]), float(f.coef[1]), ece)))
    return t.spark.createDataFrame(out, "model string, intercept double, slope double, ece double, acceptance string")


def _terms():
    return F.array(*[F.lit(n) for n in _CORE + _PLUS])


@query("k19_coefficients")
def _(t):
    """Coefficients of every fold per deviation and in raw units."""
    cells = F.arrays_zip(_terms().alias("term"), F.slice("scaled", 2, 99).alias("coef_per_sd"), F.slice("coef", 2, 99).alias("coef_raw"), "mean", "sd")
    d = fold_fits(t, "M1").select("month", "n", F.inline(cells))
    return d.withColumn("odds_ratio_per_sd", F.exp("coef_per_sd"))


@query("k19_coefficient_summary")
def _(t):
    d = fold_fits(t, "M1").select("month", F.inline(F.arrays_zip(_terms().alias("term"), F.slice("scaled", 2, 99).alias("b"))))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("folds"), F.avg("b").alias("mean_coef"), F.median("b").alias("median_coef"), F.min("b").alias("min_coef"), F.max("b").alias("max_coef"),
                                 n_if(F.col("b") > 0).alias("positive_folds"), n_if(F.col("b") < 0).alias("negative_folds"), F.exp(F.median("b")).alias("median_odds_ratio"))


def _contributions(t):
    """Held-out rows with the part of the logit that each term adds."""
    parts = F.array(*[(F.col(x) - F.col("mean")[i]) / F.col("sd")[i] * F.col("scaled")[i + 1] for i, x in enumerate(_CORE + _PLUS)])
    return held_out(t, "M1").withColumn("parts", parts)


@query("k19_logit_identity")
def _(t):
    """Intercept plus contributions against the logit of the out-of-fold score, per month."""
    total = F.col("scaled")[0] + F.aggregate("parts", F.lit(0.0), lambda s, v: s + v)
    p = F.col("score")
    d = _contributions(t).join(fold_scores(t, "M1").select("order_id", "score"), "order_id")
    gap = F.abs(total - F.log(p / (1 - p)))
    return d.groupBy("month").agg(F.count(F.lit(1)).alias("n"), n_if(gap > 1e-6).alias("violations"))


@query("k19_top_driver_share")
def _(t):
    """Share of held-out rows whose largest absolute contribution is each term."""
    size = F.transform("parts", F.abs)
    d = _contributions(t).withColumn("_c", size)
    top = F.element_at(_terms(), F.array_position("_c", F.array_max("_c")).cast("int"))
    g = d.groupBy(top.alias("top_driver")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", rnd(F.col("n") / d.agg(F.count(F.lit(1))).scalar()))


@query("k20_permutation_importance")
def _(t):
    """Drop of the average precision when a term's values are permuted within a held-out month, five repeats."""
    names = _CORE + _PLUS
    rows = held_out(t, "M1").join(fold_scores(t, "M1").select("order_id", "y", "score"), "order_id")
    new = ev.permuted_values(rows, "month", names, 5)
    here = F.array_position(_terms(), F.col("term")).cast("int")
    old = F.get(F.array(*[F.col(x).cast("double") for x in names]), here - 1)
    eta = F.log(F.col("score") / (1 - F.col("score"))) + F.get("coef", here) * (F.col("new") - old)
    s = new.join(rows, ["order_id", "month"]).select("month", "term", "repeat", "y", (1 / (1 + F.exp(-eta))).alias("score"))
    after = ev.ranking_metrics(s, ["month", "term", "repeat"]).select("month", "term", "repeat", "ap")
    base = ev.ranking_metrics(rows, ["month"]).select("month", F.col("ap").alias("base_ap"))
    d = after.join(base, "month").withColumn("drop", F.col("base_ap") - F.col("ap")).filter("drop is not null")
    return d.groupBy("term").agg(F.countDistinct("month").alias("folds"), F.count(F.lit(1)).alias("permutations"), rnd(F.avg("drop")).alias("ap_drop"), rnd(F.stddev_samp("drop")).alias("ap_drop_std"))


@query("k21_prequential_blend", """with m as (select "month", count(*) n, sum((m0-m1)*(m0-m1)) dd, sum((m0-m1)*(m1-y)) de, sum((m1-y)*(m1-y)) ee from o_wide group by 1),
p as (select *, sum(n) over w pn, sum(dd) over w pdd, sum(de) over w pde, sum(ee) over w pee from m window w as (order by "month" rows between unbounded preceding and 1 preceding)),
g as (select p.*, i / 20.0::double alpha, coalesce(round((i/20.0::double*i/20.0::double*pdd + 2*i/20.0::double*pde + pee)/pn, 10), 0) s from p, range(0, 21) r(i))
select "month", n, alpha, round((alpha*alpha*dd + 2*alpha*de + ee)/n, 6) brier from (select *, row_number() over (partition by "month" order by s, round(abs(alpha - 0.5), 6), alpha) rn from g) where rn = 1""")
def _(t):
    return ev.prequential_blend(wide(t), "m0", "m1")


@query("k22_winner_table", """select metric, model, "value" from (select *, row_number() over (partition by metric order by case when metric in ('mean_brier') then "value" else -"value" end, model) rn from (
 select model, 'mean_ap' metric, round(avg(ap), 6) "value" from o_rank group by 1 union all select model, 'mean_auc', round(avg(auc), 6) from o_rank group by 1 union all select model, 'mean_brier', round(avg((score-y)*(score-y)), 6) from o_scores group by 1)) where rn = 1""")
def _(t):
    r = ev.ranking_metrics(scores(t), _K).groupBy("model").agg(rnd(F.avg("ap")).alias("mean_ap"), rnd(F.avg("auc")).alias("mean_auc"))
    d = r.join(ev.probability_metrics(scores(t), ["model"]).select("model", F.col("brier").alias("mean_brier")), "model")
    long = d.unpivot(["model"], ["mean_ap", "mean_auc", "mean_brier"], "metric", "value")
    sign = F.when(F.col("metric") == "mean_brier", F.col("value")).otherwise(-F.col("value"))
    return long.groupBy("metric").agg(F.min(F.struct(sign.alias("s"), "model", "value")).alias("z")).select("metric", "z.model", "z.value")


@query("k23_brier_gauss_newton")
def _(t):
    d = models.standardised(model_frame(t), _CORE + _PLUS)
    z = [f"{k}_z" for k in _CORE + _PLUS]
    free, fixed = ev.brier_fit(d, "late", z), ev.brier_fit(d, "late", z[:-1])
    rows = [(n, m, float(c), float(f.stats["brier"])) for n, f in (("FREE", free), ("LAST_COEFFICIENT_ZERO", fixed)) for m, c in zip(f.names, f.coef, strict=True)]
    return t.spark.createDataFrame(rows, "model string, term string, coef double, brier double")


# ---------------------------------------------------------------- functional curves
_CH = ["volume", "freight_cents"]


def _start(t):
    return t.orders.agg(F.min(us("order_purchase_timestamp"))).first()[0]


def _arrays(t, channel):
    return fn.curve_arrays(_curves(t), channel)


def _grams(t, channel, days):
    return fn.moments(t.stage(f"grams_{channel}", lambda: fn.gram_rows(_arrays(t, channel), _start(t))), days)


@query("k24_functional_basis")
def _(t):
    rows = [r for c in _CH for w in fn.WINDOWS for r in fn.basis_rows(_grams(t, c, w), c, w)]
    return t.spark.createDataFrame(rows, "channel string, days int, month string, n long, test_rows long, status string, k80 int, k90 int, k95 int, k99 int, rank int, condition double")


_REC = "channel string, days int, month string, pve double, k int, error double, train_error double, inflation double"


def _recon(t):
    return [r for c in _CH for w in fn.WINDOWS for r in fn.reconstruction_rows(_grams(t, c, w), c, w)]


@query("k25_reconstruction_error")
def _(t):
    return t.spark.createDataFrame(_recon(t), _REC)


@query("k25_policy_one_se")
def _(t):
    d = pd.DataFrame(_recon(t), columns=["channel", "days", "month", "pve", "k", "error", "train_error", "inflation"])
    out = pd.concat([fn.one_se(g, "pve", "error", "k").assign(channel=c, days=w) for (c, w), g in d.groupby(["channel", "days"])])
    return t.spark.createDataFrame(out)


# fixed values: degrees of freedom of a smoother as shares of the window
_DF_RATIOS = (0.75, 0.50, 0.25)


@query("k26_negative_smoothing")
def _(t):
    made = {(w, r): fn.smoother(w, r * w) for w in fn.WINDOWS for r in _DF_RATIOS}
    penalty = t.spark.createDataFrame([(w, r, float(lam)) for (w, r), (_h, lam) in made.items()], "days int, df_ratio double, penalty double")
    out = union([fn.negative_mass(_arrays(t, c), {k: h for k, (h, _l) in made.items()}).withColumn("channel", F.lit(c)) for c in _CH])
    return out.join(penalty, ["days", "df_ratio"]).withColumns({"negative_mass_share": rnd("negative_mass_share", 8), "target_df": F.col("days") * F.col("df_ratio")})


@query("k27_raw_vs_smooth")
def _(t):
    h, _l = fn.smoother(30, 0.75 * 30)
    rows = [r for c in _CH for r in fn.raw_vs_smooth_rows(_grams(t, c, 30), h, c)]
    return t.spark.createDataFrame(rows, "channel string, month string, k90 int, distortion double, raw_error double, smooth_error double, angle_deg double")


_BCV = ["channel", "held_days", "month", "k", "sse", "energy", "relative_error"]


def _bcv(t):
    return pd.DataFrame([r for c in _CH for r in fn.bcv_rows(_grams(t, c, 30), c)], columns=_BCV)


def _bcv_frame(t):
    return t.spark.createDataFrame(_bcv(t), "channel string, held_days int, month string, k int, sse double, energy double, relative_error double")


@query("k28_bcv_rank_errors")
def _(t):
    return _bcv_frame(t).groupBy("channel", "held_days", "k").agg(F.count(F.lit(1)).alias("months"), F.avg("relative_error").alias("mean_error"), F.sqrt(F.sum("sse") / F.sum("energy")).alias("pooled_error"))


@query("k28_rank_one_se")
def _(t):
    out = [fn.one_se(g.assign(size=g["k"]), "k", "relative_error", "size").assign(channel=c, held_days=w) for (c, w), g in _bcv(t).groupby(["channel", "held_days"])]
    return t.spark.createDataFrame(pd.concat(out))


@query("k28_best_rank_by_month")
def _(t):
    """Rank with the least sqrt(sum of squares / energy) per month, over the holdouts that reach it; ties go to the smaller rank."""
    d = _bcv_frame(t).groupBy("channel", "month", "k").agg(F.count(F.lit(1)).alias("holdouts"), F.sqrt(F.sum("sse") / F.sum("energy")).alias("error"))
    d = d.filter(F.col("holdouts") == len(fn.HOLDOUTS))
    return d.groupBy("channel", "month").agg(F.min(F.struct("error", "k")).alias("z")).select("channel", "month", F.col("z.k").alias("best_k"), F.col("z.error").alias("error"))


@query("k29_rank_stability")
def _(t):
    """Block-bootstrap frequency of the best rank over months for each block length, entropy and cumulative evidence."""
    from pyspark.sql import Window
    errors = {k: g.pivot(index="month", columns="k", values="relative_error").sort_index().to_numpy() for k, g in _bcv(t).groupby(["channel", "held_days"])}
    months = len(next(iter(errors.values())))
    u = union([fn.best_rank_draws(inf.replicate_positions(t.spark, months, 20_000, 11, b, True), errors).withColumn("block", F.lit(b)) for b in (2, 3, 4)])
    keys = ["channel", "held_days", "block"]
    w, run = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("k")
    f = u.withColumn("frequency", F.col("replicates") / F.sum("replicates").over(w))
    return f.select(*keys, "k", "replicates", "frequency", F.sum("frequency").over(run).alias("cumulative_evidence"),
                    (-F.sum(F.col("frequency") * F.log("frequency")).over(w) / F.greatest(F.log(F.count(F.lit(1)).over(w).cast("double")), F.lit(1e-12))).alias("normalized_entropy"))


@query("k30_policy_tradeoff")
def _(t):
    from pyspark.sql import Window
    d = t.spark.createDataFrame(_recon(t), _REC).groupBy("channel", "days", "pve").agg(F.avg("k").alias("mean_k"), F.avg("error").alias("mean_error"))
    w = Window.partitionBy("channel", "days").orderBy("pve")
    dk, de = F.col("mean_k") - F.lag("mean_k").over(w), F.lag("mean_error").over(w) - F.col("mean_error")
    return d.select("channel", "days", "pve", "mean_k", "mean_error", dk.alias("extra_components"), de.alias("error_gain"), (de / F.nullif(dk, F.lit(0.0))).alias("gain_per_component"))


# fixed values: components per channel
_SIZES = [0, 1, 2, 3, 4, 5, 6, 10, 15, 20, 23, 25, 27, 30]


def _component_fits(t):
    """Core features plus 2k component scores for each k; bases and fits of a month come from its training rows."""
    def build():
        d = model_frame(t).select("order_id", "t0", "month", "usable", F.col("late").cast("double").alias("y"), *_CORE)
        d = pit.day_curves(_curve_events(t), d, _CH, 30)
        values = F.concat(F.array(F.lit(1.0), *[F.col(x).cast("double") for x in _CORE]), *[F.col(c).cast("array<double>") for c in _CH])
        return d.select("order_id", "month", "usable", "y", values.alias("values"))
    d = t.stage("component_rows", build)
    coefs, converged, _scales = component_grid.fit_grid(d, _months(d)[3:], len(_CORE), 30, _SIZES)
    return d, coefs, converged


@query("k31_supervised_k_grid")
def _(t):
    d, coefs, converged = _component_fits(t)
    m = ev.all_metrics(component_grid.score_grid(d, coefs, _SIZES), ["k", "month"])
    g = m.groupBy("k").agg(F.count(F.lit(1)).alias("folds"), rnd(F.avg("ap")).alias("mean_ap"), rnd(F.avg("auc")).alias("mean_auc"), rnd(F.avg("brier")).alias("mean_brier"), rnd(F.avg("log_loss")).alias("mean_log_loss"))
    counts = t.spark.createDataFrame([(k, sum(ok for (_f, size), ok in converged.items() if size == k)) for k in _SIZES], "k int, converged_folds int")
    return g.join(counts, "k")


@query("k12_joint_band_over_k")
def _(t):
    """Every number of components against none: bands over the 13 alternatives of each metric, for each block length."""
    def build():
        d, coefs, _ = _component_fits(t)
        return ev.all_metrics(component_grid.score_grid(d, coefs, _SIZES), ["k", "month"])
    m = t.stage("component_metrics", build)
    measures = {"ap": 1, "auc": 1, "brier": -1, "log_loss": -1}
    rows = m.na.drop(subset=list(measures)).select("k", "month", *measures).collect()  # months times 14 numbers of components
    by = {(r["k"], r["month"]): r for r in rows}
    months = sorted(x for x in {r["month"] for r in rows} if all((k, x) in by for k in _SIZES))
    families = {f: {f"k={k}": [sign * (by[k, x][f] - by[0, x][f]) for x in months] for k in _SIZES[1:]} for f, sign in measures.items()}
    return union([inf.joint_bands(t.spark, families, block=b).withColumn("block", F.lit(b)) for b in (2, 3, 4)])


@query("k15_wilcoxon_exact")
def _(t):
    return inf.wilcoxon_exact(deltas(t).select("month", rnd("delta").alias("delta")))
