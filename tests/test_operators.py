"""Hand-built edge cases and brute-force twins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelscope.functions import columns as x
from parcelscope.operators import checks, component_grid, evaluation, functional, gold, inference, joins, label, models, pit, ranks, statistics
from parcelscope.operators import freight as fr
from parcelscope.sources import bronze

DAY = x.DAY_US


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ ranks
@pytest.mark.parametrize("kind", ["spread", "constant", "negative", "heavy_tail", "ties"])
def test_exact_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    v = {"spread": rng.normal(size=501), "constant": np.full(40, 7.5), "negative": -rng.exponential(10, 300),
         "heavy_tail": np.concatenate([rng.exponential(1, 500), [1e12]]), "ties": rng.integers(0, 4, 400).astype(float)}[kind]
    d = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = {"a": 0.0, "b": .1, "c": .5, "d": .93, "e": 1.0}
    got = ranks.exact_quantiles(d, [], "v", probs).first()
    for k, p in probs.items():
        assert got[k] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)


def test_one_group_with_most_rows(spark):
    d = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("g"),
                                  ((F.col("id") * 7919) % 1009).cast("double").alias("v"))
    p = d.toPandas()
    got = {r["g"]: r["m"] for r in ranks.exact_quantiles(d, ["g"], "v", {"m": .5}).collect()}
    want = p.groupby("g")["v"].median()
    assert len(got) == len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_average_rank_equals_pandas(spark):
    p = pd.DataFrame({"v": [3.0, 1.0, 3.0, -2.0, 0.0, 3.0, 1.0]})
    got = {r["v"]: r["rank"] for r in ranks.average_rank(spark.createDataFrame(p), [], "v").collect()}
    for v, r in zip(p["v"], p["v"].rank(), strict=True):
        assert got[v] == r


def test_qcut_drops_duplicate_edges(spark):
    p = pd.DataFrame({"v": [0.0] * 50 + list(np.arange(1, 51, dtype=float))})
    got = ranks.qcut(spark.createDataFrame(p), "v", 4).toPandas().sort_values("v")["bin"].tolist()
    assert got == pd.qcut(p["v"].sort_values(), 4, labels=False, duplicates="drop").tolist()


def test_expanding_median_equals_direct(spark):
    rng = np.random.default_rng(1)
    months = [f"2001-{i:02d}" for i in range(1, 8)]
    p = pd.DataFrame({"m": rng.choice(months, 400), "v": rng.normal(size=400).round(2)})
    got = {r["fold"]: (r["n_train"], r["median"]) for r in ranks.expanding_median(spark.createDataFrame(p), "m", "v", months).collect()}
    for m in months[1:]:
        past = p[p["m"] < m]["v"]
        assert got[m][0] == len(past)
        assert got[m][1] == pytest.approx(past.median())


# ------------------------------------------------------------------ point in time
def test_prefix_is_strict_and_window_start_inclusive(spark):
    t0 = 100 * DAY
    times = [t0 - 30 * DAY - 1, t0 - 30 * DAY, t0 - 1, t0, t0 + 1]
    ev = frame(spark, [(1, t, 1) for t in times], "k long, t long, n long")
    pr = frame(spark, [(1, 0, t0), (1, 30, t0 - 30 * DAY)], "k long, back int, t long")
    got = {r["back"]: r["n"] for r in pit.prefix_at(ev, pr, ["k"], ["n"]).collect()}
    assert got == {0: 3, 30: 1}
    assert got[0] - got[30] == 2


def test_lag_curves_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(0, 40 * DAY, 300))
    ev = spark.createDataFrame(pd.DataFrame({"t": t, "n": np.ones(300, dtype=int), "w": rng.integers(0, 50, 300)}))
    tg = spark.createDataFrame(pd.DataFrame({"order_id": range(40), "t0": t[-40:]}))
    a = pit.lag_curves(ev, tg, ["n", "w"], lags=10).toPandas()
    p = ev.toPandas()
    for r in a.itertuples():
        lo, hi = r.t0 - (r.lag + 1) * DAY, r.t0 - r.lag * DAY
        s = p[(p["t"] >= lo) & (p["t"] < hi)]
        assert (r.n, r.w) == (len(s), s["w"].sum())
    b = pit.direct_curves(ev, tg, ["n", "w"], one_in=1, lags=10).toPandas()
    m = a[a["n"] > 0].merge(b, on=["order_id", "lag"], how="outer", suffixes=("", "_d"))
    assert (m["n"] == m["n_d"]).all() and (m["w"] == m["w_d"]).all()


# ------------------------------------------------------------------ gold, label, joins
def ts(s):
    return pd.Timestamp(s).to_pydatetime()


def small_orders(spark):
    rows = [(1, 1, " Delivered ", ts("2020-01-01 10:00"), ts("2020-01-05 23:00"), ts("2020-01-05 00:00")),
            (2, 1, "delivered", ts("2020-01-02 10:00"), ts("2020-01-09 00:00"), ts("2020-01-08 00:00")),
            (3, 2, "canceled", ts("2020-01-03 10:00"), ts("2020-01-06 00:00"), ts("2020-01-08 00:00")),
            (4, 2, "shipped", ts("2020-01-03 10:00"), None, ts("2020-01-08 00:00")),
            (5, 2, "shipped", ts("2020-01-03 10:00"), None, ts("2020-03-08 00:00")),
            (6, 2, "canceled", ts("2020-01-03 10:00"), None, ts("2020-01-04 00:00"))]
    return spark.createDataFrame(rows, "order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp_ntz, "
                                       "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")


def test_same_day_delivery_is_late_only_under_strict_time(spark):
    t = label.with_labels(gold.task_orders(small_orders(spark)))
    got = {r["order_id"]: (r["timestamp_strict"], r["calendar_day"], r["calendar_day_plus_1_grace"]) for r in t.collect()}
    assert got == {1: (1, 0, 0), 2: (1, 1, 0)}


def test_unobserved_is_null_not_on_time(spark):
    got = {r["order_id"]: r["late_delivery_calendar_day"] for r in gold.service_outcomes(small_orders(spark)).collect()}
    assert got[4] is None and got[1] is False and got[2] is True


def test_observation_classes(spark):
    got = {r["order_id"]: r["observation_class"] for r in label.observation_class(small_orders(spark)).collect()}
    # an untrimmed status is part of the cohort but its raw text differs, as in the ordered overwrite
    assert got[2] == "OBSERVED_DELIVERED" and got[3] == "OUTCOME_PRESENT_STATUS_MISMATCH"
    assert got[4] == "OUTCOME_UNOBSERVED_BY_DATASET_END" and got[5] == "RIGHT_CENSORING_CANDIDATE"
    assert got[6] == "NOT_APPLICABLE_TERMINAL_NON_DELIVERY"


def test_ratio_with_zero_price_and_orders_without_items(spark):
    items = frame(spark, [(1, 10, 100, 0.0, 5.0), (1, 11, 100, 0.0, 1.0)], "order_id long, product_id long, seller_id long, price double, freight_value double")
    got = {r["order_id"]: r for r in gold.features_core(small_orders(spark), items).collect()}
    assert got[1]["freight_price_ratio"] is None and got[1]["item_count"] == 2 and got[1]["unique_seller_count"] == 1
    assert not got[2]["has_order_items"] and got[2]["total_price"] is None


def test_checked_join_refuses_to_multiply(spark):
    a = frame(spark, [(1,), (2,)], "k long")
    b = frame(spark, [(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(a, b, ["k"])


def test_key_with_null_part_counts(spark):
    d = frame(spark, [(1, None), (1, None), (1, 2)], "a long, b long")
    assert d.agg(checks.duplicate_keys(d, ["a", "b"])).first()[0] == 1


def test_gate_requires_previous_pass(spark):
    c = frame(spark, [("x", "FAIL", "1", "0")], "check_name string, status string, observed string, expected string")
    with pytest.raises(RuntimeError):
        checks.require_pass(checks.scorecard(c))


# ------------------------------------------------------------------ functions and sources
def test_text_and_code_cleaning(spark):
    d = frame(spark, [("São  João-del Rei", "1.0", "12,345(1)", "123", "1234567")], "a string, b string, c string, d string, e string")
    r = d.select(x.norm_text("a"), x.clean_code("b", 4), x.parse_population("c"), x.zip5("d"), x.zip5("e")).first()
    assert tuple(r) == ("SAO JOAO DEL REI", "0001", 12345, "00123", "1234567")


def test_bronze_csv_and_silver(spark, tmp_path):
    f = tmp_path / "order_items.csv"
    f.write_text("﻿order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
                 "a,1,p,s,2020-01-01 00:00:00,10.5,\na,1,p,s,2020-01-01 00:00:00,10.5,\nb,x,p,s,,oops,1\n", encoding="utf-8")
    b = bronze.bronze_scan(spark, str(f), "order_items")
    assert b.count() == 3 and b.select("_source_file").first()[0] == "order_items.csv"
    assert {c for c, t in b.dtypes if t != "string"} == set()
    s = {(r["order_id"], r["order_item_id"], r["price"], r["freight_value"]) for r in bronze.silver_type(b, "order_items").collect()}
    assert s == {("a", 1, 10.5, None), ("b", None, None, 1.0)}


def test_write_table_and_missing_columns(spark, tmp_path):
    d = frame(spark, [(1, "a")], "k long, v string")
    bronze.write_table(d, str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first()["v"] == "a"
    with pytest.raises(bronze.MissingColumns):
        bronze.require_columns(d, ["k", "absent"])


def test_stage_uses_the_shared_folder_when_named(spark, tmp_path, monkeypatch):
    from parcelscope import session
    d = frame(spark, [(1, "a")], "k long, v string")
    monkeypatch.setattr(session, "shared_folder", lambda s: str(tmp_path))
    out = session.stage(spark, "scope-x", "table_x", lambda: d)
    assert out.collect() == d.collect() and list(tmp_path.rglob("*.parquet"))
    assert session.stage(spark, "scope-x", "table_x", lambda: 1 / 0).count() == 1


# ------------------------------------------------------------------ models
def data(n=800, seed=2):
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n) * 3 + 1, "g": rng.integers(0, 12, n), "h": rng.integers(0, 9, n)})
    eta = 0.4 + 0.8 * p["a"] - 0.3 * p["b"]
    p["y"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    p["z"] = 2 + p["a"] - 0.5 * p["b"] + rng.normal(size=n) + 0.7 * np.sin(p["g"])
    return p


def xmat(p):
    return np.column_stack([np.ones(len(p)), p["a"], p["b"]])


def test_ols_hc1_and_clusters(spark):
    p = data()
    x_, y = xmat(p), p["z"].to_numpy()
    beta = np.linalg.lstsq(x_, y, rcond=None)[0]
    e = y - x_ @ beta
    inv = np.linalg.inv(x_.T @ x_)
    n, k = x_.shape
    f = models.ols(spark.createDataFrame(p), "z", ["a", "b"])
    assert np.allclose(f.coef, beta)
    assert np.allclose(f.robust, inv @ (x_.T * e ** 2 @ x_) @ inv * n / (n - k))
    s = pd.DataFrame(x_ * e[:, None]).groupby(p["g"]).sum().to_numpy()
    one = inv @ s.T @ s @ inv * 12 / 11 * (n - 1) / (n - k)
    assert np.allclose(models.ols(spark.createDataFrame(p), "z", ["a", "b"], ["g"]).robust, one)
    assert models.ols(spark.createDataFrame(p), "z", ["a", "b"], ["g", "h"]).robust.shape == (3, 3)


def test_logit_solves_score_equations(spark):
    p = data()
    f = models.logit(spark.createDataFrame(p), "y", ["a", "b"])
    mu = 1 / (1 + np.exp(-xmat(p) @ f.coef))
    assert np.allclose(xmat(p).T @ (p["y"] - mu), 0, atol=1e-6)
    assert f.stats["llf"] == pytest.approx(np.sum(p["y"] * np.log(mu) + (1 - p["y"]) * np.log(1 - mu)))


def test_wide_design_equals_sql_sums(spark):
    p = data(200)
    d = spark.createDataFrame(p).select("a", "b", F.lit(1.0).alias("w"), F.col("z"))
    a, b = models._wide_products(d, ["a", "b"], "w", "z")
    m = p[["a", "b"]].to_numpy()
    assert np.allclose(a, m.T @ m) and np.allclose(b, m.T @ p["z"])


def test_fold_logit_equals_single_fits(spark):
    p = data()
    p["u"] = [f"m{i % 5}" for i in range(len(p))]
    d = spark.createDataFrame(p)
    fits = models.fold_logit(d, "u", ["m2", "m4"], ["a", "b"], "y", c=None)
    for m in ("m2", "m4"):
        one = models.logit(d.filter(F.col("u") < m), "y", ["a", "b"])
        assert np.allclose(fits[m]["coef"], one.coef, atol=1e-6)
    ridge = models.fold_logit(d, "u", ["m4"], ["a", "b"], "y", c=0.01)["m4"]
    assert abs(ridge["scaled"][1]) < abs(fits["m4"]["scaled"][1])


def test_expanding_ols_equals_numpy(spark):
    p = data()
    p["m"] = [f"m{i % 6}" for i in range(len(p))]
    got = models.expanding_ols(spark.createDataFrame(p), "m", [f"m{i}" for i in range(6)], ["a", "b"], "z", 3, 100)
    assert sorted(got) == ["m3", "m4", "m5"]
    q = p[p["m"] < "m5"]
    assert np.allclose(got["m5"], np.linalg.lstsq(xmat(q), q["z"], rcond=None)[0])


def test_benjamini_hochberg(spark):
    d = frame(spark, [("m", f"t{i}", v) for i, v in enumerate([.01, .04, .03, .5])], "model string, term string, p_value double")
    got = {r["term"]: r["q_value"] for r in models.benjamini_hochberg(d).collect()}
    assert [round(got[f"t{i}"], 6) for i in range(4)] == [0.04, round(0.16 / 3, 6), round(0.16 / 3, 6), 0.5]


def test_random_intercept_recovers_group_variance(spark):
    rng = np.random.default_rng(0)
    g = rng.integers(0, 60, 4000)
    u = rng.normal(0, 2, 60)
    p = pd.DataFrame({"g": g, "a": rng.normal(size=4000)})
    p["y"] = 1 + 0.5 * p["a"] + u[g] + rng.normal(size=4000)
    r = {r["term"]: r["estimate"] for r in statistics.random_intercept(spark.createDataFrame(p), "y", ["a"], "g").collect()}
    assert r["a"] == pytest.approx(0.5, abs=0.06) and r["group_variance"] == pytest.approx(u.var(), rel=0.35)


def test_beta_interval_known_values():
    lo, hi = statistics.beta_interval(1, 1)
    assert lo == pytest.approx(.025, abs=1e-4) and hi == pytest.approx(.975, abs=1e-4)
    assert statistics.beta_exceeds(50, 50, 50, 50) == pytest.approx(.5, abs=1e-6)


def test_brier_fit_is_stationary(spark):
    p = data(600)
    f = evaluation.brier_fit(spark.createDataFrame(p), "y", ["a", "b"])
    mu = 1 / (1 + np.exp(-xmat(p) @ f.coef))
    grad = xmat(p).T @ ((mu - p["y"]) * mu * (1 - mu))
    assert np.max(np.abs(grad)) < 1e-3


# ------------------------------------------------------------------ metrics and inference
def test_metrics_with_ties_and_single_class(spark):
    rows = [("a", 1, 1, .9), ("a", 2, 0, .9), ("a", 3, 1, .4), ("a", 4, 0, .2), ("b", 5, 0, .3), ("b", 6, 0, .1)]
    d = frame(spark, rows, "model string, order_id long, y int, score double")
    got = {r["model"]: r for r in evaluation.ranking_metrics(d, ["model"]).collect()}
    assert got["a"]["ap"] == pytest.approx(round(.5 * .5 + .5 * 2 / 3, 6)) and got["a"]["auc"] == pytest.approx(.625)
    assert got["b"]["ap"] is None and got["b"]["auc"] is None
    r = {x_["model"]: x_ for x_ in evaluation.recall_at(d, ["model"], [.25]).collect()}
    assert r["a"]["k"] == 1 and r["a"]["hits"] == 1 and r["a"]["recall"] == .5


def test_permutation_keeps_the_values(spark):
    d = spark.range(500).select(F.col("id").alias("order_id"), F.concat(F.lit("m"), F.col("id") % 2).alias("month"), (F.col("id") % 37).alias("v"), F.col("id").alias("w"))
    p = evaluation.permuted_values(d, "month", ["v", "w"], 2).toPandas()
    assert len(p) == 2000 and not p.duplicated(["order_id", "term", "repeat"]).any()
    for (m, term, _), g in p.groupby(["month", "term", "repeat"]):
        ids = [i for i in range(500) if i % 2 == int(m[1])]
        assert sorted(g["new"]) == sorted(i % 37 if term == "v" else i for i in ids)
        assert (g["new"] != (g["order_id"] % 37 if term == "v" else g["order_id"])).mean() > .8


def test_sign_flip_three_values(spark):
    r = inference.sign_flip(spark, [1.0, 2.0, 3.0]).first()
    assert r["patterns"] == 8 and r["p_value"] == .25


def test_sign_test_and_bootstrap(spark):
    d = frame(spark, [(f"m{i}", 1.0 if i < 9 else -1.0) for i in range(10)], "month string, delta double")
    assert inference.sign_test(d).first()["p_value"] == pytest.approx(round(22 / 1024, 6))
    b = inference.bootstrap_interval(spark, {"s": [0.5] * 12}, reps=200, block=3).first()
    assert b["ci_low"] == b["ci_high"] == .5 and b["decision"] == "IMPROVES"
    m = inference.bootstrap_means(spark, {"s": [float(i) for i in range(12)]}, 3000, 1).toPandas()["s"]
    assert m.mean() == pytest.approx(5.5, abs=.1) and m.std() == pytest.approx(np.std(range(12)) / np.sqrt(12), rel=.1)


def test_bootstrap_median_interval_close_to_resampling(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=2000)
    r = statistics.bootstrap_median_interval(spark.createDataFrame(pd.DataFrame({"v": v})), [], "v").first()
    reps = np.median(rng.choice(v, (800, 2000)), axis=1)
    assert r["ci_low"] == pytest.approx(np.quantile(reps, .025), abs=.02) and r["ci_high"] == pytest.approx(np.quantile(reps, .975), abs=.02)


# ------------------------------------------------------------------ curves
def test_curve_gram_rank_and_reconstruction(spark):
    rng = np.random.default_rng(6)
    basis = rng.normal(size=(3, 12))
    rows = [(i, 10 ** 15 + i, (rng.normal(size=3) @ basis).tolist(), f"2001-{1 + i % 9:02d}") for i in range(900)]
    d = frame(spark, rows, "order_id long, t0 long, curve array<double>, month string")
    g = functional.moments(functional.gram_rows(d, 0, windows=(12,)), 12)
    m = np.vstack([r[2] for r in rows if r[3] == "2001-01"])
    assert np.allclose(g["2001-01"].g, m.T @ m) and g["2001-01"].n == 100
    basis_rows = functional.basis_rows(g, "c", 12)
    assert all(r[10] == 3 for r in basis_rows) and {r[5] for r in basis_rows} == {"FEW_TRAINING_ROWS"}
    late = functional.moments(functional.gram_rows(d, 10 ** 15 + 450 - 12 * DAY, windows=(12,)), 12)
    assert sum(x.n for x in late.values()) == 450
    bcv = pd.DataFrame(functional.bcv_rows(g, "c"), columns=["c", "held", "m", "k", "sse", "e", "err"])
    assert bcv[bcv.k == 3]["err"].max() < 1e-5 and bcv[bcv.k == 1]["err"].min() > 1e-3
    assert bcv.groupby("held")["k"].max().to_dict() == {3: 9, 6: 6}


def test_rank_errors_equal_pseudo_inverse():
    rng = np.random.default_rng(8)
    x = {f"2001-{i:02d}": rng.normal(size=(60, 12)) @ rng.normal(size=(12, 12)) for i in range(1, 9)}
    g = {m: functional.Moments(len(v), v.sum(0), v.T @ v) for m, v in x.items()}
    got = {(r[1], r[2], r[3]): r[6] for r in functional.bcv_rows(g, "c")}
    train = np.vstack([x[f"2001-{i:02d}"] for i in range(1, 7)])
    mu, test = train.mean(0), x["2001-07"]
    for width in (3, 6):
        for k in (1, 2, 5):
            sse = total = 0.0
            for start in range(0, 12, width):
                held = np.arange(start, start + width)
                rest = np.setdiff1d(np.arange(12), held)
                u, s, vt = np.linalg.svd((train - mu)[:, rest], full_matrices=False)
                guess = (test - mu)[:, rest] @ (vt[:k].T / s[:k]) @ u[:, :k].T @ (train - mu)[:, held]
                sse += np.sum(((test - mu)[:, held] - guess) ** 2)
                total += np.sum((test - mu)[:, held] ** 2)
            assert got[width, "2001-07", k] == pytest.approx(np.sqrt(sse / total), rel=1e-8)


def test_component_grid_equals_direct_fit(spark):
    """Three folds of core values and two curves against plain Newton steps on explicit scores."""
    rng = np.random.default_rng(9)
    n, lags = 600, 5
    core, a, b = rng.normal(size=(n, 2)), rng.normal(size=(n, lags)) @ rng.normal(size=(lags, lags)), rng.normal(size=(n, lags))
    month = rng.integers(1, 7, n)
    y = (rng.random(n) < 1 / (1 + np.exp(1 - core[:, 0] - a[:, 0] / 3))).astype(float)
    values = np.column_stack([np.ones(n), core, a, b])
    rows = [(i, f"m{month[i]}", f"m{month[i]}", float(y[i]), values[i].tolist()) for i in range(n)]
    d = frame(spark, rows, "order_id long, month string, usable string, y double, values array<double>")
    coefs, converged, _scales = component_grid.fit_grid(d, ["m1", "m4", "m6"], 2, lags, [0, 2, 5])
    assert set(coefs) == {"m4", "m6"} and all(converged.values())
    scores = {(r["order_id"], r["k"]): r["score"] for r in component_grid.score_grid(d, coefs, [0, 2, 5]).collect()}
    assert len(scores) == 3 * int(np.isin(month, [4, 6]).sum())
    for fold in (4, 6):
        tr, te = month < fold, month == fold
        for k in (0, 2, 5):
            z = [(core - core[tr].mean(0)) / core[tr].std(0)]
            for c in (a, b):
                w, v = functional.spectrum(np.cov(c[tr].T, bias=True))
                z.append((c - c[tr].mean(0)) @ v[:, :k] / np.sqrt(w[:k]))
            z = np.column_stack([np.ones(n), *z])
            pen, th = np.eye(z.shape[1]), np.zeros(z.shape[1])
            pen[0, 0] = 0
            for _ in range(30):
                p = 1 / (1 + np.exp(-z[tr] @ th))
                th = th + np.linalg.solve(z[tr].T @ (z[tr] * (p * (1 - p))[:, None]) + pen, z[tr].T @ (y[tr] - p) - pen @ th)
            for i in np.flatnonzero(te)[:20]:
                assert scores[int(i), k] == pytest.approx(1 / (1 + np.exp(-z[i] @ th)), abs=1e-5)


def test_smoother_trace_and_linear_curves():
    h, _ = functional.smoother(30, 8)
    assert np.trace(h) == pytest.approx(8, abs=1e-6)
    assert np.allclose(h @ np.arange(30.0), np.arange(30.0))


def test_robust_z_skips_zero_mad_months(spark):
    d = frame(spark, [("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 4.0)], "year_month string, freight_log_ratio double")
    got = fr.robust_month_z(d).toPandas()
    assert got[got.year_month == "a"]["freight_log_ratio_month_z"].isna().all()
    assert sorted(got[got.year_month == "b"]["freight_log_ratio_month_z"].round(6)) == [round(-1 / 1.4826, 6), 0.0, round(2 / 1.4826, 6)]


def test_rank_buckets_follow_the_values(spark):
    """One far value, or nearly all values in a thousandth of the range, leaves no large bucket; odd numbers keep their order."""
    far = [(100 + i / 100_000,) for i in range(40_000)] + [(1e9,)]
    dense = [(i / 40_000,) for i in range(40_000)] + [(1000.0 * i,) for i in range(1, 400)]
    for rows in (far, dense):
        d = ranks.distinct_counts(spark.createDataFrame(rows, "v double"), [], "v")
        b, _ = ranks._bucketed(d, [], "v", ["_n"])
        assert b.groupBy("_b").count().agg({"count": "max"}).first()[0] < 0.03 * len(rows)
        got = {r["v"]: r["rank"] for r in ranks.average_rank(spark.createDataFrame(rows, "v double"), [], "v").collect()}
        assert [got[v] for (v,) in sorted(rows)] == list(range(1, len(rows) + 1))
    odd = [float("-inf"), -1e300, -1.0, -0.5, 0.0, 1e-300, 2.0, 1e300, float("inf"), float("nan")]
    got = ranks.average_rank(spark.createDataFrame([(x,) for x in odd], "v double"), [], "v").orderBy("rank").collect()
    assert [repr(r["v"]) for r in got] == [repr(x) for x in odd]
