"""Ranking of algorithms, differences of arms and the evidence for boosted freight on small tables worked out by hand."""

import numpy as np
import pandas as pd
import pytest

from parcelscope.operators import evaluation as ev
from parcelscope.operators import freight as fr

KIND = "model string, month string, ap double, auc double, brier double, log_loss double"


def metrics(spark):
    r = np.random.default_rng(1)
    rows = []
    for m in range(12):
        month = f"2020-{1 + m:02d}"
        for algorithm, gain in (("A_B", .05), ("C", -.02)):
            base = float(r.random() / 2)
            rows.append((f"{algorithm}_M0", month, base, .6, .2, .5))
            if (algorithm, m) != ("C", 11):
                rows.append((f"{algorithm}_M1", month, base + gain + float(r.normal(0, .01)), .65, .19, .48))
    rows.append(("C_M0", "2021-01", None, None, .1, .3))
    return spark.createDataFrame(rows, KIND)


def test_ranking_knows_missing_folds(spark):
    got = {r["model"]: r for r in ev.rank_algorithms(metrics(spark)).collect()}
    assert {k: (r["folds"], r["complete"]) for k, r in got.items()} == {"A_B_M0": (12, True), "A_B_M1": (12, True), "C_M0": (12, True), "C_M1": (11, False)}
    p = metrics(spark).toPandas().groupby("model")["ap"].mean()
    assert all(got[k]["mean_ap"] == pytest.approx(p[k], abs=1e-6) for k in got)
    assert ev.rank_algorithms(metrics(spark)).collect()[-1]["model"] == "C_M1"


def test_arm_deltas(spark):
    got = {r["algorithm"]: r for r in ev.arm_deltas(metrics(spark), spark, reps=4000).collect()}
    p = metrics(spark).toPandas().dropna()
    p["algorithm"], p["arm"] = p["model"].str[:-3], p["model"].str[-2:]
    w = p.pivot(index=["algorithm", "month"], columns="arm", values="ap")
    d = (w["M1"] - w["M0"]).dropna()
    for a in ("A_B", "C"):
        assert got[a]["folds"] == len(d[a]) and got[a]["mean_delta_ap"] == pytest.approx(d[a].mean(), abs=1e-6)
        r = np.random.default_rng(0)
        means = r.choice(d[a].to_numpy(), (4000, len(d[a]))).mean(1)
        assert got[a]["ci_low"] == pytest.approx(np.quantile(means, .025), abs=2e-3)
        assert got[a]["ci_high"] == pytest.approx(np.quantile(means, .975), abs=2e-3)
        assert (got[a]["wins"], got[a]["losses"]) == ((d[a] > 0).sum(), (d[a] < 0).sum())
    assert got["A_B"]["status"] == "M1_SUPPORTED" and got["C"]["status"] == "M1_NOT_SUPPORTED"
    assert (got["A_B"]["unpaired"], got["C"]["unpaired"]) == (0, 1)
    assert ev.arm_deltas(spark.createDataFrame([], KIND), spark).collect() == []


def test_boosted_freight_and_its_evidence(spark):
    r = np.random.default_rng(5)
    n = 1500
    d = pd.DataFrame({"order_id": np.arange(n), "seller_id": r.integers(0, 9, n), "year_month": [f"2020-{1 + k:02d}" for k in r.integers(0, 6, n)],
                      **{k: r.random(n) * 3 for k in fr.FEATURES}})
    d["log_freight"] = 1 + np.sin(2 * d["log_distance"]) + .3 * d["log_price"] + .05 * r.normal(size=n)
    d["seller_freight"] = np.expm1(d["log_freight"])
    df = spark.createDataFrame(d)
    boosted = fr.expected_boosted(df, rounds=12, depth=3, bins=16)
    got = boosted.select("year_month", "log_freight", "pred_log").toPandas()
    early = got["year_month"] <= "2020-03"
    assert got[early]["pred_log"].isna().all() and got[~early]["pred_log"].notna().all()
    spread = got[~early]["log_freight"].var()
    assert ((got[~early]["log_freight"] - got[~early]["pred_log"]) ** 2).mean() < .3 * spread
    scored = {"F0": fr.expected_median(df), "F1": fr.expected_linear(df), "F2": boosted}
    row = fr.model_evidence(scored).first()
    frames = {k: fr.back_transform(v).select("order_id", "seller_freight", "pred_freight").toPandas().set_index("order_id").sort_index() for k, v in scored.items()}
    ok = np.logical_and.reduce([v["pred_freight"].notna() for v in frames.values()])
    mae = {k: (v["seller_freight"] - v["pred_freight"])[ok].abs().mean() for k, v in frames.items()}
    assert row["n"] == ok.sum() and all(row[f"mae_{k.lower()}"] == pytest.approx(v, abs=1e-5) for k, v in mae.items())
    assert row["gain_over_f0_pct"] == pytest.approx(100 * (1 - mae["F2"] / mae["F0"]), abs=1e-3)
    res = (frames["F2"]["seller_freight"] - frames["F2"]["pred_freight"])[ok].reset_index(drop=True)
    x = d.sort_values("order_id")[np.asarray(ok)].reset_index(drop=True)
    rho = max(abs(np.corrcoef(res.rank(), x[k].rank())[0, 1]) for k in fr.FEATURES)
    assert row["max_residual_rho"] == pytest.approx(rho, abs=1e-5)
