"""Tables staged by a column, Newton fits of folds, the second route of the median and hash positions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parcelscope import session
from parcelscope.operators import component_grid, evaluation, freight, models, ranks


def test_table_staged_by_a_column_is_not_shuffled_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _spark: str(tmp_path))
    d = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    one = session.stage(spark, str(tmp_path), "one", lambda: d.repartition("k"), "k")
    two = session.stage(spark, str(tmp_path), "two", lambda: one.groupBy("k").agg(F.sum("v").alias("s")), "k")
    j = one.groupBy("k").count().join(two.hint("merge"), "k")
    assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString()
    assert j.count() == 50 and j.agg(F.sum("s")).first()[0] == 999 * 500


def test_month_medians_leave_the_layout_by_order(spark):
    r = spark.createDataFrame([(i, f"2000-{i % 6 + 1:02d}", float(i)) for i in range(60)], "order_id int, year_month string, log_freight double")
    d = freight.expected_median(r.repartition("order_id"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("\n== Initial Plan")[0] and "SortMergeJoin [year_month" not in plan


def test_folds_are_fitted_in_a_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.normal(size=(n, 2)) * [1.0, 30.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] / 30)))).astype(int)
    u = [f"m{i % 8}" for i in range(n)]
    d = spark.createDataFrame(pd.DataFrame({"u": u, "y": y, "a": x[:, 0], "b": x[:, 1]}))
    passes = []
    real = component_grid._curvatures
    monkeypatch.setattr(component_grid, "_curvatures", lambda df, c: passes.append(1) or real(df, c))
    fits = models.fold_logit(d, "u", ["m3", "m6"], ["a", "b"], "y")
    assert 1 < len(passes) < 12 and all(f["converged"] for f in fits.values())
    for fold, f in fits.items():
        keep = np.array(u) < fold
        m, s = x[keep].mean(0), x[keep].std(0)
        z, b = np.column_stack([np.ones(keep.sum()), (x[keep] - m) / s]), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ b))
            b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([0, 1, 1]), z.T @ (p - y[keep]) + b * [0, 1, 1])
        assert np.allclose(f["scaled"], b, atol=1e-7) and f["n"] == keep.sum()


def test_median_by_edges_is_the_expanding_median(spark):
    rows = [(f"m{i % 5}", None if i % 17 == 0 else float((i * 37) % 101 // 3)) for i in range(400)] + [(None, 1.0)]
    d = spark.createDataFrame(rows, "m string, v double")
    got = {r["fold"]: r["median"] for r in ranks.expanding_median_by_edges(d, "m", "v", ["m2", "m3", "m4"], 10).collect()}
    assert got == {f: float(np.median([v for m, v in rows if m and v is not None and m < f])) for f in ("m2", "m3", "m4")}


def test_positions_of_a_group_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "_RANGE_ROWS", 7)
    d = spark.createDataFrame([(i, "a" if i < 90 else "b", float(i)) for i in range(120)], "order_id long, month string, v double")
    got = evaluation.permuted_values(d, "month", ["v"], 2).toPandas()
    h = d.select("order_id", "month", F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat")).select(
        "*", *[F.xxhash64("order_id", F.lit("v"), "repeat", F.lit(s)).alias(s) for s in ("from", "to")]).toPandas()
    for key, g in got.groupby(["month", "repeat"]):
        own = h[(h["month"] == key[0]) & (h["repeat"] == key[1])]
        want = dict(zip(own.sort_values("to")["order_id"], own.sort_values("from")["order_id"].astype(float), strict=True))
        assert dict(zip(g["order_id"], g["new"], strict=True)) == want
