"""Curves swept by time of day: equal to sums over all events, without a row per edge."""

import numpy as np
import pandas as pd
import pytest

from parcelscope.operators import functional, pit

DAY = 86_400_000_000


def _brute(events, t0, lags, channel):
    age = t0 - events["t"]
    return [int(events.loc[(age > b * DAY) & (age <= (b + 1) * DAY), channel].sum()) for b in range(lags)]


@pytest.mark.parametrize("per_sweep", [500_000, 7])
def test_curves_of_odd_targets_equal_sums(spark, monkeypatch, per_sweep):
    monkeypatch.setattr(pit, "SWEEP_TARGETS", per_sweep)
    rng = np.random.default_rng(3)
    # coarse times: many events and targets at the same time of day, some before 1970
    t = rng.integers(-15 * 24, 15 * 24, 400) * (DAY // 24) + rng.choice([0, 1, 150_000_000, 299_999_999], 400)
    ev = pd.DataFrame({"t": t, "n": 1, "w": rng.integers(-9, 50, 400)})
    t0 = np.concatenate([t[:60], t[:20] + 1, [-400 * DAY, 400 * DAY, 15 * DAY + 3 * DAY, -15 * DAY]])
    tg = pd.DataFrame({"order_id": np.arange(len(t0)) // 2, "t0": t0, "kept": [f"x{i}" for i in range(len(t0))]})
    events = spark.createDataFrame(ev).unionByName(spark.createDataFrame([(None, 5, 5)], "t long, n long, w long"))
    got = pit.day_curves(events, spark.createDataFrame(tg).repartition(3), ["n", "w"], 10).collect()
    assert sorted(r["kept"] for r in got) == sorted(tg["kept"])
    for r in got:
        assert list(r["n"]) == _brute(ev, r["t0"], 10, "n") and list(r["w"]) == _brute(ev, r["t0"], 10, "w")
    direct = pit.direct_curves(events, spark.createDataFrame(tg.drop_duplicates("order_id")), ["n", "w"], 1, 10).toPandas()
    first = {r["order_id"]: r for r in got if r["kept"] in set(tg.drop_duplicates("order_id")["kept"])}
    assert sum(sum(v > 0 for v in r["n"]) for r in first.values()) == len(direct)
    assert all((first[r.order_id]["n"][r.lag], first[r.order_id]["w"][r.lag]) == (r.n, r.w) for r in direct.itertuples())


def test_no_row_per_edge_is_shuffled(spark):
    """Neither the sweep nor its long form has an exchange above the curves."""
    ev = spark.range(50).selectExpr("id * 7000000000 as t", "1L as n")
    tg = spark.range(5).selectExpr("id as order_id", "id * 9000000000 + 1 as t0")
    plan = pit.curve_cells(pit.day_curves(ev, tg, ["n"], 90), ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]


def test_gram_rows_are_summed_as_rows(spark):
    """Tasks' matrix rows are added whole: no row per cell of the matrix."""
    rows = [(i, 10 ** 15 + i, [float(i), 1.0, float(i % 3)], "2001-01") for i in range(40)]
    d = spark.createDataFrame(rows, "order_id long, t0 long, curve array<double>, month string").repartition(5)
    g = functional.gram_rows(d, 0, windows=(3,))
    assert "Generate" not in g._jdf.queryExecution().executedPlan().toString()
    x = np.array([[1.0, *r[2]] for r in rows])
    m = functional.moments(g, 3)["2001-01"]
    assert np.allclose(m.g, x[:, 1:].T @ x[:, 1:]) and m.n == 40
