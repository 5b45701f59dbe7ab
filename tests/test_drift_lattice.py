"""Drift of each period against its past, by blocks, against numpy over all rows."""

import numpy as np
import pytest

from parcelscope.operators import drift_lattice


def brute(rows, m):
    own = np.array([v for p, v, _ in rows if p == m and v is not None])
    past = np.array([v for p, v, _ in rows if p is not None and p < m and v is not None])
    if not len(own) or not len(past):
        return None
    grid = np.unique(np.concatenate([own, past]))
    f, g = (np.searchsorted(np.sort(x), grid, side="right") / len(x) for x in (own, past))
    edges = np.unique(np.round(np.quantile(past, np.arange(11) / 10), 8))
    spot = lambda x: np.clip(np.searchsorted(edges, x, side="left") - 1, 0, max(len(edges) - 2, 0))
    k = max(len(edges) - 1, 1)
    p, q = (np.bincount(spot(x), minlength=k) / len(x) for x in (own, past))
    keep = (p + q) > 0
    p, q = np.maximum(p[keep], 1e-6), np.maximum(q[keep], 1e-6)
    mid = (p + q) / 2
    iqr = np.quantile(past, .75) - np.quantile(past, .25)
    area = float(np.sum(np.abs(f - g)[:-1] * np.diff(grid)))
    y = [t for a, _, t in rows if a == m]
    z = [t for a, _, t in rows if a is not None and a < m]
    return {"n_current": len(own), "n_earlier": len(past), "ks": np.abs(f - g).max(), "psi": float(np.sum((p - q) * np.log(p / q))),
            "js_distance": float(np.sqrt(max(np.sum(p * np.log2(p / mid) + q * np.log2(q / mid)) / 2, 0))), "wasserstein": area, "wasserstein_iqr": area / iqr if iqr else None,
            "median_shift": (np.median(own) - np.median(past)) / iqr if iqr else None, "target_delta_pp": 100 * (np.mean(y) - np.mean(z))}


@pytest.mark.parametrize("values", [7, 1000])
def test_every_period_against_its_past(spark, monkeypatch, values):
    monkeypatch.setattr(drift_lattice, "VALUES", values)
    rng = np.random.default_rng(values)
    rows = []
    for i in range(3000):
        m = f"2020-{1 + int(rng.integers(0, 9)):02d}"
        v = None if rng.random() < .05 else float(np.round(rng.normal(int(m[-2:]) / 5, 1), 2)) if rng.random() < .9 else 1e6 * float(rng.random())
        rows.append((None if rng.random() < .02 else m, v, int(rng.random() < .3)))
    rows += [("2021-01", 5.0, 1), ("2021-02", None, 0)]
    d = spark.createDataFrame(rows, "period string, a double, y int").selectExpr("*", "3.0D as b")
    got = {(r["variable"], r["period"]): r.asDict() for r in drift_lattice.period_drift(d, "period", ["a", "b"], "y", least_earlier=500, least_own=100).collect()}
    months = sorted({p for p, _, _ in rows if p})
    for name, data in (("a", rows), ("b", [(p, 3.0, y) for p, _, y in rows])):
        for m in months:
            want = brute(data, m)
            assert (want is None) == ((name, m) not in got)
            if want:
                have = got[name, m]
                assert have["supported"] == (want["n_earlier"] >= 500 and want["n_current"] >= 100)
                for k, v in want.items():
                    assert (have[k] is None) if v is None else have[k] == pytest.approx(v, abs=2e-5, rel=1e-9), (name, m, k)
    assert drift_lattice.period_drift(d.filter("y > 5"), "period", ["a"], "y").count() == 0
