"""A fit adds up the smaller of two children only; analysis frame and staged tables at less cost, with the same content."""

import glob

import numpy as np
import pytest

from parcelscope import session
from parcelscope.operators import fold_boosting as fb
from parcelscope.operators import geo
from parcelscope.operators.fold_boosting import BROADCAST_BYTES, Settings, Trees, best_splits


def _plain(codes, y, begin, allowed, s):
    """Every level from the root, with all rows added up."""
    raw, out = np.full(len(y), begin), []
    for _ in range(s.rounds):
        tree, is_open = Trees.empty(1, s.depth), np.ones(1, bool)
        g, h = fb._gradient(s.loss, raw, y)
        for level in range(s.depth):
            node = tree.leaf(0, codes, level) - (2 ** level - 1)
            use = np.flatnonzero((node >= 0) & is_open[np.maximum(node, 0)])
            if not len(use):
                break
            hist = np.zeros((2 ** level, codes.shape[1], s.bins + 1, s.sums))
            fb._histogram(hist, node[use], codes[use], g[use], h[use])
            is_open = np.zeros(2 ** (level + 1), bool)
            for k, j, cut, missing, left, right in best_splits(hist, allowed, s):
                is_open[[2 * k, 2 * k + 1]] = fb._split(tree, 0, level, k, j, cut, missing, left[[0, -1, 1]], right[[0, -1, 1]], s)
        raw += tree.value[0][tree.leaf(0, codes, s.depth)]
        out.append(tree)
    return out


def _data(n, width, loss):
    r = np.random.default_rng(n)
    codes = r.integers(0, 65, (n, width)).astype(np.int8)
    y = np.sin(codes[:, 0] / 9) + codes[:, -1] * 0.02 + r.normal(size=n) * 0.3
    return codes, y if loss == "squared" else (y > y.mean()).astype(float)


@pytest.mark.parametrize("loss", ["squared", "logistic"])
@pytest.mark.parametrize(("n", "width", "least"), [(1, 2, 1), (40, 2, 5), (5000, 4, 20), (9000, 3, 700)])
def test_fit_equals_one_that_adds_all_rows(loss, n, width, least):
    codes, y = _data(n, width, loss)
    for allowed in (np.ones(width, bool), np.arange(width) > 0):
        s = Settings(loss=loss, rounds=5, min_leaf=least, l2=0.5)
        for a, b in zip(fb._fit_one(codes, y, 0.1, allowed, s), _plain(codes, y, 0.1, allowed, s), strict=True):
            assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "cut", "missing_left", "value"))


def test_fit_adds_up_half_the_rows_below_the_root(monkeypatch):
    added, real = [], fb._histogram
    monkeypatch.setattr(fb, "_histogram", lambda acc, node, *rest: (added.append(len(node)), real(acc, node, *rest)))
    codes, y = _data(4000, 3, "squared")
    fb._fit_one(codes, y, 0.0, np.ones(3, bool), Settings(rounds=1))
    assert added[0] == 4000 and len(added) == 5 and max(added[1:]) <= 2000


def test_rows_of_a_tenth_gigabyte_are_broadcast():
    routes_of_six_copies, features = 3_310_000, 5
    assert routes_of_six_copies * (features + 12) <= BROADCAST_BYTES


def test_durations_are_those_of_the_master(spark):
    task = spark.sql("""select * from values (1, timestamp_ntz'2020-01-31 23:00:00', timestamp_ntz'2020-02-05 01:00:00', timestamp_ntz'2020-02-04 00:00:00', 1),
        (2, timestamp_ntz'2020-03-01 00:00:00', timestamp_ntz'2020-03-02 00:00:00', timestamp_ntz'2020-03-09 00:00:00', 0), (2, null, null, null, null)
        as t(order_id, order_purchase_timestamp, order_delivered_customer_date, order_estimated_delivery_date, late)""")
    routes = spark.sql("""select 2 order_id, 1 seller_id, 1.5D distance_km, 2D seller_price, 3D seller_freight, 1 seller_weight_complete, 1 seller_volume_complete,
        1 state_comparison_available, 0 is_interstate, 1D seller_weight_g, 1D seller_volume_cm3""")
    strike = ("2020-01-31 00:00:00", "2020-02-01 00:00:00")
    d = geo.durations(task, strike)
    m = geo.master(task, routes, strike)
    assert "single_seller_order" not in d.columns and m.count() == 3
    assert sorted(map(str, m.select(d.columns).collect())) == sorted(map(str, d.collect()))


def test_staged_tables_are_packed_by_zstd(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda s: str(tmp_path))
    got = session.stage(spark, "zstd-test", "t", lambda: spark.range(10).selectExpr("id", "cast(id as string) s"))
    assert got.count() == 10
    assert glob.glob(f"{tmp_path}/**/*.zstd.parquet", recursive=True)
