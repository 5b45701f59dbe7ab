"""Seller history by blocks of time against a range join; routes are laid out by order."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from parcelscope.operators import geo, gold, pit


def _market(spark, orders=400, seed=4):
    rng = np.random.default_rng(seed)
    start = datetime(1969, 6, 1)
    rows = []
    for i in range(orders):
        t = start + timedelta(days=int(rng.integers(0, 700)), seconds=int(rng.integers(0, 3)))
        rows.append((i, "delivered" if i % 5 else "shipped", t, t + timedelta(days=int(rng.integers(0, 95))), t + timedelta(days=30)))
    rows += [(orders + k, "delivered", None, start + timedelta(days=9), start + timedelta(days=9)) for k in range(2)]
    rows.append(rows[7])
    o = spark.createDataFrame(rows, "order_id long, order_status string, order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    pairs = [(r[0], int(s)) for r in rows[:-1] for s in rng.choice([1, 1, 1, 1, 2, 3, 900], 2)] + [(3, None), (None, 1)]
    return o, spark.createDataFrame(pairs, "order_id long, seller_id long")


@pytest.mark.parametrize("rows", [200_000, 5])
def test_history_equals_range_join(spark, monkeypatch, rows):
    monkeypatch.setattr(pit, "BLOCK_ROWS", rows)
    orders, items = _market(spark)
    orders_once = orders.dropDuplicates(["order_id"]).filter("order_purchase_timestamp is not null")
    task = gold.task_orders(orders_once)
    keys = ["order_id", "seller_id", *pit.HISTORY_COUNTS]
    got = pit.seller_history(orders_once, items, task).select(*keys).collect()
    want = pit.history_brute_force(orders_once, items, task, 1).filter("seller_id is not null").select(*keys).collect()
    assert len(got) > 300 and sorted(got) == sorted(want)


def test_history_keeps_untimed_purchases_and_one_row_per_pair(spark):
    orders, items = _market(spark)
    timed = orders.dropDuplicates(["order_id"]).filter("order_purchase_timestamp is not null")

    def by_pair(o):
        return {(r["order_id"], r["seller_id"]): r for r in pit.seller_history(o, items, gold.task_orders(o)).collect()}
    h = pit.seller_history(orders, items, gold.task_orders(orders))
    assert h.count() == h.select("order_id", "seller_id").distinct().count()
    a, b = by_pair(orders.dropDuplicates(["order_id"])), by_pair(timed)
    untimed = {s: n for s, n in items.filter("order_id >= 400").distinct().groupBy("seller_id").count().collect()}
    assert all(r["seller_prior_order_count"] == b[k]["seller_prior_order_count"] + untimed.get(k[1], 0) for k, r in a.items())
    assert all(r["seller_order_volume_30d"] == b[k]["seller_order_volume_30d"] for k, r in a.items())


def test_history_copies_no_pair(spark):
    orders, items = _market(spark, 40)
    plan = pit.seller_history(orders, items, gold.task_orders(orders))._jdf.queryExecution().optimizedPlan().toString()
    assert "array(0, 30, 90)" not in plan and "MapInArrow" in plan


def test_order_seller_is_one_layout_by_order(spark):
    items = spark.createDataFrame([(1, 7, 3, 2.0, 1.0), (1, 7, 3, 2.0, 1.0), (1, 8, 3, 1.0, 0.5), (2, None, 4, 1.0, None)], "order_id long, product_id long, seller_id long, price double, freight_value double")
    products = spark.createDataFrame([(7, 5.0, 1.0, 2.0, 3.0), (8, None, 1.0, 1.0, 1.0)], "product_id long, product_weight_g double, product_length_cm double, product_height_cm double, product_width_cm double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = geo.order_seller(items, products)
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(order_id" in plan and ", seller_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
        got = {(r["order_id"], r["seller_id"]): r for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got[1, 3]["seller_unique_products"] == 2 and got[1, 3]["seller_item_count"] == 3 and got[1, 3]["seller_weight_g"] == 10.0
    assert got[2, 4]["seller_weight_g"] is None and got[2, 4]["seller_freight"] is None
