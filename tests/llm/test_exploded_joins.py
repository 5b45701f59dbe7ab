"""Rows made by an explode are never a broadcast side, however small Spark takes them to be."""

import pytest
from pyspark.sql import functions as F

from parcelscope.llm import simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell", [16, 1])
def test_links_broadcast_no_cells(spark, monkeypatch, cell):
    plans, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, name: (plans.append(plan(df)), cut(df, name))[1])
    monkeypatch.setattr(simhash, "CELL", cell)
    values = [0, 1, 3, 1 << 40, (1 << 40) + 1, 0x5555]
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, fp long")
    prints = prints.withColumn("point", F.udf(lambda v: int(simhash.grid_point(simhash.np.array([v]))[0]), "long")("fp"))
    found = simhash.links(prints)
    plans.append(plan(found))
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
    near = {tuple(sorted(x)) for x in found.collect()}
    within = {(a, b) for a, x in enumerate(values) for b, y in enumerate(values) if a < b and (x ^ y).bit_count() <= 2}
    assert near == within if cell == 16 else near  # stars link by a common word, not by pairs
