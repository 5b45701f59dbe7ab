"""Shingles and views of long lists are joined by shuffles, not sent to every task."""

from parcelscope.llm import simhash


def test_lists_and_long_lists_broadcast_no_shingles(spark, monkeypatch):
    plans, cut = {}, simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), cut(df, name))[1])
    frame = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{frame} {' '.join(f'x{i}_{k}' for k in range(30))}") for i in range(12)] + [(99, frame), (100, frame + " end")], "doc_id long, text string")
    groups = dict(simhash.near_copies(docs).select("doc_id", "group").collect())
    assert groups[99] == groups[100] and len(set(groups.values())) == 13
    met = plans["copies_met"]
    assert "SortMergeJoin [view" in met
    if "copies_apart" in plans:
        assert "SortMergeJoin [view" in plans["copies_apart"]
