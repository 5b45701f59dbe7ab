"""Benchmark items whose item_id is null."""

from parcelscope.llm import decontamination

ITEM = "which of these seven rivers runs through the old town before it meets the northern sea"


def test_items_without_id_are_found(spark):
    docs = spark.createDataFrame([(1, f"page one {ITEM} page two"), (2, "nothing to be found in here at all"), (None, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM), (None, ITEM), (None, "another item that stands in no document of the three"), (5, ITEM)], "item_id long, text string")
    got = decontamination.matches(docs, items).collect()
    assert sorted((repr(r["doc_id"]), repr(r["item_id"])) for r in got) == [("1", "5"), ("1", "None"), ("None", "5"), ("None", "None")]
    assert [r["doc_id"] for r in decontamination.clean(docs, items.filter("item_id is null")).collect()] == [2]
