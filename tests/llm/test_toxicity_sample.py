"""The bounded sample of labelled texts keeps both classes wherever a long text falls."""

from parcelscope.llm import toxicity


def test_long_text_first_leaves_both_classes():
    rows = [{"text": "x" * 5000, "y": 0}] + [{"text": f"text {i}", "y": i % 2} for i in range(40)]
    got = toxicity.bounded(rows, 1000)
    assert got == rows[1:]
    only = toxicity.bounded([{"text": "a" * 900, "y": 1}, {"text": "b" * 800, "y": 1}, {"text": "c" * 900, "y": 0}], 10)
    assert [r["text"][0] for r in only] == ["b", "c"]


def test_byte_bound_is_shared_by_class():
    # toxic rows late in the order
    rows = [{"text": "c" * 100, "y": 0} for _ in range(300)] + [{"text": "t" * 100, "y": 1} for _ in range(100)]
    got = toxicity.bounded(rows, 4000)
    assert sum(r["y"] for r in got) == 10 and len(got) == 40
    assert toxicity.bounded(rows) == rows
