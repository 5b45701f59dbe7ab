"""Bootstrapped contexts over repeated documents and lists of identifiers."""

from parcelscope.llm import pii

SEEDS = [(i, f"please call {w} anytime: reach me at +1 (415) 555-0{i:03d} today") for i, w in enumerate("ada bob cyd dan eve fay".split())]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_copies_of_a_seed_do_not_count_against_its_pattern(spark):
    unseen = (90, "hello again, reach me at 415-555-0199 tomorrow")
    copies = [(200 + k, SEEDS[0][1]) for k in range(40)]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, SEEDS + [unseen] + copies)).collect()}
    at = unseen[1].index("415")
    assert spans[90] == f"phone:{at}:{at + 12}"


def test_copies_of_an_unknown_token_count_against_the_pattern(spark):
    unseen = [(90 + k, "hello again, reach me at 415-555-0199 tomorrow") for k in range(9)]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, SEEDS + unseen)).collect()}
    assert all(not spans[i] for i, _ in unseen)
