"""A passage that very many documents have between different surroundings: no group holds its equal windows."""

import numpy as np

from parcelscope.llm import repeats

PASSAGE = "the quick brown foxes jump over the lazy dogs while seventeen grey wizards quietly box with daft zebras and one very old yak "


def texts(n):
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefgh"), 12))
    return [(None if i == 7 else i, " ".join(word() for _ in range(6)) + PASSAGE + " ".join(word() for _ in range(6))) for i in range(n)]


def test_no_task_gets_all_equal_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    rows = texts(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    largest = spark.sparkContext.accumulator(0)
    plain = repeats.later_windows

    def counted(strings, *rest):
        largest.add(len(strings))
        return plain(strings, *rest)

    monkeypatch.setattr(repeats, "later_windows", counted)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect()}
    assert largest.value < 300  # the windows of the passage are in no merge
    # the passage and what happens to be equal around it goes, but not from the first document
    assert got[0] == 0 and all(len(PASSAGE) <= n < len(PASSAGE) + 12 for i, n in got.items() if i != 0)
