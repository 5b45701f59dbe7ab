"""Near copies whose links don't all go through one text, and similarities just around the threshold."""

import random

import pytest

from parcelscope.llm import simhash


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def changed(base, r, places):
    out = list(base)
    for p in places:
        out[p] = f"x{r.randrange(10**9)}"
    return out


def groups(spark, texts, **options):
    return {r["doc_id"]: r["group"] for r in simhash.near_copies(frame(spark, [" ".join(t) for t in texts]), **options).collect()}


@pytest.mark.parametrize(("copies", "rounds"), [(100, 0), (300, 0), (100, 2), (1000, 2), (1000, 6)])
def test_star_of_copies_that_only_the_base_links(spark, monkeypatch, copies, rounds):
    monkeypatch.setattr(simhash, "HUB_ROUNDS", rounds)
    r = random.Random(7)
    base = words(r, 204)  # 200 shingles
    variants = []
    for _ in range(copies):  # 13 shingles changed: one word inside (5), one (5), and the third word (3)
        p = r.randrange(10, 90)
        variants.append(changed(base, r, [p, p + r.randrange(20, 90), 2]))
    texts = [*variants[: copies // 2], base, *variants[copies // 2 :]]  # the base is neither the least nor the greatest id
    got = groups(spark, texts)
    assert len(set(got.values())) == 1


def test_chain_through_a_text_that_a_hub_took(spark):
    r = random.Random(3)
    a = words(r, 204)
    texts = [a]
    for k in range(30):  # each is near the one before and far from those earlier
        texts.append(changed(texts[-1], r, [5 + 6 * k, 8 + 6 * k]))
    order = list(range(len(texts)))
    r.shuffle(order)
    got = groups(spark, [texts[i] for i in order])
    assert len(set(got.values())) == 1


@pytest.mark.parametrize("n", [250, 1000, 3000])
def test_similarity_is_exact_for_long_texts(spark, n):
    r = random.Random(n)
    texts, near = [], []
    for k in range(40):
        base = words(r, n + 4)
        least = next(c for c in range(n) if (n - c) < 0.8 * (n + c))  # so many changed shingles are too many
        count = least - 1 if k % 2 else least  # each last words changed, so the number of changed shingles is exact
        texts += [base, base[: n + 4 - count] + words(r, count)]
        near.append(count < least)
    got = groups(spark, texts)
    assert [got[2 * k] == got[2 * k + 1] for k in range(40)] == near
