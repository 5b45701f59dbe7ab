"""The pipeline's stages on given tables: decisions against brute force, columns, row counts, rereading."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from parcelscope.llm import decontamination, pii, simhash, toxicity
from parcelscope.llm.common import cut, table

SF = "/root/testdata/sf0.01"


def similar_groups(rows, least=0.8):
    """Components of all pairs of texts with the similarity, by inverted lists of five-word shingles."""
    sets, lists, root = {}, defaultdict(list), {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        root[i] = i
        for s in sets[i] or [b""]:
            lists[s].append(i)
    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for ids in lists.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                if find(a) != find(b):
                    common = len(sets[a] & sets[b])
                    if common >= least * (len(sets[a]) + len(sets[b]) - common):
                        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def given(spark):
    return table(spark, SF, "documents")


def test_near_copies_against_all_pairs(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    want = similar_groups(rows)
    got = {r["doc_id"]: r["group"] for r in simhash.near_copies(given).collect()}
    mates = lambda g: {(a, b) for ids in _by(g).values() for n, a in enumerate(ids) for b in ids[:n]}
    w, g = mates(want), mates(got)
    assert len(w) > 50 and len(w & g) >= 0.97 * len(w)
    assert len(g - w) <= 0.03 * len(g)
    kept = {r["doc_id"] for r in simhash.keep_one(given).collect()}
    assert kept == {min(ids) for ids in _by(got).values()}


def _by(groups):
    out = defaultdict(list)
    for i, g in sorted(groups.items()):
        out[g].append(i)
    return out


def test_keep_one_on_odd_rows(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
    rows = [(3, line * 4), (2, line * 4), (2, line * 4), (7, None), (6, ""), (None, "no id here at all"), (None, line * 4), (9, "different " + line.upper()), (11, "x")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n int, key int, id int")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((repr(r["doc_id"]), (r["text"] or "")[:9]) for r in got.collect()) == sorted([("2", "alpha bet"), ("6", ""), ("None", "no id her"), ("9", "different"), ("11", "x")])
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_stages(spark, given):
    docs, names = given, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF), f"test_{name}")
        if name == "packing":
            ids = lambda df: sorted(r[0] for r in df.select("doc_id").distinct().collect())
            assert ids(out) == ids(docs)
            break
        assert out.columns == given.columns and dict(out.dtypes) == dict(given.dtypes)
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if name == "toxicity":
            p = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, table(spark, SF, "labels")).collect()}
            assert set(after) == {i for i, y in p.items() if not y}
        if name == "decontamination":
            assert decontamination.matches(out, table(spark, SF, "benchmark")).count() == 0
        if name == "pii":
            assert set(after) == set(before)
            assert pii.find(out).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
            assert {i for i in after if after[i] != before[i]} == {r["doc_id"] for r in pii.find(docs).filter("spans <> ''").collect()}
        else:
            assert all(before[i] == t for i, t in after.items())
        docs = out


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
