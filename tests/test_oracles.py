"""Every query with a DuckDB text is compared row by row on the smallest data folder."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return round(float(v), 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    ix = [names.index(c) for c in cols]
    want = sorted(repr([norm(r[i]) for i in ix]) for r in cur.fetchall())
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", ["g3_history_bruteforce_audit", "g9_direct_curve_check"])
def test_sampled_audits_find_no_difference(spark, name):
    row = entry.queries()[name](spark, SF).first().asDict()
    assert all(v == 0 for k, v in row.items() if k.endswith("mismatches"))
    assert max(row.values()) > 0


@pytest.mark.parametrize("name", ["a4_source_file_hashes", "a7_dataset_file_contract", "j5_bootstrap_decile_medians", "j6_ols_nested_specs", "j14_beta_posterior",
                                  "j20_rank_audit", "k15_sign_test", "k26_negative_smoothing"])
def test_queries_without_sql_return_rows(spark, name):
    assert entry.queries()[name](spark, SF).head(1)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).head(1)
