"""Tables replaced by a pointer, and streamed digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from parcelscope.sources import bronze, snapshots


def _values(df):
    return sorted(r["k"] for r in df.collect())


def _folders(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir())


def test_replace_keeps_one_earlier_version(spark, tmp_path):
    at = str(tmp_path / "t")
    with pytest.raises(snapshots.NoTable):
        snapshots.read_table(spark, at)
    names = [snapshots.replace_table(spark.range(n).select(F.col("id").alias("k")), at) for n in (1, 2, 3)]
    assert _values(snapshots.read_table(spark, at)) == [0, 1, 2]
    assert _values(snapshots.read_table(spark, at, back=1)) == [0, 1]
    assert snapshots.versions(spark, at) == [names[2], names[1]]
    assert _folders(tmp_path / "t") == sorted(names[1:])
    with pytest.raises(snapshots.NoTable):
        snapshots.read_table(spark, at, back=2)


def test_a_write_that_dies_half_way_leaves_the_old_rows(spark, tmp_path):
    at = str(tmp_path / "t")
    old = snapshots.replace_table(spark.range(10).select(F.col("id").alias("k")), at)
    # some partitions are written before the last one fails
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("stopped"))).otherwise(F.col("id")).cast("long").alias("k"))
    with pytest.raises(Exception, match="stopped"):
        snapshots.replace_table(bad, at)
    assert _values(snapshots.read_table(spark, at)) == list(range(10))
    assert _folders(tmp_path / "t") == [old]


def test_a_stop_before_the_swap_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    snapshots.replace_table(spark.range(2).select(F.col("id").alias("k")), at)

    def stopped(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_point", stopped)
        with pytest.raises(KeyboardInterrupt):
            snapshots.replace_table(spark.range(5).select(F.col("id").alias("k")), at)
    # the whole new version lies in the folder as after a lost driver, but nothing names it
    assert len(_folders(tmp_path / "t")) == 2 and _values(snapshots.read_table(spark, at)) == [0, 1]
    snapshots.replace_table(spark.range(3).select(F.col("id").alias("k")), at)
    assert _values(snapshots.read_table(spark, at)) == [0, 1, 2]


def test_a_table_may_be_replaced_from_itself_and_an_open_plan_ends(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.replace_table(spark.range(3).select(F.col("id").alias("k"), (F.col("id") % 2).alias("p")), at, partition_by=["p"])
    before = snapshots.read_table(spark, at)
    snapshots.replace_table(before.filter("k > 0"), at, partition_by=["p"])
    assert _values(before) == [0, 1, 2] and _values(snapshots.read_table(spark, at)) == [1, 2]
    empty = spark.range(0).select(F.col("id").alias("k"))
    snapshots.replace_table(empty, at, keep=0)
    assert _values(snapshots.read_table(spark, at)) == [] and len(_folders(tmp_path / "t")) == 1


def test_csv_versions_have_headers(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.replace_table(spark.sql("select 1 k, cast(null as string) v union all select 2, 'a,b'"), at, "csv")
    assert {(r["k"], r["v"]) for r in snapshots.read_table(spark, at, "csv").collect()} == {("1", None), ("2", "a,b")}


@pytest.mark.parametrize("digests", [lambda *a: snapshots.file_digests(*a, block=1000), snapshots.whole_digests])
def test_digests_equal_hashlib_across_blocks(spark, tmp_path, digests):
    files = {"a.bin": b"", "b b.bin": b"x" * 10_001, "c%20.bin": bytes(range(256)) * 40, "d.txt": b"left out"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["file_name"]: (r["bytes"], r["sha256"]) for r in digests(spark, str(tmp_path), "*.bin").collect()}
    assert got == {n: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in files.items() if n.endswith(".bin")}


def test_an_empty_file_is_present(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    (tmp_path / "x.csv").write_bytes(b"1")
    (tmp_path / "_note.csv").write_bytes(b"1")
    (tmp_path / "folder.csv").mkdir()
    got = {(r["file_name"], r["state"]) for r in bronze.file_contract(spark, str(tmp_path), ["a.csv", "b.csv"], "*.csv").collect()}
    assert got == {("a.csv", "PRESENT"), ("b.csv", "MISSING"), ("x.csv", "EXTRA")}
    (tmp_path / "none").mkdir()
    assert snapshots.file_digests(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        snapshots.listed_files(spark, str(tmp_path / "absent"))
