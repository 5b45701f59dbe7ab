"""Rows without or with repeated ids, clashing column names, long texts, and work that must not meet in one task."""

import hashlib
import random
import shutil
import sys

import pytest
from pyspark.sql import functions as F

from parcelscope.llm import common, decontamination, pii, sharding, simhash, sketches, toxicity, warc

ITEM = "seven quick wizards jump over the lazy brown fox near the old stone bridge at dawn today"


def test_decontamination_drops_rows_not_ids(spark):
    rows = [(None, f"before {ITEM} after"), (None, "clean text without an id"), (5, ITEM), (5, "clean text of five"), (1, "clean one"), (5, "clean text of five")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontamination.clean(docs, items)
    assert got.columns == docs.columns
    assert sorted(r["text"] for r in got.collect()) == sorted(t for _, t in rows if ITEM not in t)


def test_recall_of_items_of_eight_shingles(spark):
    """A short item stands in long documents; items from a band upwards go through the bins."""
    rng = random.Random(8)
    items = [(k, " ".join(f"i{k}x{rng.randrange(10**6)}" for _ in range(12))) for k in range(60)]
    rows = []
    for d in range(20):
        body = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
        for k in rng.sample(range(60), 10):
            at = rng.randrange(4000)
            body[at:at] = items[k][1].split()
        rows.append((d, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, k) for d, t in rows for k, x in items if x in t}
    assert len(want) > 150 and got == want  # an item that another one cut in two is in neither


def test_archives_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, f"u{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(600)], "page_id long, url string, html string").repartition(6)
    folder = common.scratch(spark, "test_warc")
    manifest = warc.write_archives(pages, folder, roll=20_000)
    assert manifest.count() >= 6
    read = warc.read_archives(spark, manifest, folder).withColumn("task", F.spark_partition_id())
    each = [r["count"] for r in read.groupBy("task").count().collect()]
    assert sum(each) == 600 and len(each) >= 4 and max(each) <= 300


def test_masking_and_dedup_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail me at a@b.example.com", 7, 8, 9, 10)], "doc_id long, text string, text_key int, text_spans int, __key int, text_crc int")
    got = pii.mask(docs).collect()[0]
    assert tuple(got)[2:] == (7, 8, 9, 10) and got["text"] == "mail me at <email>"
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [tuple(r) for r in docs.collect()]


def test_sample_is_bounded_before_it_is_loaded(spark, monkeypatch):
    """Repeated ids give one text, and texts over the bound never meet in the fitting task."""
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40_000)
    monkeypatch.setattr(toxicity, "bounded", lambda rows, f=toxicity.bounded: seen.append(rows) or f(rows))
    docs = spark.createDataFrame([(1, f"copy number {i} " * 30) for i in range(500)] + [(2, "x" * 3_000_000), (3, "you awful fool"), (6, None), (4, "a nice day"), (7, "fine words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i in (1, 3) else 0) for i in range(1, 8)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels)
    assert got.count() == docs.count()
    assert len(seen[0]) <= 7 and all("text" not in r for r in seen[0])


def test_rows_of_one_id_are_spread(spark):
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = sharding.shard(docs, partition_rows=1000)
    assert [r["count"] for r in got.groupBy("shard").count().collect()] == [2500] * 16
    assert got.groupBy("shard").agg(F.min("slot"), F.max("slot"), F.count_distinct("slot")).filter("`min(slot)` <> 0 or `max(slot)` <> 2499 or `count(DISTINCT slot)` <> 2500").count() == 0


def test_neighbours_across_ranges(spark):
    rows = [(i, f"text {i} " * 5) for i in range(300)]
    got = sketches.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], per_bucket=16)
    assert {r["doc_id"]: r["next_text"] for r in got.collect()} == {i: rows[(i + 1) % 300][1] for i in range(300)}


def test_near_copies_of_very_long_and_repeated_texts(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**8)}" for _ in range(150_000)]
    near = base[:140_000] + [f"v{i}" for i in range(10_000)]
    far = base[:100_000] + [f"u{i}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (None, " ".join(base)), (4, None), (4, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["crc"]): r["group"] for r in simhash.near_copies(docs).collect()}
    assert sorted(repr(r["doc_id"]) for r in simhash.keep_one(docs).collect()) == ["1", "3", "4"]
    assert len(set(got.values())) == 3


def test_stored_tables_are_deleted(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(common, "scratch", lambda s, name: f"file://{tmp_path}/{name}-{len(kept)}{kept.append(name) or ''}")
    docs = spark.createDataFrame([(i, f"{ITEM} {i // 2} and more words here for number {i // 2}") for i in range(40)], "doc_id long, text string")
    simhash.near_copies(docs).count()
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert len(kept) > 10 and "copies_groups" in left and not {"copies_rows", "copies_sets", "copies_lists", "copies_links"} & set(left)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.scratch(Cluster, "x")


def test_entry_without_the_sources_of_the_subpackage(tmp_path, monkeypatch):
    """Only a cache folder of the subpackage is left: the other queries are there."""
    import __spark_entry__ as here
    from pathlib import Path

    root = Path(here.__file__).parent
    shutil.copytree(root / "parcelscope", tmp_path / "parcelscope", ignore=shutil.ignore_patterns("llm"))
    (tmp_path / "parcelscope/llm/__pycache__").mkdir(parents=True)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    import subprocess

    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, len(e.oracle_sql()) > 100)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path), "HOME": "/root"}, capture_output=True, text=True)
    n, ops, pipeline, oracles = out.stdout.split()
    assert int(n) > 200 and (ops, pipeline, oracles) == ("0", "False", "True")
