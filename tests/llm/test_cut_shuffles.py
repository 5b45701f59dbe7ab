"""Shuffle files of a cut go with its write."""

from pyspark.sql import functions as F

from parcelscope.llm import common
from parcelscope.llm.common import cut


def _held(spark) -> int:
    """Bytes of shuffle data that the session's local folders hold."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_a_cut_leaves_no_shuffle_files(spark):
    before, setting = _held(spark), spark.conf.get(common.CLEANUP)
    out = cut(spark.range(200_000).groupBy(F.xxhash64("id").alias("k")).agg(F.max("id").alias("id")), "shuffled")
    assert out.count() == 200_000
    # a count of its own leaves a few bytes a partition until the driver collects garbage
    assert _held(spark) - before < 100_000
    assert spark.conf.get(common.CLEANUP) == setting
