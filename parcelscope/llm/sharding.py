"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in hash partitions of the document id. How many rows of each partition go to each shard is drawn exactly:
shard by shard capacities are fixed (row counts differ by at most one) and each partition draws from what is left
of them, which is the law of a uniform permutation cut into shards. Each partition is permuted (order of a seeded
hash) and its first rows go to the first shard, the next to the second and so on. After the exchange each shard is
permuted again; a row's place there is its slot. Only partition counts and the matrix pass the driver.

Sizes: UTF-8 bytes of the text plus 1, null texts as empty. Repeated rows are rows of their own; rows equal in every
column that counts are interchangeable. An empty table gives no rows. Null ids are one more id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, whole_text

#: The matrix has so many rows at most, whatever the input; partitions grow instead.
MOST_PARTITIONS = 1 << 16


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of partition p for shard s, drawn so that every shard gets its exact size."""
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, rest in enumerate(counts):
        others = sum(left)
        for s in range(shards):  # a multivariate draw as a chain of univariate ones
            others -= left[s]
            k = hypergeometric(rng, left[s], others, rest)
            out[p, s] = k
            left[s] -= k
            rest -= k
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Successes among ``draws`` without replacement; numpy's own draw as far as it goes (10^9 items)."""
    if min(good, draws) == 0 or bad == 0:
        return min(good, draws)
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    ratio = lambda k: (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))  # noqa: E731  P(k + 1) / P(k)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    up = down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    a = b = mode
    u = rng.random() - up
    while u > 0 and (a > low or b < high):  # inversion, outwards from the mode
        if b < high:
            up *= ratio(b)
            b += 1
            u -= up
            if u <= 0:
                return b
        if a > low:
            a -= 1
            down /= ratio(a)
            u -= down
            if u <= 0:
                return a
    return mode


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``, 0 and up among equal rows, so that rows and not ids are permuted: numbers within a split, and what earlier splits hold."""
    same = ["doc_id", "size", "text_crc32"]
    own = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*same, "split").orderBy("size")) - 1)
    held = rows.groupBy(*same, "split").agg(F.count("*").alias("n"))
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy(*same).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)))
    # only keys that several splits hold have anything before
    before = before.filter("before is not null").select(*(F.col(c).alias(f"o_{c}") for c in same), F.col("split").alias("o_split"), "before")
    on = own["doc_id"].eqNullSafe(before["o_doc_id"]) & (own["size"] == before["o_size"]) & (own["text_crc32"] == before["o_text_crc32"]) & (own["split"] == before["o_split"])
    return own.join(before, on, "left").withColumn("copy", F.col("copy") + F.coalesce("before", F.lit(0)))


def shard(docs: DataFrame, shards: int = 16, *, seed: int = 7, partition_rows: int = 4096) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; shard counts differ by at most one."""
    spark = docs.sparkSession
    text = whole_text(docs)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    plain = cut(text.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32("text").alias("text_crc32"), F.spark_partition_id().alias("split")), "shard_plain")
    drawn = [key, F.col("doc_id").isNull(), F.col("text_crc32"), F.col("copy"), F.lit(seed)]
    rows = cut(_numbered(plain).select("doc_id", "size", "text_crc32", F.xxhash64(*drawn, F.lit("first")).alias("first"), F.xxhash64(*drawn, F.lit("again")).alias("again")), "shard_rows")
    total = rows.count()
    parts = max(1, -(-total // max(partition_rows, -(-total // MOST_PARTITIONS))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.col("first"), F.lit("part")), F.lit(parts)))
    counts = [(r["part"], r["count"]) for r in rows.groupBy("part").count().orderBy("part").collect()]
    ends = communication_matrix([n for _, n in counts], shards, seed).cumsum(axis=1)
    matrix = spark.createDataFrame([(p, e.tolist()) for (p, _), e in zip(counts, ends, strict=True)], "part long, ends array<long>")
    local = Window.partitionBy("part").orderBy("first", "doc_id", "text_crc32", "size")
    placed = rows.withColumn("r", F.row_number().over(local) - 1).join(matrix, "part")
    placed = placed.withColumn("shard", F.expr("size(filter(ends, e -> e <= r))").cast("int")).drop("ends", "part", "r", "first")
    placed = cut(placed, "shard_exchange")
    # the second permutation: slices of the second hash, so that no task sorts a whole shard
    bits = max(0, (parts - 1).bit_length())
    placed = placed.withColumn("slice", F.shiftrightunsigned("again", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = placed.groupBy("shard", "slice").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("shard", "slice").orderBy("again", "doc_id", "text_crc32", "size")
    out = placed.withColumn("r", F.row_number().over(inside) - 1).join(before.select("shard", "slice", "before"), ["shard", "slice"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.coalesce("before", F.lit(0)) + F.col("r")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

