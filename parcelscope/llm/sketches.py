"""Document fingerprints as threshold-scaled sketches (FracMinHash).

A text's words (lower case, letters and digits) give hashes of five-word shingles (fewer words: one shingle of all). A sketch keeps
every different hash below a fixed fraction of the range. Sketches of parts merge by union, and because all texts share the threshold, the
share of one sketch that lies in another estimates containment however unequal the texts are.

Likeness of two sketches is the larger containment: common hashes over the smaller sketch's size. Equal sketches have likeness
1; if one is empty and the texts differ it is 0; equal texts always have 1. Null and empty texts have the empty sketch.
Repeated rows are rows of their own; the next document is the next row by (doc_id, text); null ids come first. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, whole_text
from parcelscope.llm.pii import let

WIDTH = 5
#: Hashes whose top bits are zero are kept: one in 2 ** SCALE_BITS.
SCALE_BITS = 2


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of all word shingles, repeats included."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(F.transform(w, lambda x: x.cast("string")), " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, shingles)


def sketch(text: Column, width: int = WIDTH, scale_bits: int = SCALE_BITS) -> Column:
    """Sorted different hashes below the threshold; their upper half, which then fits an int, names them."""
    low = F.filter(shingle_hashes(text, width), lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)
    return F.array_sort(F.array_distinct(F.transform(low, lambda h: F.shiftrightunsigned(h, 32).cast("int"))))


def text_of(sketch_: Column) -> Column:
    """A sketch as a string: eight hex digits per hash."""
    return F.array_join(F.transform(sketch_, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column, equal: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(equal, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least).cast("double")


def with_next(rows: DataFrame, columns: list[str], per_bucket: int = 2048, most: int = 4096) -> DataFrame:
    """``rows`` with ``columns`` of the next row by (doc_id, text) as ``next_*``, the last row's next being the first one.

    Rows are dealt by ranges of ids whose bounds are quantiles, so that each task orders a few thousand rows; what follows a
    range's last row is the first row of the next range that has any.
    """
    n = rows.count()
    parts = min(most, max(1, -(-n // per_bucket)))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    bounds = sorted(set(bounds)) if parts > 1 else []
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    if groups:  # two levels of comparisons instead of all bounds
        heads, table = F.array(*(F.lit(g[0]) for g in groups)), F.array(*(F.array(*map(F.lit, g)) for g in groups))
        passed = lambda a: F.size(F.filter(a, lambda b: b <= F.col("doc_id")))
        bucket = let(passed(heads), lambda g: F.when(g == 0, 0).otherwise((g - 1) * wide + passed(F.get(table, g - 1))))
    else:
        bucket = F.lit(0)
    dealt = rows.withColumn("bucket", F.coalesce(bucket, F.lit(0)))
    inside = Window.partitionBy("bucket").orderBy("doc_id", "text")
    here = dealt.withColumns({f"next_{c}": F.lead(c).over(inside) for c in columns}).withColumn("inner", F.lead("bucket").over(inside).isNotNull())
    first = cut(dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text", *(c for c in columns if c != "text"))).alias("head")), "sketch_heads")
    # only the ranges' numbers go through this window, at most ``most``; their heads with the texts come by a join
    along = Window.orderBy("bucket")
    follows = F.coalesce(F.lead("bucket").over(along), F.first("bucket").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    after = first.select("bucket", follows.alias("follows")).join(first.select(F.col("bucket").alias("follows"), F.col("head").alias("after")), "follows")
    joined = here.join(after.drop("follows"), "bucket")
    return joined.select(*rows.columns, *(F.when(F.col("inner"), F.col(f"next_{c}")).otherwise(F.col(f"after.{c}")).alias(f"next_{c}") for c in columns))


def edited(text: Column, following: Column) -> Column:
    """The last half of a text replaced by as much of the following one's start."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Sketches of every text and of its edited text, and how alike neighbours are."""
    rows = with_next(whole_text(docs).withColumn("own", sketch(F.col("text"))), ["text", "own"])
    rows = rows.withColumn("changed", edited(F.col("text"), F.col("next_text")))
    made = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), (F.col("text") == F.col("changed")).alias("same"),
        (F.col("text") == F.col("next_text")).alias("same_next"), "own", sketch(F.col("changed")).alias("other"), "next_own",
    )
    return made.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), F.col("same")).alias("near_edited"), likeness(F.col("own"), F.col("next_own"), F.col("same_next")).alias("near_next"),
    )
