"""Benchmark items inside documents by size-partitioned MinHash, verified by exact shingle containment.

Documents are partitioned by the number of their shingles into classes of powers of two. A document of class K has a one-permutation
MinHash of 16 K bins: a bin's value is the least shingle hash in it. Because the number of bins follows the document's size, a shingle of a short
item that lies in a long document is the least of its bin about as often as in a short one (97 times in 100), so the
chance that all of an item's contained shingles are hidden falls with the item's length alone: below 10^-10 for eight shingles. Items with fewer
than ``SHORT`` shingles, a band, are looked up among all shingles instead, where nothing can be hidden. A document and an item meet where a bin's value is one of the
item's shingles, short items where the share of them reaches the threshold; pairs are then verified on the shingles themselves: the share of the item's
different shingles that the document has must reach the threshold.

Words are runs of letters and digits in lower case; shingles have five words, and an item of fewer words is one shingle of
all its words, looked up at that width. Null and empty texts, of items too, match nothing; repeated documents come back once per row with equal
results, repeated items once per item_id, items without one too; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, fresh, whole_text
from parcelscope.llm.pii import let

WIDTH, CONTAINED, SHORT = 5, 0.8, 8
#: Bins a shingle of the document's size class, as a power of two.
SPARE_BITS = 4
#: Shingles of items up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashes(text: Column, width: int) -> Column:
    """Hashes of all shingles of ``width`` words; none where there are fewer words."""
    def rolled(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        return F.when(F.size(w) >= width, many).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), rolled)


def shingles(text: Column, width: int) -> Column:
    """The different shingles themselves."""
    def joined(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.array_join(F.slice(w, i + 1, F.lit(width)), " "))
        return F.when(F.size(w) >= width, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))

    return let(words(text), joined)


def prepare(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Items with their width (five words or all) and different shingles; those without words are left out."""
    own = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("item", F.xxhash64(F.col("item_id").isNull(), F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")).dropDuplicates(["item"])
    own = own.withColumn("words", F.size(words(F.col("text")))).filter("words > 0")
    own = own.withColumn("width", F.least("words", F.lit(width)))
    by_width = F.coalesce(*(F.when(F.col("width") == n, shingles(F.col("text"), n)) for n in range(1, width + 1)))
    hashed = F.coalesce(*(F.when(F.col("width") == n, F.array_distinct(hashes(F.col("text"), n))) for n in range(1, width + 1)))
    return own.select("item", "item_id", "width", by_width.alias("shingles"), hashed.alias("hashes"))


def matches(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every pair that reaches the threshold."""
    text = _keyed(docs)
    return text.select("doc_id", "key").join(_hits(text, items, width, contained), "key").drop("key")


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.isNull(), F.coalesce(doc_id.cast("string"), F.lit("")), text)


def _keyed(docs: DataFrame) -> DataFrame:
    return whole_text(docs).withColumn("key", _key(F.col("doc_id"), F.col("text")))


def _hits(text: DataFrame, items: DataFrame, width: int, contained: float) -> DataFrame:
    """``key, item_id, n_shingles, n_shared, containment`` of different texts (``key, text``)."""
    items = cut(prepare(items, width), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most ``width`` numbers
    if not widths:
        return text.join(items, F.lit(False)).select("key", "item_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"))
    listed = items.select("item", "width", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    few = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    side = F.broadcast if few else (lambda x: x)
    met = []
    for n in widths:
        # one pass: every shingle hash with a mark where it is the least of its bin
        rows = text.select("key", F.explode(_marked(hashes(F.col("text"), n))).alias("x")).select("key", "x.h", "x.least")
        wanted = listed.filter(F.col("width") == n).select("h", "item", "n")
        met.append(rows.join(side(wanted), "h").filter(F.col("least") | (F.col("n") < SHORT)).select("key", "item", "n"))
    # all shingles of a document come from one task, so its pairs are counted before they are dealt; rows that repeat a text only raise the count
    counted = reduce(DataFrame.unionByName, met).groupBy("key", "item", "n").agg(F.count("*").alias("common"))
    pairs = cut(counted.filter((F.col("n") >= SHORT) | (F.col("common") >= contained * F.col("n") - 1e-9)).select("key", "item"), "contained_pairs")
    # texts of candidates only; a text with many candidates is read once and its shingles are compared with each
    found = text.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", "text")
    checked = pairs.join(found, "key").join(side(items), "item")
    has = F.coalesce(*(F.when(F.col("width") == n, F.array_intersect("shingles", shingles(F.col("text"), n))) for n in widths))
    scored = checked.select("key", "item_id", F.size("shingles").cast("long").alias("n_shingles"), F.size(has).cast("long").alias("n_shared"))
    return scored.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= contained).distinct()


def _marked(h: Column) -> Column:
    """``array<struct<h, least>>`` of the different shingle hashes."""
    def mark(a: Column) -> Column:
        bits = F.ceil(F.log2(F.greatest(F.size(a), F.lit(2)))).cast("int") + SPARE_BITS
        place = lambda x: F.call_function("shiftrightunsigned", x.bitwiseXOR(F.lit(-(1 << 63))), F.lit(64) - bits)
        return F.transform(a, lambda x, i: F.struct(x.alias("h"), ((i == 0) | (place(x) != place(F.get(a, i - 1)))).alias("least")))

    return let(F.sort_array(F.array_distinct(h)), mark)


def clean(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """``docs`` without the rows whose text contains an item; rows of the same or no ``doc_id`` with other texts stay, with all columns."""
    hit = _hits(_keyed(docs), items, width, contained).select("key").distinct()
    name = fresh(docs, "key")
    keyed = docs.withColumn(name, _key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    return keyed.join(hit.withColumnRenamed("key", name), name, "left_anti").select(*docs.columns)
