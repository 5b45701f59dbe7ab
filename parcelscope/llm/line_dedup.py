r"""Lines that stand in several documents, dropped everywhere but in the largest document, by sorted ranges of line hashes.

A line's key is the line without white space of ASCII at both ends, A-Z in lower case; a 128-bit hash stands for it. Each document gives one entry per
different key of at least ``shortest`` characters. Entries are dealt by ranges of the hash, sorted within a range by document (descending) and position, and
streamed: the first entry of a run is the one that stays, the ``least``-th proves that the key is common. A key of very many documents is
cut into runs by a salt, the square root of the number of documents in all, so no task holds more than a run; of each run
the first ``least`` entries go to a second sorted stream that decides the key. Decisions go back to the runs, never to texts: each document
gets a compressed bitmap of its dropped lines (words of 64 lines, words without a dropped line left out), and only
``apply`` meets the text again. Nothing here but DataFrame functions.

Null and empty texts are one empty line. Rows of the same ``doc_id`` are one document where documents are counted and each keeps its own row of
the result; null ids are one document below all others. A key of a document's repeated lines counts once; in the document that keeps it all its lines stay.
Keys are compared by their hash. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, whole_text

# ASCII white space, letters.
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _lines(text: str = "text") -> Column:
    return F.split(text, "\n", -1)


def _rows(docs: DataFrame) -> DataFrame:
    """Rows with the checksum that tells rows of one id apart."""
    return whole_text(docs).withColumn("crc", F.xxhash64("text"))


def entries(docs: DataFrame, *, shortest: int = 20) -> DataFrame:
    """``doc_id, crc, h, g, pos``: every line of ``docs`` with a key of at least ``shortest`` characters."""
    lines = _rows(docs).select("doc_id", "crc", F.posexplode(_lines()).alias("pos", "line"))
    keyed = lines.select("doc_id", "crc", "pos", key(F.col("line")).alias("key")).filter(F.char_length("key") >= shortest)
    return keyed.select("doc_id", "crc", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(13), "key").alias("g"))


def ranked(found: DataFrame, *by: str) -> DataFrame:
    """``found`` with ``i``, the place of its document in its run, by ranges of ``by`` with a secondary sort by document and position."""
    spark = found.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run = Window.partitionBy(*by).orderBy(F.col("doc_id").isNull().asc(), F.col("doc_id").desc())
    # the window takes the ranges as they are: they keep runs whole
    order = [F.col("doc_id").isNull().asc(), F.col("doc_id").desc(), F.col("pos").asc()]
    return found.repartitionByRange(ranges, *by).sortWithinPartitions(*by, *order).withColumn("i", F.dense_rank().over(run))


def decided(streamed: DataFrame, *, least: int) -> DataFrame:
    """``h, g, salt, keep``: the runs of every key that ``least`` documents hold, with the document that keeps it."""
    first = cut(streamed.filter(F.col("i") <= least).groupBy("h", "g", "salt", "doc_id").agg(F.min("pos").alias("pos")), "lines_runs")
    # runs of a key meet in ranges of its hash: at most ``salts`` times ``least`` entries
    met = ranked(first, "h", "g").filter(F.col("i") <= least)
    keeps = met.groupBy("h", "g").agg(F.max("i").alias("n"), F.max(F.when(F.col("i") == 1, F.struct("doc_id"))).alias("keep")).filter(F.col("n") >= least)
    return first.select("h", "g", "salt").distinct().join(keeps.select("h", "g", F.col("keep.doc_id").alias("keep")), ["h", "g"])


def drop_bitmaps(docs: DataFrame, *, shortest: int = 20, least: int = 3) -> DataFrame:
    """``doc_id, crc, n_dropped, words``: rows that lose lines, with ``words`` of (word, bits) in ascending order; bit i of word w is line 64 w + i.

    A line without a set bit is kept, so the bitmap is the complement of the keep bitmap with its full words left out.
    """
    salts = max(1, math.isqrt(docs.count()))
    found = entries(docs, shortest=shortest).withColumn("salt", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(salts)).cast("int"))
    streamed = cut(ranked(found, "h", "g", "salt"), "lines_entries")
    lost = streamed.join(decided(streamed, least=least), ["h", "g", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = lost.groupBy("doc_id", "crc", (F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "crc").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def dense(words: str) -> Column:
    """The bitmap as an array of all its words up to the last."""
    gap = lambda x, i: x["word"] - F.coalesce(F.get(words, i - 1)["word"], F.lit(-1)) - 1
    return F.flatten(F.transform(words, lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(x, i)), F.array(x["bits"]))))


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: every row with the text of its kept lines."""
    rows, hit = _rows(docs), bitmaps.withColumnRenamed("doc_id", "id").withColumnRenamed("crc", "sum")
    met = rows.join(hit, rows["doc_id"].eqNullSafe(hit["id"]) & (rows["crc"] == hit["sum"]), "left").withColumn("all", dense("words"))
    lost = lambda i: F.coalesce(F.call_function("shiftrightunsigned", F.get("all", (i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("long")), F.lit(0).cast("long"))
    kept = F.array_join(F.filter(_lines(), lambda line, i: lost(i) == 0), "\n")
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return met.select("doc_id", n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
                      F.when(F.col("words").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def dedup_lines(docs: DataFrame, *, shortest: int = 20, least: int = 3) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every row."""
    return apply(docs, cut(drop_bitmaps(docs, shortest=shortest, least=least), "lines_bitmaps"))
