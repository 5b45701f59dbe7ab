r"""Fill-in-the-middle documents by one counted regular expression per row.

A unit is a line with its break (``[^\n]*\n|[^\n]+``). ``regexp_count`` gives a text's number of units ``n``; the cuts ``a <= b`` in 0..n follow
from the row's seed alone. The row's own pattern has the possessive groups ``unit{a}`` and ``unit{b-a}`` and the rest, so one match captures
prefix, middle and suffix, and the replacement writes them in the order of the form. Possessive counts are matched in a loop
without a stack or backtracking, so a text of any number of lines takes linear time and bounded memory. Everything is one
projection without a shuffle.

Null texts are empty; empty texts and texts that contain a sentinel are plain, as are rows that the rate leaves out. A text without a line break is one
unit, a break alone is one too. A null ``doc_id`` is seeded as an empty string; repeated rows come back repeated and equal;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import whole_text

# The sentinels and the unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"(?:[^\n]*+\n|[^\n]++)"
#: Pieces of an output stand between sentinels, which no text of a transformed row contains.
_SENTINEL = "<[PSM]>"


def seeds(doc_id: Column, salt: str) -> list[Column]:
    """Four numbers below 2^32 from the hex SHA-256 of ``salt:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, salt: str = "7", rate: int = 100, spm: int = 50) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: ``rate`` per cent of the rows are transformed, ``spm`` per cent of those suffix first."""
    row = whole_text(docs).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    h1, h2, h3, h4 = seeds(F.col("doc_id"), salt)
    holds = [F.contains("text", F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | holds[0] | holds[1] | holds[2] | (h3 % 100 >= rate)
    row = row.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"))
    row = row.withColumn("x", h1 % (F.col("n") + 1)).withColumn("y", h2 % (F.col("n") + 1))
    a, b = F.least("x", "y"), F.greatest("x", "y")
    pattern = F.concat(F.lit(rf"(?s)\A({UNIT}{{"), a.cast("string"), F.lit(rf"}}+)({UNIT}{{"), (b - a).cast("string"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    row = row.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))
    chars = lambda psm, spm: F.when(F.col("form") != "plain", F.char_length(_piece(psm, spm)).cast("long"))
    return row.select("doc_id", "n", "form", chars(1, 2).alias("prefix_chars"), chars(3, 3).alias("middle_chars"), "output")


def _piece(psm: int, spm: int) -> Column:
    parts = F.split("output", _SENTINEL)
    return F.when(F.col("form") == "spm", F.get(parts, F.lit(spm))).otherwise(F.get(parts, F.lit(psm)))


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``, the exact text rebuilt from ``output`` and ``form`` alone."""
    back = F.concat(_piece(1, 2), _piece(3, 3), _piece(2, 1))
    return rows.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(back))


def digests(rows: DataFrame) -> DataFrame:
    """The rows of ``transform`` with the digests of output and rebuilt text in place of the texts."""
    return restore(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
