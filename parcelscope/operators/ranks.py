"""Exact ranks, running totals and quantiles without a single-task window.

Rows are first reduced to distinct values with counts (map-side combined). Each group is then cut
into value-ordered buckets by a deterministic, monotone bucket number, so a group holding a third
of the data is still spread over many tasks. Only the per-bucket totals (a bounded number of rows
per group) are windowed by group; the rest is windowed inside one bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.functions.columns import c

_WIDE = 1024
#: Distinct values that a bucket holds on average where a cell is cut again.
_DENSE = 1000
_TOP = 1 << 40


def _finite(v):
    v = c(v).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def value_bucket(v, lo, hi):
    """Monotone cell of a number: equal-width first, then sixteenth-octave of its size; infinities and NaN have cells of their own."""
    v, lo, hi = (c(x).cast("double") for x in (v, lo, hi))
    wide = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * _WIDE), F.lit(_WIDE))).otherwise(F.lit(0))
    size = F.floor(F.log2(F.abs(v)) * 16) + 20000
    fine = F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)
    odd = F.when(F.isnan(v), F.lit(_TOP + 1)).when(v == float("inf"), F.lit(_TOP)).when(v == float("-inf"), F.lit(-_TOP))
    return F.coalesce(odd, (wide * 100000 + fine + 40000).cast("long"))


def with_one_row(df: DataFrame, one: DataFrame, name: str = "_one") -> DataFrame:
    """Attach the columns of a one-row frame as the struct column ``name`` (scalar subquery)."""
    return df.withColumn(name, one.select(F.struct(*[F.col(x) for x in one.columns])).scalar())


def attach(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Join a per-group summary back to the rows; with no keys the summary has one row."""
    if keys:
        return df.join(summary, keys)
    out = with_one_row(df, summary)
    return out.select("*", *[F.col("_one")[x].alias(x) for x in summary.columns]).drop("_one")


def distinct_counts(df: DataFrame, keys: list[str], value: str, **sums) -> DataFrame:
    """One row per (keys, value) with ``_n`` rows and any extra sums."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(k) for k, x in sums.items()]))


def _bucketed(d: DataFrame, keys: list[str], value: str, measures: list[str]):
    span = d.groupBy(*keys).agg(F.min(_finite(value)).alias("_lo"), F.max(_finite(value)).alias("_hi"))
    cells = attach(d, span, keys).withColumn("_cell", value_bucket(value, "_lo", "_hi")).drop("_lo", "_hi")
    # a cell with many values is cut again between its own bounds: one far value or a dense range leaves no large bucket,
    # and the number of buckets follows the number of values
    inner = cells.groupBy(*keys, "_cell").agg(F.min(_finite(value)).alias("_lo"), F.max(_finite(value)).alias("_hi"), F.ceil(F.count(F.lit(1)) / _DENSE).alias("_parts"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((c(value).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_parts")), F.col("_parts") - 1))
    b = cells.join(inner, [*keys, "_cell"]).withColumn("_b", F.struct("_cell", F.coalesce(part, F.lit(0)).cast("long").alias("_part"))).drop("_cell", "_lo", "_hi", "_parts")
    per = b.groupBy(*keys, "_b").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    w = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offs = per.select(*keys, "_b", *[f"_s_{m}" for m in measures],
                      *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
                      *[F.sum(f"_s_{m}").over(whole).alias(f"{m}_total") for m in measures])
    return b, offs


def cumulative(d: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller values in the group) and ``<m>_total``.

    ``d`` must hold one row per (keys, value); see ``distinct_counts``.
    """
    b, offs = _bucketed(d, keys, value, measures)
    j = b.join(offs, [*keys, "_b"])
    w = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = j
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(w), F.lit(0)))
    return out.drop("_b", *[f"_s_{m}" for m in measures], *[f"_o_{m}" for m in measures])


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct (keys, value) with ``_n`` ties, ``_n_total`` rows and the average rank ``rank``."""
    d = cumulative(distinct_counts(df, keys, value), keys, value, ["_n"])
    return d.withColumn("rank", F.col("_n_before") + (F.col("_n") + 1) / 2.0)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, one column per probability.

    A probability may also be a function of the group's row count, given and returned as a column.
    """
    return quantiles_of_counts(distinct_counts(df, keys, value), keys, value, probs)


def quantiles_of_counts(d: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` of data already reduced to one row per (keys, value) with ``_n`` rows."""
    b, offs = _bucketed(d, keys, value, ["_n"])
    total = F.col("_n_total")
    pos = {k: (p(total) if callable(p) else F.lit(float(p))) * (total - 1) for k, p in probs.items()}
    low = {k: F.floor(x) for k, x in pos.items()}
    high = {k: F.least(x + 1, total - 1) for k, x in low.items()}
    ranks = F.array(*low.values(), *high.values())
    start, end = F.col("_o__n"), F.col("_o__n") + F.col("_s__n")
    needed = offs.filter(F.exists(ranks, lambda k: (k >= start) & (k < end)))
    w = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = b.join(needed, [*keys, "_b"]).withColumn("_cum", F.col("_o__n") + F.sum("_n").over(w))
    picks = []
    for k in probs:
        picks += [F.min(F.when(F.col("_cum") > low[k], F.col(value))).alias(f"_l_{k}"),
                  F.min(F.when(F.col("_cum") > high[k], F.col(value))).alias(f"_h_{k}")]
    g = rows.groupBy(*keys).agg(F.first("_n_total").alias("_n_total"), *picks)
    return g.select(*keys, *[
        (F.col(f"_l_{k}") + (pos[k] - low[k]) * (F.col(f"_h_{k}") - F.col(f"_l_{k}"))).cast("double").alias(k)
        for k in probs])


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; the value is a double."""
    return df.unpivot([F.col(k) for k in keys], [F.col(x).cast("double").alias(x) for x in columns], name, value)


def quantile_edges(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Distinct ascending bin edges per group as the array column ``edges``."""
    probs = {f"p{i}": i / bins for i in range(bins + 1)}
    q = exact_quantiles(df, keys, value, probs)
    return q.select(*keys, F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))


def bin_of(value, edges):
    """Right-closed bin number from 0, lowest edge included; NULL stays NULL."""
    v = c(value)
    below = F.size(F.filter(c(edges), lambda e: e < v))
    return F.when(v.isNotNull(), F.greatest(below - 1, F.lit(0)))


def qcut(df: DataFrame, value: str, bins: int, keys: list[str] | None = None, out: str = "bin") -> DataFrame:
    """Add the quantile bin of ``value`` (duplicate edges dropped)."""
    keys = keys or []
    return (attach(df, quantile_edges(df, keys, value, bins), keys)
            .withColumn(out, bin_of(value, "edges")).drop("edges"))


def deviation_counts(d: DataFrame, centre: DataFrame, keys: list[str], value: str, mid: str) -> DataFrame:
    """Counts of |value - centre| from distinct-value counts; the rows themselves are not read again."""
    j = attach(d, centre.select(*keys, mid), keys)
    return j.groupBy(*keys, F.abs(F.col(value) - F.col(mid)).alias("_dev")).agg(F.sum("_n").alias("_n"))


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: median and median absolute deviation (exact)."""
    d = distinct_counts(df, keys, value)
    med = quantiles_of_counts(d, keys, value, {"median": 0.5})
    mad = quantiles_of_counts(deviation_counts(d, med, keys, value, "median"), keys, "_dev", {"mad": 0.5})
    return med.join(mad, keys) if keys else attach(med, mad, [])


def expanding_median(df: DataFrame, period: str, value: str, periods: list[str]) -> DataFrame:
    """Exact median of all rows in strictly earlier periods, for each listed period: (fold, n_train, median).

    Rows are never copied per fold. Only the bucket totals are laid out by period; the rows of the
    bucket holding the median are the only ones joined to folds.
    """
    d = distinct_counts(df, [period], value)
    span = d.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = attach(d, span, []).withColumn("_b", value_bucket(value, "_lo", "_hi")).drop("_lo", "_hi")
    per = b.groupBy("_b", period).agg(F.sum("_n").alias("_k"))
    grid = per.select("_b").distinct().withColumn(period, F.explode(F.array(*[F.lit(p) for p in periods])))
    earlier = Window.partitionBy("_b").orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    run = (grid.join(per, ["_b", period], "left").select("_b", F.col(period).alias("fold"), F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_k")))
    wf = Window.partitionBy("fold").orderBy("_b")
    cum = run.select("*", F.coalesce(F.sum("_k").over(wf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
                     F.sum("_k").over(Window.partitionBy("fold")).alias("n_train"))
    lo, hi = F.floor((F.col("n_train") - 1) / 2), F.ceil((F.col("n_train") - 1) / 2)
    end = F.col("_start") + F.col("_k")
    need = cum.filter(((lo >= F.col("_start")) & (lo < end)) | ((hi >= F.col("_start")) & (hi < end)))
    rows = (b.join(need, "_b").filter(F.col(period) < F.col("fold")).groupBy("fold", "_b", "_start", "n_train", value).agg(F.sum("_n").alias("_n")))
    w = Window.partitionBy("fold", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.col("_start") + F.sum("_n").over(w))
    g = rows.groupBy("fold", "n_train").agg(F.min(F.when(F.col("_cum") > lo, F.col(value))).alias("_a"), F.min(F.when(F.col("_cum") > hi, F.col(value))).alias("_z"))
    return g.select("fold", "n_train", ((F.col("_a") + F.col("_z")) / 2).alias("median"))


def expanding_median_by_edges(df: DataFrame, period: str, value: str, folds: list[str], cell_rows: int = 100_000) -> DataFrame:
    """``expanding_median`` by another way: (fold, median), for audits.

    Cells lie between approximate quantiles of all rows (any edges give the same medians), the counts of cells and periods
    are summed on the driver (at most 1,024 cells), and only the cells that hold a fold's middle are joined to it.
    """
    spark = df.sparkSession
    known = df.filter(F.col(value).isNotNull() & F.col(period).isNotNull())
    cells = min(max(known.count() // cell_rows, 16), 1024)
    edges = np.array(known.agg(F.percentile_approx(value, [i / cells for i in range(1, cells)], 10_000)).first()[0] or [], dtype=float)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(dtype=float)).astype(np.int32))
    d = distinct_counts(known, [period], value).withColumn("_b", cell(F.col(value).cast("double")))
    per: dict[str, np.ndarray] = {}
    for r in d.groupBy(period, "_b").agg(F.sum("_n").alias("_n")).collect():
        per.setdefault(r[period], np.zeros(cells, dtype=np.int64))[r["_b"]] = r["_n"]
    wanted = []
    for f in folds:
        ends = np.cumsum(sum((k for p, k in per.items() if p < f), np.zeros(cells, dtype=np.int64)))
        n = int(ends[-1])
        if n:
            for b in sorted({int(np.searchsorted(ends, k, side="right")) for k in ((n - 1) // 2, n // 2)}):
                wanted.append((f, b, int(ends[b - 1]) if b else 0, n))
    need = F.broadcast(spark.createDataFrame(wanted, "fold string, _b int, _start long, _total long"))
    rows = d.join(need, "_b").filter(F.col(period) < F.col("fold")).groupBy("fold", "_b", "_start", "_total", value).agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("fold", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.col("_start") + F.sum("_n").over(w))
    low, high = (F.floor((F.col("_total") + k) / 2) for k in (-1, 0))
    g = rows.groupBy("fold").agg(F.min(F.when(F.col("_cum") > low, F.col(value))).alias("_a"), F.min(F.when(F.col("_cum") > high, F.col(value))).alias("_z"))
    return g.select("fold", (F.col("_a") + (F.col("_z") - F.col("_a")) / 2).alias("median"))
