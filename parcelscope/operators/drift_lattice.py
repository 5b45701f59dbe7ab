"""Drift of every period against all earlier ones, without a copy of rows per period.

Rows are reduced to distinct values with a count per period. Values of a variable are cut into value-ordered blocks (``ranks``); a small window over block
totals gives each block, for each period, what lies below it. Inside a block the counts are a matrix of values by periods: running sums along values give
every period's distribution, running sums along periods that of all earlier periods. So one pass yields, for all periods together, each
block's largest distance of the two distributions, its part of the area between them, and the order statistics that fall into it. A second pass over the same
blocks counts values in the bins whose edges the first one found. Blocks are bounded; only (period, measure) rows leave them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from parcelscope.functions.columns import rnd
from parcelscope.operators import ranks

#: Quantiles of the earlier rows: bin edges, then quartiles and median.
_EDGES = [i / 10 for i in range(11)]
_PROBS = [*_EDGES, .25, .5, .75]
_KS, _AREA = -1, -2
#: Order statistics of the period's own rows follow those of the earlier ones.
_OWN = 2 * len(_PROBS)
_LEAST = 1e-6
#: Distinct values of a block, about.
VALUES = 1000


def _blocks(df: DataFrame, period: str, periods: list[str], values: list[str]) -> DataFrame:
    """One row per (variable, value): its block, ``(period number, rows)`` entries, and what lies below the block per period."""
    number = F.array_position(F.array(*map(F.lit, periods)), F.col(period)).cast("int") - 1
    long = ranks.melt(df.filter(F.col(period).isNotNull()).withColumn("_m", number), ["_m"], values, "variable", "value")
    n = long.filter(F.col("value").isNotNull()).groupBy("variable", "value", "_m").agg(F.count(F.lit(1)).alias("_n"))
    held = n.groupBy("variable", "value").agg(F.collect_list(F.struct("_m", "_n")).alias("entries"), F.lit(1).alias("_one"))
    cells, totals = ranks._bucketed(held, ["variable"], "value", ["_one"])
    # a block is a run of cells with about VALUES values; a cell itself has no more than about as many
    blocks = totals.select("variable", "_b", F.floor(F.col("_o__one") / VALUES).alias("block"))
    cut = cells.select("variable", "value", "entries", "_b").join(blocks, ["variable", "_b"]).drop("_b")
    every = blocks.select("variable", "block").distinct().withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(len(periods) - 1))))
    inside = cut.select("variable", "block", F.inline("entries")).groupBy("variable", "block", "_m").agg(F.sum("_n").alias("_in"))
    along = Window.partitionBy("variable", "_m").orderBy("block")
    filled = every.join(inside, ["variable", "block", "_m"], "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    below = filled.select("variable", "block", "_m", F.coalesce(F.sum("_in").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
                          F.sum("_in").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    packed = below.groupBy("variable", "block").agg(F.array_sort(F.collect_list(F.struct("_m", "below", "all"))).alias("p"))
    packed = packed.select("variable", "block", F.transform("p", lambda x: x["below"]).alias("below"), F.transform("p", lambda x: x["all"]).alias("whole"))
    return cut.join(packed, ["variable", "block"]).select("variable", "block", "value", "entries", "below", "whole")


def _matrix(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending values, their counts by period, and the periods' rows below the block and in all."""
    block = block.sort_values("value")
    below, whole = (np.array(block[c].iloc[0], dtype=np.int64) for c in ("below", "whole"))
    count = np.zeros((len(block), len(below)), dtype=np.int64)
    for i, entries in enumerate(block["entries"]):
        for e in entries:
            count[i, e["_m"]] += e["_n"]
    return block["value"].to_numpy(dtype=float), count, below, whole


def _earlier(x: np.ndarray) -> np.ndarray:
    """Sums over earlier periods, the last axis."""
    return np.cumsum(x, axis=-1) - x


def _positions(n: int, probs: list[float]) -> np.ndarray:
    """Ranks from 0 of the lower and upper order statistic of each quantile."""
    low = np.floor(np.round(np.array(probs) * (n - 1), 6)).astype(np.int64)
    return np.concatenate([low, np.minimum(low + 1, n - 1)])


def _measured(block: pd.DataFrame) -> pd.DataFrame:
    value, count, below, whole = _matrix(block)
    before, total = _earlier(below), _earlier(whole)
    own, past = below + np.cumsum(count, axis=0), before + np.cumsum(_earlier(count), axis=0)
    out, name = [], block["variable"].iloc[0]
    for m in np.flatnonzero((whole > 0) & (total > 0)):
        gap = np.abs(own[:, m] / whole[m] - past[:, m] / total[m])
        last = np.concatenate([[abs(below[m] / whole[m] - before[m] / total[m])], gap[:-1]])
        out += [(m, _KS, gap.max()), (m, _AREA, float(value @ (last - gap)))]
        for first, ranks_, run, start in ((0, _positions(total[m], _PROBS), past[:, m], before[m]), (_OWN, _positions(whole[m], [.5]), own[:, m], below[m])):
            here = np.flatnonzero((ranks_ >= start) & (ranks_ < run[-1]))
            out += [(m, first + i, value[np.searchsorted(run, ranks_[i], side="right")]) for i in here]
    return pd.DataFrame([(name, *r) for r in out], columns=["variable", "m", "what", "x"])


def _binned(block: pd.DataFrame) -> pd.DataFrame:
    value, count, _, whole = _matrix(block)
    past, name, out = _earlier(count), block["variable"].iloc[0], []
    for entry in block["edges"].iloc[0]:
        m, edges = entry["m"], np.array(entry["edges"])
        spot = np.minimum(np.maximum(np.searchsorted(edges, value, side="left") - 1, 0), max(len(edges) - 2, 0))
        for b in np.unique(spot):
            out.append((name, m, int(b), int(count[spot == b, m].sum()), int(past[spot == b, m].sum())))
    return pd.DataFrame(out, columns=["variable", "m", "bin", "c", "r"])


def period_drift(df: DataFrame, period: str, values: list[str], target: str, *, least_earlier: int = 1000, least_own: int = 200, digits: int = 6) -> DataFrame:
    """One row per variable and period that has rows and earlier rows: KS, PSI, Jensen-Shannon distance, Wasserstein (raw and by IQR), median shift by IQR, target difference.

    Earlier rows are all rows of periods strictly before; edges, quartiles and IQR are theirs. ``supported`` only flags enough rows.
    """
    periods = [r[0] for r in df.select(period).filter(F.col(period).isNotNull()).distinct().orderBy(period).collect()]
    blocks = _blocks(df, period, periods, values).persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    got = blocks.groupBy("variable", "block").applyInPandas(_measured, "variable string, m int, what int, x double")
    got = got.groupBy("variable", "m", "what").agg(F.max("x").alias("top"), F.sum("x").alias("sum"))
    wide = got.groupBy("variable", "m").agg(F.max(F.when(F.col("what") == _KS, F.col("top"))).alias("ks"), F.max(F.when(F.col("what") == _AREA, F.col("sum"))).alias("wasserstein"),
                                            F.map_from_entries(F.collect_list(F.when(F.col("what") >= 0, F.struct("what", "top")))).alias("order"))
    # periods times variables rows from here on
    sizes = blocks.select("variable", "whole").groupBy("variable").agg(F.first("whole").alias("whole")).select("variable", F.posexplode("whole").alias("m", "n_current"))
    before = Window.partitionBy("variable").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("n_earlier", F.sum("n_current").over(before))
    d = wide.join(sizes, ["variable", "m"])

    def quantile(i: int, p: float, n: str, first: int, k: int):
        low, high = F.col("order")[F.lit(first + i)], F.col("order")[F.lit(first + k + i)]
        at = F.round(F.lit(p) * (F.col(n) - 1), 6)
        return low + (high - low) * (at - F.floor(at))

    past = [quantile(i, p, "n_earlier", 0, len(_PROBS)) for i, p in enumerate(_PROBS)]
    k = len(_EDGES)
    # edges have eight decimals: a value that is an edge must not fall to either side by how the edge was interpolated
    d = d.select("variable", "m", "n_current", "n_earlier", "ks", "wasserstein", F.array_sort(F.array_distinct(F.array(*(F.round(x, 8) for x in past[:k])))).alias("edges"),
                 (past[k + 2] - past[k]).alias("iqr"), past[k + 1].alias("median"), quantile(0, .5, "n_current", _OWN, 1).alias("own_median"))
    edges = d.groupBy("variable").agg(F.collect_list(F.struct("m", "edges")).alias("edges"))
    cells = blocks.join(F.broadcast(edges), "variable").groupBy("variable", "block").applyInPandas(_binned, "variable string, m int, bin int, c long, r long")
    cells = cells.groupBy("variable", "m", "bin").agg(F.sum("c").alias("c"), F.sum("r").alias("r")).join(sizes, ["variable", "m"])
    p, q = F.greatest(F.col("c") / F.col("n_current"), F.lit(_LEAST)), F.greatest(F.col("r") / F.col("n_earlier"), F.lit(_LEAST))
    mid = (p + q) / 2
    div = cells.filter("c + r > 0").groupBy("variable", "m").agg(F.sum((p - q) * F.log(p / q)).alias("psi"), (F.sum(p * F.log2(p / mid) + q * F.log2(q / mid)) / 2).alias("js"))
    rate = df.filter(F.col(period).isNotNull()).groupBy(F.col(period).alias("period")).agg(F.sum(target).alias("y"), F.count(target).alias("n"))
    line = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    rate = rate.select("period", (100 * (F.col("y") / F.col("n") - F.sum("y").over(line) / F.sum("n").over(line))).alias("target"))
    named = spark.createDataFrame([(i, x) for i, x in enumerate(periods)], f"m int, {period} string")
    iqr = F.nullif("iqr", F.lit(0.0))
    out = d.join(div, ["variable", "m"]).join(F.broadcast(named), "m").join(rate.withColumnRenamed("period", period), period)
    return out.select("variable", period, "n_current", "n_earlier", rnd("ks", digits).alias("ks"), rnd("psi", digits).alias("psi"), rnd(F.sqrt(F.greatest("js", F.lit(0.0))), 5).alias("js_distance"),
                      rnd("wasserstein", 5).alias("wasserstein"), rnd(F.col("wasserstein") / iqr, 5).alias("wasserstein_iqr"),
                      rnd((F.col("own_median") - F.col("median")) / iqr, digits).alias("median_shift"), rnd("target", digits).alias("target_delta_pp"),
                      ((F.col("n_earlier") >= least_earlier) & (F.col("n_current") >= least_own)).alias("supported"))
