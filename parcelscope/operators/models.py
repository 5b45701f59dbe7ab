"""Linear and logistic models from distributed sums of products; only p x p algebra on the driver.

Up to ``SQL_WIDTH`` columns the sums are plain Spark aggregates; wider designs use one numpy product
per Arrow batch and one partial row set per task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from parcelscope.operators.component_grid import fit_grid

SQL_WIDTH = 14


def _dot(xs: list[Column], beta) -> Column:
    out = F.lit(0.0)
    for x, b in zip(xs, beta, strict=True):
        out = out + x * F.lit(float(b))
    return out


def _wide_products(df: DataFrame, xs: list[str], w: str, z: str) -> tuple[np.ndarray, np.ndarray]:
    p = len(xs)

    def part(batches):
        acc = np.zeros((p + 1, p))
        for b in batches:
            x = b[xs].to_numpy(dtype=float)
            acc[:p] += x.T @ (x * b[w].to_numpy(dtype=float)[:, None])
            acc[p] += x.T @ b[z].to_numpy(dtype=float)
        yield pd.DataFrame({"i": range(p + 1), "v": list(acc)})

    rows = (df.select(*xs, w, z).mapInPandas(part, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
            .groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    m = np.zeros((p + 1, p))
    for r in rows:
        m[r.i, r.j] = r.v
    return m[:p], m[p]


def products(df: DataFrame, xs: list[str], weight: Column, z: Column, extra: list[Column] | None = None):
    """Sum of w x x', sum of z x and any extra sums, in one pass."""
    extra = extra or []
    p = len(xs)
    if p > SQL_WIDTH:
        d = df.select(*xs, weight.cast("double").alias("_w"), z.cast("double").alias("_z"))
        a, b = _wide_products(d, xs, "_w", "_z")
        ex = list(df.agg(*extra).first()) if extra else []
        return a, b, ex
    d = df.withColumns({"_w": weight, "_z": z})
    aggs = [F.sum(F.col("_w") * F.col(xs[i]) * F.col(xs[j])) for i in range(p) for j in range(i, p)]
    aggs += [F.sum(F.col("_z") * F.col(x)) for x in xs]
    row = list(d.agg(*aggs, *extra).first())
    a = np.zeros((p, p))
    k = 0
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = row[k] or 0.0
            k += 1
    return a, np.array([v or 0.0 for v in row[k:k + p]]), row[k + p:]


@dataclass
class Fit:
    """Coefficients with model and robust covariance."""

    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    robust: np.ndarray
    n: int
    stats: dict

    def predict(self) -> Column:
        return _dot([F.col(x) for x in self.names], self.coef)

    def frame(self, spark, model: str = "model") -> DataFrame:
        from math import erfc, sqrt
        rows = []
        for i, k in enumerate(self.names):
            se = float(np.sqrt(max(self.robust[i, i], 0.0)))
            z = float(self.coef[i] / se) if se > 0 else None
            rows.append((model, k, float(self.coef[i]), se, z, erfc(abs(z) / sqrt(2)) if z is not None else None))
        return spark.createDataFrame(rows, "model string, term string, coef double, std_err double, z double, p_value double")


def design(df: DataFrame, y: str, xs: list[str], keep: list[str] | None = None) -> DataFrame:
    """Complete rows with an intercept column ``const``; kept in memory or on disk while a fit iterates."""
    cols = [F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("const"), *[F.col(x).cast("double").alias(x) for x in xs], *(keep or [])]
    d = df.select(*cols).na.drop(subset=["_y", *xs])
    return d.persist(StorageLevel.MEMORY_AND_DISK)


def standardised(df: DataFrame, columns: list[str], ddof: int = 0) -> DataFrame:
    """z-scores with population (0) or sample (1) deviation; suffix ``_z``."""
    fn = F.stddev_pop if ddof == 0 else F.stddev_samp
    from parcelscope.operators.ranks import with_one_row
    s = df.agg(*[F.avg(k).alias(f"m_{k}") for k in columns], *[fn(k).alias(f"s_{k}") for k in columns])
    d = with_one_row(df, s, "_st")
    return d.withColumns({f"{k}_z": (F.col(k) - F.col("_st")[f"m_{k}"]) / F.nullif(F.col("_st")[f"s_{k}"], F.lit(0.0)) for k in columns}).drop("_st")


def ols(df: DataFrame, y: str, xs: list[str], cluster: list[str] | None = None) -> Fit:
    """Least squares with HC1 errors, or cluster-robust errors for one or two cluster columns."""
    names = ["const", *xs]
    d = design(df, y, xs, cluster)
    one = F.lit(1.0)
    a, b, (n, sy, syy) = products(d, names, one, F.col("_y"), [F.count(F.lit(1)), F.sum("_y"), F.sum(F.col("_y") * F.col("_y"))])
    inv = np.linalg.pinv(a)
    beta = inv @ b
    e = F.col("_y") - _dot([F.col(k) for k in names], beta)
    meat, _, (sse,) = products(d, names, e * e, e, [F.sum(e * e)])
    k = len(names)
    if cluster:
        robust = _cluster_cov(d, names, e, cluster, inv, n)
    else:
        robust = inv @ meat @ inv * n / max(n - k, 1)
    sst = syy - sy * sy / n
    r2 = 1 - sse / sst if sst > 0 else float("nan")
    d.unpersist()
    return Fit(names, beta, inv * sse / max(n - k, 1), robust, n,
               {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / max(n - k, 1), "sse": sse, "condition": float(np.linalg.cond(a))})


def _score_products(d: DataFrame, names: list[str], e: Column, keys: list[str]) -> tuple[np.ndarray, int]:
    s = d.groupBy(*keys).agg(*[F.sum(e * F.col(x)).alias(x) for x in names])
    m, _, (g,) = products(s, names, F.lit(1.0), F.lit(0.0), [F.count(F.lit(1))])
    return m, g


def _cluster_cov(d, names, e, cluster, inv, n) -> np.ndarray:
    """One-way, or two-way as A + B - A x B, each with its finite-sample factor."""
    k = len(names)

    def part(keys):
        m, g = _score_products(d, names, e, keys)
        return inv @ m @ inv * (g / max(g - 1, 1)) * ((n - 1) / max(n - k, 1))
    if len(cluster) == 1:
        return part(cluster)
    return part([cluster[0]]) + part([cluster[1]]) - part(cluster)


def logit(df: DataFrame, y: str, xs: list[str], ridge: float = 0.0, max_iter: int = 30, tol: float = 1e-9) -> Fit:
    """Logistic or fractional-logit fit by Newton steps (one aggregate per step); HC1 errors."""
    names = ["const", *xs]
    d = design(df, y, xs)
    beta = np.zeros(len(names))
    pen = np.diag([0.0] + [ridge] * len(xs))
    mu = F.col("_mu")
    ll = F.sum(F.col("_y") * F.log(mu) + (1 - F.col("_y")) * F.log(1 - mu))

    def at(b):
        m = 1.0 / (1.0 + F.exp(-_dot([F.col(k) for k in names], b)))
        return d.withColumn("_mu", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), m)))
    for _ in range(max_iter):
        h, g, (n, llf) = products(at(beta), names, mu * (1 - mu), F.col("_y") - mu, [F.count(F.lit(1)), ll])
        step = np.linalg.pinv(h + pen) @ (g - pen @ beta)
        size = float(np.max(np.abs(step)))
        beta = beta + step * min(1.0, 5.0 / size if size > 0 else 1.0)
        if size < tol:
            break
    converged = size < tol
    r = F.col("_y") - mu
    h, _, (n, llf) = products(at(beta), names, mu * (1 - mu), r, [F.count(F.lit(1)), ll])
    meat, _, _ = products(at(beta), names, r * r, r)
    inv = np.linalg.pinv(h + pen)
    k = len(names)
    d.unpersist()
    return Fit(names, beta, inv, inv @ meat @ inv * n / max(n - k, 1), n, {"llf": llf, "aic": 2 * k - 2 * llf, "bic": k * np.log(n) - 2 * llf, "converged": converged})


def benjamini_hochberg(coefs: DataFrame, p: str = "p_value") -> DataFrame:
    """FDR-adjusted p-values over a coefficient table (small: one row per term)."""
    from pyspark.sql import Window
    known = coefs.filter(F.col(p).isNotNull())
    w = Window.orderBy(p, "model", "term")
    d = known.withColumns({"_i": F.row_number().over(w), "_m": F.count(F.lit(1)).over(Window.partitionBy())})
    raw = F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_i"))
    back = Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("q_value", F.min(raw).over(back)).drop("_i", "_m")


# ---------------------------------------------------------------- models per expanding fold
def monthly_products(df: DataFrame, period: str, xs: list[str], y: str) -> dict[str, np.ndarray]:
    """Per period: the (p+1) x (p+1) matrix of sums of products of [x, y] over complete rows."""
    cols = [*xs, y]
    d = df.select(period, *[F.col(k).cast("double").alias(k) for k in cols]).na.drop()
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = d.groupBy(period).agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        m = np.zeros((p, p))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r[period]] = m
    return out


def expanding_ols(df: DataFrame, period: str, periods: list[str], xs: list[str], y: str, min_periods: int = 3, min_rows: int = 100) -> dict[str, np.ndarray]:
    """Coefficients per test period from all earlier periods (prefix sums of the monthly products)."""
    d = df.withColumn("const", F.lit(1.0))
    per = monthly_products(d, period, ["const", *xs], y)
    k = len(xs) + 1
    acc, out = np.zeros((k + 1, k + 1)), {}
    for i, m in enumerate(periods):
        if i >= min_periods and acc[0, 0] >= min_rows:
            out[m] = np.linalg.lstsq(acc[:k, :k], acc[:k, k], rcond=None)[0]
        acc = acc + per.get(m, 0.0)
    return out


def apply_fold_coefficients(df: DataFrame, period: str, xs: list[str], coefs: dict[str, np.ndarray], out: str) -> DataFrame:
    """Score each row with the coefficients of its own period (a table of one row per period)."""
    spark = df.sparkSession
    rows = [(m, [float(v) for v in b]) for m, b in coefs.items()]
    c = spark.createDataFrame(rows, f"{period} string, _coef array<double>")
    score = F.col("_coef")[0]
    for i, x in enumerate(xs):
        score = score + F.col("_coef")[i + 1] * F.col(x)
    return df.join(c, period, "left").withColumn(out, score).drop("_coef")


def fold_logit(df: DataFrame, usable: str, folds: list[str], xs: list[str], y: str, c: float | None = 1.0, max_iter: int = 100,
               tol: float = 1e-8) -> dict[str, dict]:
    """Logistic fits for every expanding fold together: one pass per step for all folds, without copies of rows.

    A row trains in each fold after the period it became usable. Columns are scaled by the fold's own training mean and
    population deviation; ``c`` is the inverse L2 strength on the scaled coefficients (None: no penalty). Returns raw-unit
    and scaled coefficients per fold; ``converged`` tells whether the last step was below ``tol``.
    """
    values = F.array(F.lit(1.0), *[F.col(x).cast("double") for x in xs])
    d = df.na.drop(subset=[usable, y, *xs]).select(F.col(usable).alias("usable"), F.col(y).cast("double").alias("y"), values.alias("values")).persist(StorageLevel.MEMORY_AND_DISK)
    coefs, done, scales = fit_grid(d, folds, len(xs), 0, [0], np.inf if c is None else c, max_iter, tol)
    sizes = d.groupBy("usable").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    d.unpersist()
    out = {}
    for f, b in coefs.items():
        t = scales[f]
        sd = 1 / np.diag(t)[1:]
        out[f] = {"coef": b[:, 0], "scaled": np.linalg.solve(t.T, b[:, 0]), "mean": -t[1:, 0] * sd, "sd": sd, "converged": done[f, 0],
                  "n": sum(r["n"] for r in sizes if r["usable"] < f), "pos": int(sum(r["y"] for r in sizes if r["usable"] < f))}
    return out
