"""Correlation, binning intervals, differences, posteriors, drift and grouped models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.columns import n_if, rnd, sigmoid
from parcelscope.operators import models, ranks
from parcelscope.operators.checks import union


def pearson_pairs(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair, one scan; NULL for constant columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    aggs = []
    for a, b in pairs:
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
        cov = F.covar_pop(x, y)
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n_if(ok).alias("n"),
                             rnd(cov / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), digits).alias("r")))
    return df.agg(F.array(*aggs).alias("_p")).select(F.inline("_p"))


def spearman(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """Spearman correlation: average ranks of distinct values, weighted by pair counts."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    pairs = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    ra = ranks.average_rank(d, [], "a").select("a", F.col("rank").alias("ra"))
    rb = ranks.average_rank(d, [], "b").select("b", F.col("rank").alias("rb"))
    j = pairs.join(ra, "a").join(rb, "b")
    w, x, y = F.col("w"), F.col("ra"), F.col("rb")
    n = F.sum(w)
    mx, my = F.sum(w * x) / n, F.sum(w * y) / n
    cov, vx, vy = F.sum(w * x * y) / n - mx * my, F.sum(w * x * x) / n - mx * mx, F.sum(w * y * y) / n - my * my
    return j.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), rnd(cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0)), digits).alias("rho"))


def univariate(df: DataFrame, columns: list[str], digits: int = 5) -> DataFrame:
    """n, mean, std, median, IQR, outer quantiles and coefficient of variation."""
    long = ranks.melt(df, [], columns)
    a = long.groupBy("variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    q = ranks.exact_quantiles(long, ["variable"], "value", {"p05": .05, "p25": .25, "median": .5, "p75": .75, "p95": .95})
    d = a.join(q, "variable").withColumns({"iqr": F.col("p75") - F.col("p25"), "cv": F.col("std") / F.nullif("mean", F.lit(0.0))})
    return d.select("variable", "n", *[rnd(k, digits).alias(k) for k in ("mean", "std", "p05", "p25", "median", "p75", "p95", "iqr", "cv")])


def bootstrap_median_interval(df: DataFrame, keys: list[str], value: str, z: float = 1.959963984540054) -> DataFrame:
    """95 % percentile interval of the row-bootstrap median, per group.

    The bootstrap median exceeds the k-th order statistic when a Binomial(n, k/n) count stays under
    n/2, so its percentile interval is a pair of order statistics at 0.5 -+ z / (2 sqrt n). That limit
    of many replicates needs no replicated rows.
    """
    def at(sign):
        return lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + sign * z / (2 * F.sqrt(n.cast("double")))))
    return ranks.exact_quantiles(df, keys, value, {"median": .5, "ci_low": at(-1), "ci_high": at(1)})


def mean_difference(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Standardised mean difference between group 1 and 0 (pooled standard deviation)."""
    long = ranks.melt(df.filter(F.col(group).isin(0, 1)), [group], columns).filter("value is not null")
    one, zero = F.col(group) == 1, F.col(group) == 0

    def s(fn, g):
        return fn(F.when(g, F.col("value")))
    pooled = F.sqrt((s(F.var_samp, one) + s(F.var_samp, zero)) / 2)
    return long.groupBy("variable").agg(n_if(one).alias("n1"), n_if(zero).alias("n0"), rnd(s(F.avg, one)).alias("mean1"), rnd(s(F.avg, zero)).alias("mean0"),
                                        rnd((s(F.avg, one) - s(F.avg, zero)) / F.nullif(pooled, F.lit(0.0))).alias("smd"))


def beta_interval(a: float, b: float, points: int = 20001) -> tuple[float, float]:
    """Central 95 % interval of a Beta(a, b) by summing its density on a fine grid around the mean."""
    x, cdf = _beta_grid(a, b, points)
    return float(np.interp(.025, cdf, x)), float(np.interp(.975, cdf, x))


def _beta_grid(a, b, points=20001):
    m, sd = a / (a + b), np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    x = np.linspace(max(m - 12 * sd, 1e-12), min(m + 12 * sd, 1 - 1e-12), points)
    ld = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    d = np.exp(ld - ld.max())
    cdf = np.concatenate([[0.0], np.cumsum((d[1:] + d[:-1]) / 2 * np.diff(x))])
    return x, cdf / cdf[-1]


def beta_exceeds(a1: float, b1: float, a2: float, b2: float) -> float:
    """P(X > Y) for independent Beta variables."""
    x1, c1 = _beta_grid(a1, b1)
    x2, c2 = _beta_grid(a2, b2)
    at = np.interp((x1[1:] + x1[:-1]) / 2, x2, c2, left=0.0, right=1.0)
    return float(np.sum(at * np.diff(c1)))


def beta_posteriors(groups: DataFrame, reference: str) -> DataFrame:
    """Beta(1,1) posterior per group row (group, n, k): mean, interval, P(rate > reference rate)."""
    rows = [(r["group"], int(r["n"]), int(r["k"])) for r in groups.select("group", "n", "k").collect()]
    base = next((n, k) for g, n, k in rows if g == reference)
    out = []
    for g, n, k in rows:
        a, b = 1.0 + k, 1.0 + n - k
        lo, hi = beta_interval(a, b)
        out.append((g, n, k, a / (a + b), lo, hi, beta_exceeds(a, b, 1.0 + base[1], 1.0 + base[0] - base[1])))
    return groups.sparkSession.createDataFrame(out, "group string, n long, k long, posterior_mean double, ci_low double, ci_high double, p_above_reference double")


def random_intercept(df: DataFrame, y: str, xs: list[str], group: str, grid: int = 200) -> DataFrame:
    """Linear model with a random intercept per group by maximum likelihood.

    Group sums of products come from one aggregate; the variance ratio is profiled on the driver.
    """
    names = ["const", *xs]
    d = models.design(df, y, xs, [group])
    per = models.monthly_products(d.filter(F.col(group).isNotNull()), group, names, "_y")
    d.unpersist()
    k = len(names)
    best = None
    for t in np.concatenate([[0.0], np.logspace(-6, 2, grid)]):
        a, b, c, n, ld = np.zeros((k, k)), np.zeros(k), 0.0, 0.0, 0.0
        for m in per.values():
            ng = m[0, 0]
            w = t / (1 + t * ng)
            sx, sy = m[0, :k], m[0, k]
            a += m[:k, :k] - w * np.outer(sx, sx)
            b += m[:k, k] - w * sx * sy
            c += m[k, k] - w * sy * sy
            n += ng
            ld += np.log1p(t * ng)
        beta = np.linalg.pinv(a) @ b
        s2 = (c - b @ beta) / n
        ll = -0.5 * (n * np.log(2 * np.pi * s2) + ld + n)
        if best is None or ll > best[0]:
            best = (ll, t, s2, beta, np.linalg.pinv(a) * s2)
    ll, t, s2, beta, cov = best
    rows = [(nm, float(bv), float(np.sqrt(max(cov[i, i], 0)))) for i, (nm, bv) in enumerate(zip(names, beta, strict=True))]
    rows += [("group_variance", float(t * s2), 0.0), ("residual_variance", float(s2), 0.0), ("icc", float(t / (1 + t)), 0.0)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_err double")


def rank_audit(df: DataFrame, columns: list[str], tol: float = 1e-10) -> DataFrame:
    """Eigenvalues of the correlation matrix of a feature set, its rank and condition (one aggregate)."""
    m = models.monthly_products(df.withColumns({"_all": F.lit("a"), "const": F.lit(1.0)}), "_all", ["const", *columns[:-1]], columns[-1])["a"]
    n, s = m[0, 0], m[0, 1:]
    cov = m[1:, 1:] / n - np.outer(s, s) / n ** 2
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    ev = np.linalg.eigvalsh(cov / np.outer(sd, sd))[::-1]
    rank = int(np.sum(ev > tol * ev[0]))
    rows = [(i + 1, float(v), rank, float(ev[0] / ev[rank - 1])) for i, v in enumerate(ev)]
    return df.sparkSession.createDataFrame(rows, "position int, eigenvalue double, rank int, condition double")


def drift(df: DataFrame, keys: list[str], value: str, current: str, bins: int = 10, digits: int = 6) -> DataFrame:
    """Current (1) against reference (0) rows per key: KS, Wasserstein (raw and / IQR), PSI, Jensen-Shannon.

    KS and Wasserstein use running counts over pooled distinct values in ranked buckets; PSI and JS
    use the reference's quantile bins.
    """
    d = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
         .agg(n_if(F.col(current) == 1).alias("c"), n_if(F.col(current) == 0).alias("r")))
    run = ranks.cumulative(d, keys, value, ["c", "r"])
    gap = F.abs((F.col("c_before") + F.col("c")) / F.col("c_total") - (F.col("r_before") + F.col("r")) / F.col("r_total"))
    before = F.abs(F.col("c_before") / F.col("c_total") - F.col("r_before") / F.col("r_total"))
    # integral of |F - G| = sum over values of value * (gap just below - gap just above)
    dist = run.groupBy(*keys).agg(rnd(F.max(gap), digits).alias("ks"), F.sum(F.col(value) * (before - gap)).alias("wasserstein"))
    ref = df.filter(F.col(current) == 0)
    edges = ranks.quantile_edges(ref, keys, value, bins)
    iqr = ranks.exact_quantiles(ref, keys, value, {"_q1": .25, "_q3": .75})
    b = ranks.attach(d, edges, keys).withColumn("bin", F.least(ranks.bin_of(value, "edges"), F.size("edges") - 2))
    cells = b.groupBy(*keys, "bin").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    tot = cells.groupBy(*keys).agg(F.sum("c").alias("_c"), F.sum("r").alias("_r"))
    p, q = F.greatest(F.col("c") / F.col("_c"), F.lit(1e-6)), F.greatest(F.col("r") / F.col("_r"), F.lit(1e-6))
    m = (p + q) / 2
    div = ranks.attach(cells, tot, keys).groupBy(*keys).agg(rnd(F.sum((p - q) * F.log(p / q)), digits).alias("psi"),
                                                           rnd(F.sum(p * F.log2(p / m) + q * F.log2(q / m)) / 2, digits).alias("js"))
    out = dist.join(div, keys).join(iqr, keys)
    return out.select(*keys, "ks", "psi", "js", rnd("wasserstein", digits).alias("wasserstein"),
                      rnd(F.col("wasserstein") / F.nullif(F.col("_q3") - F.col("_q1"), F.lit(0.0)), digits).alias("wasserstein_iqr"))


def marginal_grid(df: DataFrame, fit: models.Fit, variable: str, basis, points: int = 50) -> DataFrame:
    """Mean predicted probability as one variable moves over its 1 % to 99 % range, with delta-method error.

    ``basis`` gives the design columns that depend on the variable as expressions of it.
    """
    q = ranks.exact_quantiles(df, [], variable, {"a": .01, "b": .99}).first()
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("g")) for i, v in enumerate(np.linspace(q["a"], q["b"], points))])
    need = [k for k in fit.names if k != "const"]
    d = df.withColumn("const", F.lit(1.0)).na.drop(subset=need).withColumn("_g", F.explode(grid))
    d = d.withColumns(basis(F.col("_g")["g"])).withColumn("_p", sigmoid(fit.predict()))
    w = F.col("_p") * (1 - F.col("_p"))
    rows = d.groupBy(F.col("_g")["i"].alias("i"), F.col("_g")["g"].alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("p"), *[F.avg(w * F.col(k)).alias(f"d_{k}") for k in fit.names]).collect()
    out = []
    for r in rows:
        g = np.array([r[f"d_{k}"] for k in fit.names])
        out.append((r["i"], r["g"], r["n"], r["p"], float(np.sqrt(max(g @ fit.robust @ g, 0)))))
    return df.sparkSession.createDataFrame(out, "position int, at double, n long, mean_probability double, std_err double")


def compare_fits(spark, fits: dict[str, models.Fit]) -> DataFrame:
    """AIC, BIC, log-likelihood and the likelihood-ratio statistic against the first model."""
    first = next(iter(fits.values()))
    rows = [(k, f.n, len(f.names), float(f.stats["llf"]), float(f.stats["aic"]), float(f.stats["bic"]), float(2 * (f.stats["llf"] - first.stats["llf"]))) for k, f in fits.items()]
    return spark.createDataFrame(rows, "model string, n long, parameters int, llf double, aic double, bic double, lr double")


def coefficients(spark, fits: dict[str, models.Fit]) -> DataFrame:
    return union([f.frame(spark, k) for k, f in fits.items()])


def spline_basis(v, knots: list[float]) -> dict:
    """Restricted cubic spline terms beyond the linear one (truncated powers, linear tails)."""
    def cube(u):
        return F.pow(F.greatest(u, F.lit(0.0)), 3)
    last, pen = knots[-1], knots[-2]
    scale = (last - knots[0]) ** 2
    return {f"s{i}": (cube(v - k) - cube(v - pen) * ((last - k) / (last - pen)) + cube(v - last) * ((pen - k) / (last - pen))) / scale
            for i, k in enumerate(knots[:-2])}
