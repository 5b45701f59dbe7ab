"""Ranking, probability and calibration measures for scored rows (any number of groups at once)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelscope.functions.columns import clip01, ratio, rnd
from parcelscope.operators import models, ranks


def score_counts(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Rows and positives per distinct score: the only rows the ranking measures need."""
    return ranks.distinct_counts(df, keys, score, _pos=y)


def ranking_metrics(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", digits: int = 6) -> DataFrame:
    """Average precision (ties as one step) and ROC-AUC (ties half); NULL where only one class exists."""
    c = ranks.cumulative(score_counts(df, keys, y, score), keys, score, ["_n", "_pos"])
    n, pos = F.col("_n"), F.col("_pos")
    precision = (F.col("_pos_total") - F.col("_pos_before")) / (F.col("_n_total") - F.col("_n_before"))
    neg, neg_before = n - pos, F.col("_n_before") - F.col("_pos_before")
    g = c.groupBy(*keys).agg(F.first("_n_total").alias("n"), F.first("_pos_total").alias("positives"), F.sum(pos * precision).alias("_ap"),
                             F.sum(pos * (neg_before + neg / 2.0)).alias("_u"))
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    return g.select(*keys, "n", "positives", rnd(F.col("_ap") / F.nullif(p, F.lit(0)), digits).alias("ap"), rnd(F.col("_u") / F.nullif(p * q, F.lit(0)), digits).alias("auc"))


def probability_metrics(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", eps: float = 1e-15, digits: int = 6) -> DataFrame:
    """Brier score, clipped log loss and prevalence."""
    p = clip01(score, eps)
    yy = F.col(y)
    return df.groupBy(*keys).agg(rnd(F.avg((F.col(score) - yy) ** 2), digits).alias("brier"), rnd(-F.avg(yy * F.log(p) + (1 - yy) * F.log(1 - p)), digits).alias("log_loss"),
                                 rnd(F.avg(yy), digits).alias("prevalence"))


def all_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    m = ranking_metrics(df, keys).join(probability_metrics(df, keys), keys)
    return m.withColumn("ap_lift", rnd(F.col("ap") / F.nullif("prevalence", F.lit(0.0)), 5))


def recall_at(df: DataFrame, keys: list[str], fractions: list[float], row_id: str = "order_id", y: str = "y", score: str = "score") -> DataFrame:
    """Recall among the top max(1, ceil(f n)) rows per fraction; score ties go to the smaller row id.

    Whole score groups above a cut come from counts (all fractions at once); only the tie group at
    each cut is ranked by id.
    """
    c = ranks.cumulative(score_counts(df, keys, y, score), keys, score, ["_n", "_pos"])
    c = c.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    c = c.withColumns({"_k": F.greatest(F.lit(1), F.ceil(F.col("_n_total") * F.col("fraction"))), "_above": F.col("_n_total") - F.col("_n_before") - F.col("_n")})
    by = [*keys, "fraction"]
    full = c.groupBy(*by).agg(F.first("_k").alias("k"), F.first("_pos_total").alias("positives"),
                              F.sum(F.when(F.col("_above") + F.col("_n") <= F.col("_k"), F.col("_pos")).otherwise(0)).alias("_full"))
    cut = c.filter((F.col("_above") < F.col("_k")) & (F.col("_above") + F.col("_n") > F.col("_k"))).select(*by, score, (F.col("_k") - F.col("_above")).alias("_m"))
    tied = df.join(cut, [*keys, score])
    rank = ranks.cumulative(ranks.distinct_counts(tied, [*by, "_m"], row_id, _pos=y), [*by, "_m"], row_id, ["_n"])
    part = rank.filter(F.col("_n_before") < F.col("_m")).groupBy(*by).agg(F.sum("_pos").alias("_part"))
    out = full.join(part, by, "left").withColumn("hits", F.col("_full") + F.coalesce("_part", F.lit(0)))
    return out.select(*by, "k", "hits", rnd(ratio("hits", "positives")).alias("recall"))


def calibration_bins(df: DataFrame, keys: list[str], bins: int = 10, y: str = "y", score: str = "score", digits: int | None = None) -> DataFrame:
    """Quantile bins of the score with mean prediction and observed rate (unrounded).

    With ``digits``, scores are held against edges to so many decimals: small groups have many rows on an edge, which the last
    bit of an interpolated edge would deal to either bin.
    """
    if digits is None:
        d = ranks.qcut(df, score, bins, keys)
    else:
        edges = ranks.quantile_edges(df, keys, score, bins).withColumn("edges", F.array_distinct(F.transform("edges", lambda e: F.round(e, digits))))
        d = ranks.attach(df.withColumn("_held", F.round(score, digits)), edges, keys).withColumn("bin", ranks.bin_of("_held", "edges"))
    return d.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("observed"))


def calibration_error(bins: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Expected and maximum calibration error."""
    gap = F.abs(F.col("mean_score") - F.col("observed"))
    return bins.groupBy(*keys).agg(F.sum("n").alias("n"), rnd(F.sum(F.col("n") * gap) / F.sum("n"), digits).alias("ece"), rnd(F.max(gap), digits).alias("mce"))


def brier_decomposition(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Reliability, resolution, uncertainty, skill and calibration in the large."""
    b = calibration_bins(df, keys, bins)
    base = df.groupBy(*keys).agg(F.avg("y").alias("_y"), F.avg("score").alias("_p"), F.avg((F.col("score") - F.col("y")) ** 2).alias("_brier"))
    j = ranks.attach(b, base, keys)
    n = F.sum("n")
    unc = F.first("_y") * (1 - F.first("_y"))
    return j.groupBy(*keys).agg(rnd(F.first("_brier")).alias("brier"), rnd(F.sum(F.col("n") * (F.col("mean_score") - F.col("observed")) ** 2) / n).alias("reliability"),
                                rnd(F.sum(F.col("n") * (F.col("observed") - F.col("_y")) ** 2) / n).alias("resolution"), rnd(unc).alias("uncertainty"),
                                rnd(1 - F.first("_brier") / F.nullif(unc, F.lit(0.0))).alias("skill"), rnd(F.first("_p") - F.first("_y")).alias("in_the_large"))


def calibration_line(df: DataFrame, y: str = "y", score: str = "score") -> models.Fit:
    """Intercept and slope of the outcome on the logit of the score."""
    p = clip01(score, 1e-6)
    return models.logit(df.withColumn("logit_score", F.log(p / (1 - p))), y, ["logit_score"])


def acceptance(intercept: float, slope: float, ece: float) -> str:
    return "CALIBRATED" if abs(intercept) <= 0.10 and abs(slope - 1) <= 0.10 and ece <= 0.02 else "RECALIBRATE"


#: Rows of a group that share a range of hashes.
_RANGE_ROWS = 20_000


def permuted_values(df: DataFrame, group: str, columns: list[str], repeats: int, row_id: str = "order_id") -> DataFrame:
    """Every column's values in a random order within each group, ``repeats`` times: (row_id, group, term, repeat, new).

    Rows get positions in two hash orders; equal positions are matched. Hashes are even, so a group is cut into ranges of
    them by its number of rows; positions are running counts in a range, so no group is ordered in one task.
    """
    keys = [group, "term", "repeat"]
    cells = F.array(*[F.struct(F.lit(x).alias("term"), F.lit(r).alias("repeat"), F.col(x).cast("double").alias("value")) for x in columns for r in range(repeats)])
    d = df.select(row_id, group, F.inline(cells))

    parts = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / _RANGE_ROWS).alias("_parts"))

    def position(salt):
        h = d.withColumn("_h", F.xxhash64(row_id, "term", "repeat", F.lit(salt))).join(parts, group)
        h = h.withColumn("_b", F.least(F.floor((F.col("_h") / 2.0 ** 64 + 0.5) * F.col("_parts")), F.col("_parts") - 1)).drop("_parts")
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offs = h.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"))
        w = Window.partitionBy(*keys, "_b").orderBy("_h", row_id)
        return h.withColumn("_r", F.row_number().over(w)).join(offs, [*keys, "_b"]).withColumn("_i", F.col("_n_before") + F.col("_r"))
    a = position("from").select(*keys, "_i", F.col("value").alias("new"))
    return position("to").select(row_id, *keys, "_i").join(a, [*keys, "_i"]).drop("_i")


def oriented_deltas(metrics: DataFrame, base: str, other: str, metric: str, higher_better: bool = True) -> DataFrame:
    """Per month: other minus base, signed so that positive means the other model is better."""
    a = metrics.filter(F.col("model") == base).select("month", F.col(metric).alias("_a"))
    b = metrics.filter(F.col("model") == other).select("month", F.col(metric).alias("_b"))
    return a.join(b, "month").select("month", ((F.col("_b") - F.col("_a")) * (1 if higher_better else -1)).alias("delta")).filter("delta is not null")


def rank_algorithms(metrics: DataFrame) -> DataFrame:
    """Means over the folds with both classes, best first; ``complete`` tells whether a model was scored in every such fold of any model."""
    known = metrics.filter(F.col("ap").isNotNull())
    every = known.agg(F.countDistinct("month").alias("folds_expected"))
    g = known.groupBy("model").agg(F.count(F.lit(1)).alias("folds"), *[rnd(F.avg(k)).alias(f"mean_{k}") for k in ("ap", "auc", "brier", "log_loss")])
    g = ranks.attach(g, every, [])
    return g.withColumn("complete", F.col("folds") == F.col("folds_expected")).orderBy(F.desc("complete"), F.desc("mean_ap"), F.desc("mean_auc"), "mean_brier", "model")


def arm_deltas(metrics: DataFrame, spark, base: str = "M0", other: str = "M1", reps: int = 20_000, seed: int = 7) -> DataFrame:
    """Per algorithm (models are named algorithm_arm): monthly differences of the arms, paired bootstrap of the mean AP difference and its class.

    Only months in which both arms have an average precision count; ``unpaired`` gives the others. An algorithm without a paired month has no row.
    """
    from parcelscope.operators.inference import bootstrap_interval
    name = F.col("model")
    arms = F.regexp_extract(name, "_([^_]+)$", 1)
    d = metrics.select(F.regexp_extract(name, "^(.*)_[^_]+$", 1).alias("algorithm"), arms.alias("arm"), "month", "ap", "auc", "brier", "log_loss").filter(F.col("ap").isNotNull())
    g = d.groupBy("algorithm", "month").agg(*[(F.max(F.when(F.col("arm") == other, F.col(k))) - F.max(F.when(F.col("arm") == base, F.col(k)))).alias(k) for k in ("ap", "auc", "brier", "log_loss")])
    both = F.col("ap").isNotNull()
    rows = g.groupBy("algorithm").agg(F.count("ap").alias("folds"), F.count(F.when(~both, 1)).alias("unpaired"), rnd(F.median("ap")).alias("median_delta_ap"),
                                      *[rnd(F.avg(k)).alias(f"mean_delta_{k}") for k in ("auc", "brier", "log_loss")],
                                      F.count(F.when(F.col("ap") > 0, 1)).alias("wins"), F.count(F.when(F.col("ap") == 0, 1)).alias("ties"), F.count(F.when(F.col("ap") < 0, 1)).alias("losses"))
    # one number a month and algorithm
    deltas: dict[str, list[float]] = {}
    for r in g.filter(both).select("algorithm", "month", "ap").orderBy("algorithm", "month").collect():
        deltas.setdefault(r["algorithm"], []).append(float(r["ap"]))
    if not deltas:
        return rows.filter("false").select("*", *[F.lit(None).cast("double").alias(k) for k in ("mean_delta_ap", "ci_low", "ci_high")], F.lit(None).cast("string").alias("status"))
    from parcelscope.operators.checks import union
    b = union([bootstrap_interval(spark, {a: v}, reps, seed) for a, v in deltas.items()])
    status = (F.when((F.col("mean_delta_ap") > 0) & (F.col("ci_low") > 0), f"{other}_SUPPORTED").when(F.col("mean_delta_ap") > 0, f"{other}_FAVORABLE_NOT_DECISIVE")
              .otherwise(f"{other}_NOT_SUPPORTED"))
    b = b.select(F.col("series").alias("algorithm"), F.col("mean_delta").alias("mean_delta_ap"), "ci_low", "ci_high")
    return rows.join(b, "algorithm").withColumn("status", status)


def win_table(deltas: DataFrame, tol: float = 1e-12) -> DataFrame:
    d = F.col("delta")
    return deltas.agg(F.count(F.lit(1)).alias("months"), F.count(F.when(d > tol, 1)).alias("wins"), F.count(F.when(F.abs(d) <= tol, 1)).alias("ties"),
                      F.count(F.when(d < -tol, 1)).alias("losses"), rnd(F.avg(d)).alias("mean_delta"))


def prequential_blend(df: DataFrame, a: str, b: str, y: str = "y", month: str = "month", steps: int = 20) -> DataFrame:
    """Blend weight per month from the Brier score of past months only; ties go to the weight nearest 0.5.

    The Brier score is quadratic in the weight, so three monthly sums replace all passes over rows.
    """
    d, e = F.col(a) - F.col(b), F.col(b) - F.col(y)
    m = df.groupBy(month).agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("dd"), F.sum(d * e).alias("de"), F.sum(e * e).alias("ee"))
    w = Window.orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
    past = m.select("*", *[F.sum(k).over(w).alias(f"p_{k}") for k in ("n", "dd", "de", "ee")])
    g = past.withColumn("alpha", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps)))
    past_brier = F.round((F.col("alpha") ** 2 * F.col("p_dd") + 2 * F.col("alpha") * F.col("p_de") + F.col("p_ee")) / F.col("p_n"), 10)
    best = g.groupBy(month).agg(F.min(F.struct(F.coalesce(past_brier, F.lit(0.0)).alias("s"), F.abs(F.col("alpha") - 0.5).alias("t"), "alpha", "n", "dd", "de", "ee")).alias("z"))
    z = F.col("z")
    return best.select(month, z["n"].alias("n"), z["alpha"].alias("alpha"),
                       rnd((z["alpha"] ** 2 * z["dd"] + 2 * z["alpha"] * z["de"] + z["ee"]) / z["n"]).alias("brier"))


def brier_fit(df: DataFrame, y: str, xs: list[str], max_iter: int = 30, tol: float = 1e-8) -> models.Fit:
    """Gauss-Newton fit of a logistic curve under the Brier loss; Armijo step halving on the driver."""
    names = ["const", *xs]
    d = models.design(df, y, xs)
    prior = d.agg(F.avg("_y")).first()[0]
    beta = np.zeros(len(names))
    beta[0] = np.log(prior / (1 - prior))

    def parts(b, full=True):
        m = 1.0 / (1.0 + F.exp(-models._dot([F.col(k) for k in names], b)))
        e = d.withColumn("_mu", m)
        r = F.col("_mu") - F.col("_y")
        j = F.col("_mu") * (1 - F.col("_mu"))
        if not full:
            return e.agg(F.avg(r * r)).first()[0]
        h, g, (loss, n) = models.products(e, names, j * j, j * r, [F.avg(r * r), F.count(F.lit(1))])
        return h, g, loss, n
    for _ in range(max_iter):
        h, g, loss, n = parts(beta)
        step = np.linalg.pinv(h + 1e-9 * np.eye(len(beta))) @ g
        t = 1.0
        while t > 1e-4 and parts(beta - t * step, False) > loss - 1e-4 * t * 2 * float(g @ step) / n:
            t /= 2
        beta = beta - t * step
        if np.max(np.abs(t * step)) < tol:
            break
    h, g, loss, n = parts(beta)
    d.unpersist()
    return models.Fit(names, beta, np.linalg.pinv(h), np.linalg.pinv(h), n, {"brier": loss})
