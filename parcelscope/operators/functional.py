"""Functional curves: monthly Gram matrices on Spark, small spectral algebra on the driver.

``gram_rows`` is the only pass over rows. Everything after it (bases, reconstruction, smoothing,
rank choice) works on one (n, sum, Gram) triple of at most 90 x 90 numbers per month, channel and window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: energy levels of a basis, explained-share policies, days held out in rank choice
ENERGY = (0.80, 0.90, 0.95, 0.99)
POLICIES = (0.80, 0.85, 0.90, 0.95, 0.99)
HOLDOUTS = (3, 6, 15)
WINDOWS = (30, 60, 90)
MIN_TRAIN, MIN_TEST = 5000, 500


@dataclass
class Moments:
    """Row count, sum vector and Gram matrix of a set of curves."""

    n: float
    s: np.ndarray
    g: np.ndarray

    def __add__(self, o):
        return Moments(self.n + o.n, self.s + o.s, self.g + o.g)

    def cov(self) -> np.ndarray:
        m = self.s / self.n
        return self.g / self.n - np.outer(m, m)

    def scatter_about(self, mu: np.ndarray) -> np.ndarray:
        return self.g - np.outer(self.s, mu) - np.outer(mu, self.s) + self.n * np.outer(mu, mu)

    def head(self, k: int):
        return Moments(self.n, self.s[:k], self.g[:k, :k])


def curve_arrays(curves: DataFrame, channel: str) -> DataFrame:
    """One row per target with the curve of one channel as an array of doubles, and its month."""
    return curves.select("order_id", "t0", F.col(channel).cast("array<double>").alias("curve"), F.date_format(F.timestamp_micros("t0"), "yyyy-MM").alias("month"))


def gram_rows(arrays: DataFrame, first_t0: int, month: str = "month", windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Per period and window: row i of the matrix of sums of products of [1, curve], over curves with full support.

    A curve supports a window when it starts at least that many days after ``first_t0``. All windows come from one
    pass; tasks emit one partial matrix per period and window.
    """
    day = 86_400_000_000

    def part(batches):
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            for m, grp in b.groupby(month):
                x = np.vstack(grp["curve"].to_numpy())
                x = np.hstack([np.ones((len(x), 1)), x])
                age = grp["t0"].to_numpy() - first_t0
                for w in windows:
                    z = x[age >= w * day, :w + 1]
                    if len(z):
                        acc[m, w] = acc.get((m, w), 0.0) + z.T @ z
        for (m, w), a in acc.items():
            yield pd.DataFrame({"period": m, "days": w, "i": range(w + 1), "v": list(a)})

    cells = arrays.select(month, "t0", "curve").mapInPandas(part, "period string, days int, i int, v array<double>")
    keys = ["period", "days", "i"]
    # a group holds one row of the matrix from each task
    rows = cells.groupBy(*keys).agg(F.collect_list("v").alias("_vs"))
    zero = F.array_repeat(F.lit(0.0), F.col("days") + 1)
    return rows.select(*keys, F.aggregate("_vs", zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)).alias("v"))


def moments(grams: DataFrame, days: int) -> dict[str, Moments]:
    """The monthly moments of one window (at most 91 x 91 numbers a month)."""
    out: dict[str, np.ndarray] = {}
    for r in grams.filter(F.col("days") == days).collect():
        out.setdefault(r["period"], np.zeros((days + 1, days + 1)))[r["i"]] = r["v"]
    return {m: Moments(a[0, 0], a[0, 1:], a[1:, 1:]) for m, a in sorted(out.items())}


def spectrum(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.linalg.eigh(c)
    o = np.argsort(w)[::-1]
    return np.maximum(w[o], 0), v[:, o]


def k_for(w: np.ndarray, pve: float) -> int:
    c = np.cumsum(w) / max(w.sum(), 1e-300)
    return int(np.searchsorted(c, pve - 1e-12) + 1)


def expanding(grams: dict[str, Moments], min_months: int = 6):
    """(test month, training moments, test moments) for each month after the warm-up."""
    months, acc = list(grams), None
    for i, m in enumerate(months):
        if i >= min_months and acc is not None:
            yield m, acc, grams[m]
        acc = grams[m] if acc is None else acc + grams[m]


def basis_rows(grams: dict[str, Moments], channel: str, window: int) -> list[tuple]:
    """Components needed per energy level, numerical rank and condition of each expanding basis.

    Months under the row minimum of training or test are kept and named in ``status``.
    """
    out = []
    for m, tr, te in expanding(grams):
        w, _v = spectrum(tr.cov())
        rank = int(np.sum(w > 1e-10 * w[0]))
        status = "FEW_TRAINING_ROWS" if tr.n < MIN_TRAIN else "FEW_TEST_ROWS" if te.n < MIN_TEST else "READY"
        out.append((channel, window, m, int(tr.n), int(te.n), status, *[k_for(w, e) for e in ENERGY], rank, float(w[0] / w[rank - 1])))
    return out


def reconstruction_rows(grams: dict[str, Moments], channel: str, window: int) -> list[tuple]:
    """Relative out-of-time error and its inflation over the training error, per energy policy."""
    out = []
    for m, tr, te in expanding(grams):
        w, v = spectrum(tr.cov())
        mu = tr.s / tr.n
        s = te.scatter_about(mu)
        for e in POLICIES:
            k = k_for(w, e)
            vk = v[:, :k]
            err = 1 - float(np.trace(vk.T @ s @ vk) / np.trace(s))
            train = 1 - float(w[:k].sum() / w.sum())
            out.append((channel, window, m, e, k, err, train, err / max(train, 1e-12)))
    return out


def one_se(rows: pd.DataFrame, group: str, error: str, size: str) -> pd.DataFrame:
    """Mean error per option with its standard error; the smallest option within one error of the best is kept."""
    g = rows.groupby(group).agg(mean_error=(error, "mean"), sd=(error, "std"), n=(error, "size"), mean_size=(size, "mean")).reset_index()
    g["se"] = g["sd"].fillna(0) / np.sqrt(g["n"])
    best = g.loc[g["mean_error"].idxmin()]
    ok = g[g["mean_error"] <= best["mean_error"] + best["se"]]
    g["selected"] = g[group] == ok.loc[ok["mean_size"].idxmin(), group]
    return g.drop(columns="sd")


def smoother(p: int, target_df: float) -> tuple[np.ndarray, float]:
    """Second-difference smoother (I + lambda D'D)^-1 with trace ``target_df``."""
    d = np.diff(np.eye(p), n=2, axis=0)
    w, v = np.linalg.eigh(d.T @ d)
    lo, hi = -12.0, 12.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.sum(1 / (1 + 10 ** mid * np.maximum(w, 0))) > target_df else (lo, mid)
    lam = 10 ** ((lo + hi) / 2)
    return v @ np.diag(1 / (1 + lam * np.maximum(w, 0))) @ v.T, lam


def negative_mass(arrays: DataFrame, smoothers: dict[tuple[int, float], np.ndarray]) -> DataFrame:
    """Per month and configuration (days, ratio): share of smoothed curve mass and cells below zero, in one pass."""
    def part(batches):
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            for m, grp in b.groupby("month"):
                x = np.vstack(grp["curve"].to_numpy())
                for (days, ratio), h in smoothers.items():
                    z = x[:, :days] @ h.T
                    below = z < -1e-10
                    acc[m, days, ratio] = acc.get((m, days, ratio), 0.0) + np.array([len(z), below.sum(), -z[below].sum(), np.abs(z).sum()])
        for (m, days, ratio), v in acc.items():
            yield pd.DataFrame({"month": [m], "days": [days], "df_ratio": [ratio], "n": [int(v[0])], "cells": [int(v[1])], "neg": [v[2]], "mass": [v[3]]})
    d = arrays.select("month", "curve").mapInPandas(part, "month string, days int, df_ratio double, n long, cells long, neg double, mass double")
    return d.groupBy("month", "days", "df_ratio").agg(F.sum("n").alias("curves"), F.sum("cells").alias("negative_cells"), (F.sum("neg") / F.nullif(F.sum("mass"), F.lit(0.0))).alias("negative_mass_share"))


def raw_vs_smooth_rows(grams: dict[str, Moments], h: np.ndarray, channel: str, energy: float = 0.90) -> list[tuple]:
    """Distortion, end-to-end error of raw and smoothed bases, largest principal angle (degrees).

    Both bases take as many components as the raw curves of the past need for ``energy``.
    """
    p = len(h)
    r = np.eye(p) - h
    out = []
    for m, tr, te in expanding(grams):
        mu = tr.s / tr.n
        c = tr.cov()
        values, v = spectrum(c)
        k = k_for(values, energy)
        _, u = spectrum(h @ c @ h.T)
        s = te.scatter_about(mu)
        distortion = float(np.trace(r @ s @ r.T) / np.trace(s))
        raw = 1 - float(np.trace(v[:, :k].T @ s @ v[:, :k]) / np.trace(s))
        a = np.eye(p) - u[:, :k] @ u[:, :k].T @ h
        smooth = float(np.trace(a @ s @ a.T) / np.trace(s))
        sv = np.clip(np.linalg.svd(v[:, :k].T @ u[:, :k], compute_uv=False), -1, 1)
        out.append((channel, m, k, distortion, raw, smooth, float(np.degrees(np.arccos(sv.min())))))
    return out


def bcv_rows(grams: dict[str, Moments], channel: str) -> list[tuple]:
    """Bi-cross-validation error of every feasible rank: a run of days is held out in a test month.

    Held cells are predicted from the month's other days through the rank-k pseudo-inverse of the training block.
    Curves are centred by the training mean; both blocks come from Gram matrices, and all ranks of a block from
    running sums over components. Rank 0 predicts the training mean.
    """
    out = []
    for m, tr, te in expanding(grams):
        mu = tr.s / tr.n
        g, s = tr.n * tr.cov(), te.scatter_about(mu)
        p = len(g)
        for width in (w for w in HOLDOUTS if w < p):
            sse, energy = np.zeros(p - width + 1), 0.0
            for start in range(0, p, width):
                held = np.arange(start, start + width)
                rest = np.setdiff1d(np.arange(p), held)
                w, v = spectrum(g[np.ix_(rest, rest)])
                inverse = np.where(w > 1e-12 * w[0], 1 / np.maximum(w, 1e-300), 0.0)
                load = inverse[:, None] * (v.T @ g[np.ix_(rest, held)])
                linear = np.cumsum(np.sum(load * (v.T @ s[np.ix_(rest, held)]), axis=1))
                square = np.diag(np.cumsum(np.cumsum((v.T @ s[np.ix_(rest, rest)] @ v) * (load @ load.T), axis=0), axis=1))
                total = float(np.trace(s[np.ix_(held, held)]))
                energy += total
                sse += total
                sse[1:] += square - 2 * linear
            sse = np.maximum(sse, 0.0)
            out += [(channel, width, m, k, float(sse[k]), energy, float(np.sqrt(sse[k] / energy))) for k in range(len(sse))]
    return out


def best_rank_draws(indices: DataFrame, errors: dict[tuple, np.ndarray]) -> DataFrame:
    """Rank with the least mean error over the months of each replicate; ties go to the smaller rank.

    ``indices`` has one row per replicate with the drawn month positions ``_ix``; ``errors`` holds a months x ranks
    matrix per key (channel, held-out days).
    """
    def part(batches):
        for b in batches:
            if len(b):
                ix = np.vstack(b["_ix"].to_numpy())
                for (channel, width), e in errors.items():
                    best = e[ix].mean(axis=1).argmin(axis=1)
                    k, n = np.unique(best, return_counts=True)
                    yield pd.DataFrame({"channel": channel, "held_days": width, "k": k, "n": n})
    d = indices.select("_ix").mapInPandas(part, "channel string, held_days int, k int, n long")
    return d.groupBy("channel", "held_days", "k").agg(F.sum("n").alias("replicates"))
