"""Sparse canonical correlation from cross products: a grid of settings, projections, weights, loadings.

The rows are read once, for cross products per fold; every fit then works on matrices whose size doesn't depend on the rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Pairs(NamedTuple):
    """Means and weights (feature, dimension) of two views in the rows' units, loadings, correlation per dimension."""

    mean_x: np.ndarray
    mean_y: np.ndarray
    weights_x: np.ndarray
    weights_y: np.ndarray
    loadings_x: np.ndarray
    loadings_y: np.ndarray
    score: np.ndarray


def _unit(w: np.ndarray, gram: np.ndarray) -> np.ndarray:
    size = np.sqrt(max(w @ gram @ w, 0.0))
    return w / size if size > 1e-10 else np.zeros_like(w)


def _elastic_net(gram: np.ndarray, target: np.ndarray, w: np.ndarray, l1: float, l2: float, top: float, steps: int = 10) -> np.ndarray:
    """Proximal gradient steps for 1/2 w'Gw - t'w + l1 |w| + l2/2 |w|**2; ``top`` is G's largest eigenvalue."""
    for _ in range(steps):
        moved = w - (gram @ w - target) / top
        w = np.sign(moved) * np.maximum(np.abs(moved) - l1 / top, 0) / (1 + l2 / top)
    return w


def fit_pairs(cov: np.ndarray, p: int, k: int, alpha: float, ratio: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights of k pairs from the joint covariance of both views (the first ``p`` features are x).

    Features are scaled to unit variance. Each view is in turn regressed on the other's score, with an elastic net
    of ``alpha`` and l1 share ``ratio``; a pair found is taken out of both views. Pairs beyond the signal are 0.
    """
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-12, sd, np.inf)
    s = cov / np.outer(sd, sd)
    sx, sxy, sy = s[:p, :p], s[:p, p:], s[p:, p:]
    left, right = np.eye(p), np.eye(len(s) - p)
    out_x, out_y = np.zeros((p, k)), np.zeros((len(s) - p, k))
    for d in range(k):
        gx, gy, c = left.T @ sx @ left, right.T @ sy @ right, left.T @ sxy @ right
        tx, ty = (max(np.linalg.eigvalsh(g)[-1], 1e-12) for g in (gx, gy))
        a, b = np.zeros(p), _unit(np.linalg.svd(c, full_matrices=False)[2][0], gy)
        for _ in range(rounds):
            a_new = _unit(_elastic_net(gx, c @ b, a, alpha * ratio, alpha * (1 - ratio), tx), gx)
            b_new = _unit(_elastic_net(gy, c.T @ a_new, b, alpha * ratio, alpha * (1 - ratio), ty), gy)
            still = np.allclose(a_new, a, atol=1e-7) and np.allclose(b_new, b, atol=1e-7)
            a, b = a_new, b_new
            if still or not a.any() or not b.any():
                break
        if not a.any() or not b.any():
            break
        out_x[:, d], out_y[:, d] = left @ a, right @ b
        left, right = left @ (np.eye(p) - np.outer(a, a @ gx)), right @ (np.eye(len(b)) - np.outer(b, b @ gy))
    return out_x / sd[:p, None], out_y / sd[p:, None]


def pair_scores(cov: np.ndarray, p: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of the two projections per dimension; 0 where one is constant."""
    both = np.einsum("id,ij,jd->d", a, cov[:p, p:], b)
    size = np.einsum("id,ij,jd->d", a, cov[:p, :p], a) * np.einsum("id,ij,jd->d", b, cov[p:, p:], b)
    return np.where(size > 1e-20, both / np.sqrt(np.maximum(size, 1e-20)), 0.0)


def _usable(x: Column, size: int) -> Column:
    return x.isNotNull() & (F.size(x) == size) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def fold_sums(rows: DataFrame, p: int, q: int, folds: int) -> np.ndarray:
    """(folds, 1 + p + q, 1 + p + q): sums of the outer products of (1, x, y), per fold of a hash of id.

    Partial sums per task; the driver gets folds * (1 + p + q)**2 numbers. Rows with an array that is null,
    of another length, or holds null or non-finite values take no part.
    """
    n = 1 + p + q

    def partial(batches):
        sums = np.zeros((folds, n, n))
        for pdf in batches:
            if len(pdf):
                z = np.hstack([np.ones((len(pdf), 1)), np.stack(pdf["x"]).astype(float), np.stack(pdf["y"]).astype(float)])
                for f in range(folds):
                    part = z[pdf["fold"].to_numpy() == f]
                    sums[f] += part.T @ part
        yield pd.DataFrame({"i": np.arange(sums.size), "s": sums.ravel()})

    good = rows.filter(_usable(F.col("x"), p) & _usable(F.col("y"), q)).select("x", "y", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold"))
    out = np.zeros(folds * n * n)
    for r in good.mapInPandas(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r.i] = r.s
    return out.reshape(folds, n, n)


def _covariance(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(sums[0, 0], 1.0)
    mean = sums[0, 1:] / n
    return mean, sums[1:, 1:] / n - np.outer(mean, mean)


def grid_search(rows: DataFrame, p: int, q: int, alphas: list[float], ratios: list[float], latents: list[int], folds: int = 5) -> DataFrame:
    """alpha, l1_ratio, latents, score: the correlation of held-out projections, averaged over dimensions and folds.

    ``rows``: id, x (array of p), y (array of q). Each setting and fold is a row of the grid, fitted from cross products.
    """
    sums = fold_sums(rows, p, q, folds)
    inner = [_covariance(sums.sum(0) - held)[1] for held in sums]
    outer = [_covariance(held)[1] for held in sums]

    def fit(batches):
        for pdf in batches:
            score = []
            for g in pdf.itertuples():
                a, b = fit_pairs(inner[g.fold], p, g.latents, g.alpha, g.l1_ratio)
                score.append(float(pair_scores(outer[g.fold], p, a, b).mean()))
            yield pdf.drop(columns="fold").assign(score=score)

    grid = [(float(a), float(r), int(k), f) for a in alphas for r in ratios for k in latents for f in range(folds)]
    spark = rows.sparkSession
    work = spark.createDataFrame(grid, "alpha double, l1_ratio double, latents int, fold int").repartition(min(len(grid), spark.sparkContext.defaultParallelism))
    return work.mapInPandas(fit, "alpha double, l1_ratio double, latents int, score double").groupBy("alpha", "l1_ratio", "latents").agg(F.avg("score").alias("score"))


def fit(rows: DataFrame, p: int, q: int, alpha: float, ratio: float, latents: int) -> Pairs:
    """The pairs of one setting, from all rows."""
    mean, cov = _covariance(fold_sums(rows, p, q, 1)[0])
    a, b = fit_pairs(cov, p, latents, alpha, ratio)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))

    def loadings(block: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(np.einsum("id,ij,jd->d", w, block, w), 0))
        return block @ w / s[:, None] / np.where(size > 1e-10, size, np.inf)

    return Pairs(mean[:p], mean[p:], a, b, loadings(cov[:p, :p], a, sd[:p]), loadings(cov[p:, p:], b, sd[p:]), pair_scores(cov, p, a, b))


def _project(column: str, mean: np.ndarray, weights: np.ndarray) -> Column:
    x = F.col(column)
    lines = [sum((float(w) * (F.get(x, F.lit(i)) - float(m)) for i, (w, m) in enumerate(zip(line, mean)) if w), start=F.lit(0.0)) for line in weights.T]
    return F.when(_usable(x, len(mean)), F.array(*lines))


def project(rows: DataFrame, model: Pairs) -> DataFrame:
    """Adds u and v: projections of x and y; null where the array can't be projected."""
    return rows.withColumns({"u": _project("x", model.mean_x, model.weights_x), "v": _project("y", model.mean_y, model.weights_y)})


def weights_and_loadings(spark, model: Pairs) -> DataFrame:
    """view, feature, dim, weight, loading: a model as a table."""
    views = (("x", model.weights_x, model.loadings_x), ("y", model.weights_y, model.loadings_y))
    rows = [(view, i, d, float(w[i, d]), float(load[i, d])) for view, w, load in views for i in range(w.shape[0]) for d in range(w.shape[1])]
    return spark.createDataFrame(rows, "view string, feature int, dim int, weight double, loading double")
