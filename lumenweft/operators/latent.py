"""Latent spaces: sparse components, encoders and decoders as weight tables, traversal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _soft(x: np.ndarray, cut: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - cut, 0)


def sparse_components(x: np.ndarray, k: int, penalty: float, rounds: int = 100) -> np.ndarray:
    """Loadings (k, features): rank-one fits with soft-thresholded loadings, one after another on what is left."""
    return _sparse_loadings(x - x.mean(0), k, penalty, rounds)


def _sparse_loadings(x: np.ndarray, k: int, penalty: float, rounds: int = 100) -> np.ndarray:
    """The loadings depend on x.T @ x alone, so any root of it may stand for x."""
    out = []
    for _ in range(k):
        v = np.linalg.svd(x, full_matrices=False)[2][0]
        for _ in range(rounds):
            u = x @ v
            u /= max(np.linalg.norm(u), 1e-12)
            new = _soft(x.T @ u, penalty)
            new /= max(np.linalg.norm(new), 1e-12)
            if np.allclose(new, v, atol=1e-9):
                break
            v = new
        v = v * np.sign(v[np.abs(v).argmax()] or 1)
        x = x - np.outer(x @ v, v)
        out.append(v)
    return np.array(out)


def encode(rows: DataFrame, weights: np.ndarray, bias: np.ndarray, column: str = "x") -> DataFrame:
    """Adds lat: an affine encoder applied with array functions; ``weights`` (k, features) is a model of fixed size."""
    lat = [F.aggregate(F.zip_with(column, F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a * b), F.lit(float(c)), lambda s, v: s + v) for row, c in zip(weights, bias)]
    return rows.withColumn("lat", F.array(*lat))


def layers_table(spark, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """layer, out, inp, weight: dense layers (weights (out, in), bias) as rows; the bias stands at inp = -1."""
    rows = []
    for k, (weights, bias) in enumerate(layers):
        rows += [(k, o, i, float(w)) for o, line in enumerate(weights) for i, w in enumerate(line)] + [(k, o, -1, float(c)) for o, c in enumerate(bias)]
    return spark.createDataFrame(rows, "layer int, out int, inp int, weight double")


def read_layers(weights: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers of such a table; a model has a fixed size, whatever the rows it is applied to."""
    out = []
    for _, part in weights.toPandas().groupby("layer"):
        wide = part.pivot(index="out", columns="inp", values="weight").fillna(0.0).sort_index().sort_index(axis=1)
        out.append((wide.drop(columns=-1).to_numpy(), wide[-1].to_numpy()))
    return out


def _layer(x: Column, weights: np.ndarray, bias: np.ndarray, active) -> Column:
    lines = F.array(*[F.struct(F.array(*[F.lit(float(w)) for w in line]).alias("w"), F.lit(float(c)).alias("b")) for line, c in zip(weights, bias)])

    def unit(u: Column) -> Column:
        out = F.aggregate(F.zip_with(u.w, x, lambda a, b: a * b), u.b, lambda s, v: s + v)
        return out if active is None else active(out)

    return F.transform(lines, unit)


def _bound(x: Column, layer: tuple[np.ndarray, np.ndarray], active) -> Column:
    return F.transform(x, lambda h: _layer(h, *layer, active))


def forward(rows: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], activations: list, column: str, name: str) -> DataFrame:
    """Adds ``name``: the array ``column`` through dense layers, each followed by its activation (a Column function, or None).

    A layer's input is bound to a name, so that it is computed once and not for every unit.
    """
    x = F.array(F.col(column))
    for layer, active in zip(layers, activations):
        x = _bound(x, layer, active)
    x = F.get(x, F.lit(0))
    return rows.withColumn(name, F.when(F.col(column).isNotNull(), x))


def scatter(rows: DataFrame, size: int, column: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and centred cross products of an array column: partial sums per task, size**2 numbers to the driver.

    Rows whose array is null, of another length, or holds null or non-finite values take no part.
    """

    def partial(batches):
        n, total, product = 0, np.zeros(size), np.zeros((size, size))
        for pdf in batches:
            x = [np.asarray(v, dtype=float) for v in pdf[column] if v is not None and len(v) == size]
            x = np.array(x).reshape(-1, size)
            x = x[np.isfinite(x).all(1)]
            n, total, product = n + len(x), total + x.sum(0), product + x.T @ x
        yield pd.DataFrame({"i": np.arange(size * size + size + 1), "s": np.concatenate([[n], total, product.ravel()])})

    sums = rows.select(column).mapInPandas(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    flat = np.array([r.s for r in sums]) if sums else np.zeros(size * size + size + 1)
    n, total, product = int(flat[0]), flat[1 : size + 1], flat[size + 1 :].reshape(size, size)
    mean = total / max(n, 1)
    return n, mean, product - n * np.outer(mean, mean)


def sparse_pca(rows: DataFrame, size: int, k: int, penalty: float, column: str = "x") -> DataFrame:
    """Adds pc: projections on k sparse loadings, found from the rows' cross products; null where the array takes no part."""
    _, mean, product = scatter(rows, size, column)
    values, vectors = np.linalg.eigh(product)
    loadings = _sparse_loadings(np.sqrt(np.maximum(values, 0))[:, None] * vectors.T, k, penalty)
    x = F.col(column)
    bad = F.size(x) != size
    bad = bad | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    dots = [sum((float(w) * (F.get(x, F.lit(i)) - float(m)) for i, (w, m) in enumerate(zip(line, mean)) if w), start=F.lit(0.0)) for line in loadings]
    return rows.withColumn("pc", F.when(x.isNotNull() & ~bad, F.array(*dots)))


def reparameterize(rows: DataFrame, mu: str, logvar: str, eps: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds z = mu + eps * exp(logvar / 2); eps is drawn from a standard normal where none is given."""
    return rows.withColumn("z", F.col(mu) + (F.randn(seed) if eps is None else eps) * F.exp(F.col(logvar) / 2))


def traverse(rows: DataFrame, latents: list[str], moved: str, steps: list[float], decoder: dict) -> DataFrame:
    """One row per input and step: what the decoder gives with one latent moved, less what it gives unmoved.

    ``decoder`` maps output names to functions of {latent: Column}.
    """
    out = rows.withColumn("step", F.explode(F.array(*[F.lit(float(s)) for s in steps])))
    at = {name: F.col(name) for name in latents}
    shifted = at | {moved: F.col(moved) + F.col("step")}
    return out.withColumns({name: f(shifted) - f(at) for name, f in decoder.items()})
