"""A convolutional autoencoder with a Gaussian bottleneck, trained over a table of volumes.

Encoder: two of (convolution of 3, ReLU, max pooling by 2), then a dense mean and log variance.
Decoder: dense, two transposed convolutions by 2 with ReLU, one that restores the volume's size, sigmoid.
The loss is the mean squared error, for symmetric volumes also against the volume with its first two
axes swapped; there is no divergence term. Gradients are made in numpy, batch by batch inside each task, and summed by
Spark; the driver holds models of fixed size and applies Adam. All models of a grid learn in the same passes.

Batches and noise follow from each row's id and the epoch, not from the partitioning, so a run can
be repeated or taken up from a checkpoint. Rows whose volume is null, of another size or not finite take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Volumes that a task takes at a time.
ROWS_AT_ONCE = 16
AXES = (2, 3, 4)


@dataclass
class Model:
    """Weights by name with Adam's two moments; ``shape`` is a volume's, ``latents`` the bottleneck's size."""

    shape: tuple[int, int, int]
    latents: int
    weights: dict[str, np.ndarray]
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0
    epochs: int = 0

    def __post_init__(self):
        for moments in (self.first, self.second):
            for name, w in self.weights.items():
                moments.setdefault(name, np.zeros_like(w))


def new_model(shape: tuple[int, int, int], latents: int, channels: tuple[int, int, int] = (16, 32, 8), seed: int = 42) -> Model:
    """Uniform weights within one over the root of the inputs; ``channels``: after the first and second convolution, and before the last."""
    r = np.random.default_rng([seed, latents])
    a, b, c = channels
    flat = b * int(np.prod([n // 4 for n in shape]))
    last = tuple(n - 4 * (n // 4) + 3 for n in shape)  # restores what pooling cut off an odd axis
    sizes = {
        "conv1": ((a, 1, 3, 3, 3), 27), "conv2": ((b, a, 3, 3, 3), 27 * a),
        "mean": ((latents, flat), flat), "logvar": ((latents, flat), flat), "open": ((flat, latents), latents),
        "up1": ((b, a, 2, 2, 2), 8 * a), "up2": ((a, c, 2, 2, 2), 8 * c), "last": ((1, c, *last), c * int(np.prod(last))),
    }
    weights = {}
    for name, (size, inputs) in sizes.items():
        bound = 1 / np.sqrt(inputs)
        weights[name] = r.uniform(-bound, bound, size)
        weights[f"{name}_bias"] = r.uniform(-bound, bound, size[1] if name.startswith("up") else size[0])
    return Model(tuple(shape), latents, weights)


def _wide(bias: np.ndarray) -> np.ndarray:
    return bias[:, None, None, None]


def _patches(x: np.ndarray, kernel: tuple, pads: list[int]) -> np.ndarray:
    return sliding_window_view(np.pad(x, [(0, 0), (0, 0), *[(p, p) for p in pads]]), kernel, AXES)


def _conv(x: np.ndarray, w: np.ndarray, bias: np.ndarray, pads: list[int]) -> np.ndarray:
    out = np.tensordot(_patches(x, w.shape[2:], pads), w, axes=([1, 5, 6, 7], [1, 2, 3, 4]))
    return np.moveaxis(out, -1, 1) + _wide(bias)


def _conv_back(g: np.ndarray, x: np.ndarray, w: np.ndarray, pads: list[int]):
    """Gradients of the weights, the bias and the input."""
    gw = np.tensordot(g, _patches(x, w.shape[2:], pads), axes=([0, 2, 3, 4], [0, 2, 3, 4]))
    turned = np.flip(w, AXES).swapaxes(0, 1)
    return gw, g.sum((0, 2, 3, 4)), _conv(g, turned, np.zeros(w.shape[1]), [k - 1 - p for k, p in zip(w.shape[2:], pads)])


def _pool(x: np.ndarray):
    """Maxima of blocks of 2 x 2 x 2 and where they stand in their block; what is over at an odd end is left out."""
    b, c, *n = x.shape
    h = [k // 2 for k in n]
    blocks = x[:, :, : 2 * h[0], : 2 * h[1], : 2 * h[2]].reshape(b, c, h[0], 2, h[1], 2, h[2], 2)
    blocks = blocks.transpose(0, 1, 2, 4, 6, 3, 5, 7).reshape(b, c, *h, 8)
    at = blocks.argmax(-1)[..., None]
    return np.take_along_axis(blocks, at, -1)[..., 0], at


def _pool_back(g: np.ndarray, at: np.ndarray, size: tuple) -> np.ndarray:
    b, c, *h = g.shape
    blocks = np.zeros((b, c, *h, 8))
    np.put_along_axis(blocks, at, g[..., None], -1)
    out = np.zeros(size)
    blocks = blocks.reshape(b, c, *h, 2, 2, 2).transpose(0, 1, 2, 5, 3, 6, 4, 7)
    out[:, :, : 2 * h[0], : 2 * h[1], : 2 * h[2]] = blocks.reshape(b, c, *[2 * k for k in h])
    return out


def _up(x: np.ndarray, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    b, _, *n = x.shape
    out = np.tensordot(x, w, axes=(1, 0)).transpose(0, 4, 1, 5, 2, 6, 3, 7)
    return out.reshape(b, w.shape[1], *[2 * k for k in n]) + _wide(bias)


def _up_back(g: np.ndarray, x: np.ndarray, w: np.ndarray):
    b, _, *n = x.shape
    blocks = g.reshape(b, w.shape[1], n[0], 2, n[1], 2, n[2], 2).transpose(0, 2, 4, 6, 1, 3, 5, 7)
    gx = np.moveaxis(np.tensordot(blocks, w, axes=([4, 5, 6, 7], [1, 2, 3, 4])), -1, 1)
    return np.tensordot(x, blocks, axes=([0, 2, 3, 4], [0, 1, 2, 3])), g.sum((0, 2, 3, 4)), gx


def _encode(model: Model, x: np.ndarray) -> dict:
    w, s = model.weights, {"x": x[:, None]}
    s["c1"] = np.maximum(_conv(s["x"], w["conv1"], w["conv1_bias"], [1, 1, 1]), 0)
    s["p1"], s["at1"] = _pool(s["c1"])
    s["c2"] = np.maximum(_conv(s["p1"], w["conv2"], w["conv2_bias"], [1, 1, 1]), 0)
    s["p2"], s["at2"] = _pool(s["c2"])
    s["flat"] = s["p2"].reshape(len(x), -1)
    s["mean"] = s["flat"] @ w["mean"].T + w["mean_bias"]
    s["logvar"] = s["flat"] @ w["logvar"].T + w["logvar_bias"]
    return s


def _decode(model: Model, z: np.ndarray) -> dict:
    w, s = model.weights, {"z": z}
    s["o"] = (z @ w["open"].T + w["open_bias"]).reshape(len(z), -1, *[n // 4 for n in model.shape])
    s["u1"] = np.maximum(_up(s["o"], w["up1"], w["up1_bias"]), 0)
    s["u2"] = np.maximum(_up(s["u1"], w["up2"], w["up2_bias"]), 0)
    s["out"] = np.exp(-np.logaddexp(0, -_conv(s["u2"], w["last"], w["last_bias"], [k - 2 for k in w["last"].shape[2:]])))  # the sigmoid, without overflow
    return s


def loss_and_gradients(model: Model, x: np.ndarray, noise: np.ndarray, symmetric: bool):
    """Sum over the rows of ``x`` (rows, *shape) of each one's loss, and the gradients of that sum."""
    w, g = model.weights, {}
    e = _encode(model, x)
    spread = np.exp(0.5 * e["logvar"])
    d = _decode(model, e["mean"] + noise * spread)
    gap = d["out"] - e["x"]
    swapped = d["out"] - e["x"].swapaxes(2, 3) if symmetric else np.zeros(1)
    size = int(np.prod(model.shape))
    back = 2 * (gap + swapped) / size * d["out"] * (1 - d["out"])
    g["last"], g["last_bias"], back = _conv_back(back, d["u2"], w["last"], [k - 2 for k in w["last"].shape[2:]])
    g["up2"], g["up2_bias"], back = _up_back(back * (d["u2"] > 0), d["u1"], w["up2"])
    g["up1"], g["up1_bias"], back = _up_back(back * (d["u1"] > 0), d["o"], w["up1"])
    back = back.reshape(len(x), -1)
    g["open"], g["open_bias"], gz = back.T @ d["z"], back.sum(0), back @ w["open"]
    gl = gz * noise * spread / 2
    g["mean"], g["mean_bias"] = gz.T @ e["flat"], gz.sum(0)
    g["logvar"], g["logvar_bias"] = gl.T @ e["flat"], gl.sum(0)
    back = (gz @ w["mean"] + gl @ w["logvar"]).reshape(e["p2"].shape)
    back = _pool_back(back, e["at2"], e["c2"].shape) * (e["c2"] > 0)
    g["conv2"], g["conv2_bias"], back = _conv_back(back, e["p1"], w["conv2"], [1, 1, 1])
    back = _pool_back(back, e["at1"], e["c1"].shape) * (e["c1"] > 0)
    g["conv1"], g["conv1_bias"], _ = _conv_back(back, e["x"], w["conv1"], [1, 1, 1])
    return float((gap**2).sum() + (swapped**2).sum()) / size, g


def _noise(keys: np.ndarray, epoch: int, latents: int) -> np.ndarray:
    return np.array([np.random.Generator(np.random.Philox(key=[int(k) & (2**64 - 1), epoch])).standard_normal(latents) for k in keys])


def _volumes(part: pd.DataFrame, column: str, shape: tuple[int, int, int]):
    """Which rows of ``part`` have a volume, and their volumes."""
    size = int(np.prod(shape))
    fit = np.array([v is not None and len(v) == size and bool(np.isfinite(np.asarray(v, float)).all()) for v in part[column]], bool)
    return fit, np.array([np.asarray(v, float) for v in part[column][fit]]).reshape(-1, *shape)


def _gradient_sums(rows: DataFrame, models: list[Model], epoch: int, column: str, symmetric: bool) -> list[tuple[int, float, np.ndarray]]:
    """Per model: rows, summed loss, summed gradients in one vector; one pass for all models, summed by Spark."""
    sizes = [sum(w.size for w in m.weights.values()) + 2 for m in models]
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        sums = [np.zeros(s) for s in sizes]
        for part in parts:
            for lo in range(0, len(part), ROWS_AT_ONCE):
                few = part.iloc[lo : lo + ROWS_AT_ONCE]
                for total, model in zip(sums, held):
                    fit, x = _volumes(few, column, model.shape)
                    if len(x):
                        noise = _noise(few["key"].to_numpy()[fit], epoch, model.latents)
                        loss, g = loss_and_gradients(model, x, noise, symmetric)
                        total += np.concatenate([[len(x), loss], *[g[n].ravel() for n in model.weights]])
        for k, total in enumerate(sums):
            if total[0]:
                yield pd.DataFrame({"model": k, "i": np.arange(len(total)), "s": total})

    found = rows.select("key", column).mapInPandas(partial, "model int, i int, s double").groupBy("model", "i").agg(F.sum("s").alias("s")).toPandas()
    sent.destroy()
    out = []
    for k, size in enumerate(sizes):
        flat, mine = np.zeros(size), found[found["model"] == k]
        flat[mine["i"].to_numpy()] = mine["s"].to_numpy()
        out.append((int(flat[0]), float(flat[1]), flat[2:]))
    return out


def _adam(model: Model, flat: np.ndarray, rate: float) -> None:
    model.steps += 1
    at = 0
    for name, w in model.weights.items():
        g = flat[at : at + w.size].reshape(w.shape)
        at += w.size
        model.first[name] = 0.9 * model.first[name] + 0.1 * g
        model.second[name] = 0.999 * model.second[name] + 0.001 * g * g
        step = model.first[name] / (1 - 0.9**model.steps) / (np.sqrt(model.second[name] / (1 - 0.999**model.steps)) + 1e-8)
        model.weights[name] = w - rate * step


def train(rows: DataFrame, models: list[Model], epochs: int, batches: int = 1, rate: float = 1e-3, symmetric: bool = True, column: str = "x", save: str | None = None, every: int = 100, seed: int = 42) -> list[tuple[int, int, float]]:
    """Trains the models in place; gives (latents, epoch, mean loss). ``rows``: id and an array ``column`` of a volume in row order.

    An epoch deals the rows anew into ``batches`` parts and takes one step for each, one pass over ``rows`` a step;
    rows should be a table that is cheap to read again. Checkpoints go to ``save`` after every ``every`` epochs.
    """
    keyed = rows.withColumn("key", F.xxhash64(F.lit(seed), "id"))
    history = []
    for _ in range(epochs):
        epoch = models[0].epochs + 1
        seen, lost = np.zeros(len(models)), np.zeros(len(models))
        for b in range(batches):
            part = keyed.filter(F.pmod(F.xxhash64("key", F.lit(epoch)), F.lit(batches)) == b) if batches > 1 else keyed
            for k, (n, loss, flat) in enumerate(_gradient_sums(part, models, epoch, column, symmetric)):
                if n:
                    _adam(models[k], flat / n, rate)
                    seen[k], lost[k] = seen[k] + n, lost[k] + loss
        for k, model in enumerate(models):
            model.epochs = epoch
            history.append((model.latents, epoch, float(lost[k] / seen[k]) if seen[k] else float("nan")))
        if save is not None and epoch % every == 0:
            save_models(rows.sparkSession, models, save)
    return history


def save_models(spark: SparkSession, models: list[Model], path: str) -> None:
    """Adds a checkpoint: Parquet partitioned by latents and epoch, one row per weight array and its moments."""
    rows = [
        (m.latents, m.epochs, m.steps, list(m.shape), name, list(w.shape), w.ravel().tolist(), m.first[name].ravel().tolist(), m.second[name].ravel().tolist())
        for m in models for name, w in m.weights.items()
    ]
    kind = "latents int, epoch int, steps int, shape array<int>, name string, size array<int>, weight array<double>, first array<double>, second array<double>"
    out = spark.createDataFrame(rows, kind).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("latents", "epoch").parquet(path)


def load_model(spark: SparkSession, path: str, latents: int, epoch: int | None = None) -> Model:
    """The checkpoint of an epoch, by default the last one; training goes on from it as if it had not stopped."""
    saved = spark.read.parquet(path).filter(F.col("latents") == latents)
    if epoch is None:
        epoch = saved.agg(F.max("epoch")).first()[0]
    rows = {r["name"]: r for r in saved.filter(F.col("epoch") == epoch).collect()}
    if not rows:
        raise ValueError(f"no checkpoint for {latents} latents, epoch {epoch}")
    # Gradients are flattened in the order in which a new model makes its weights.
    one = next(iter(rows.values()))
    order = [n for k in ("conv1", "conv2", "mean", "logvar", "open", "up1", "up2", "last") for n in (k, f"{k}_bias")]
    parts = [{n: np.array(rows[n][what]).reshape(rows[n]["size"]) for n in order} for what in ("weight", "first", "second")]
    return Model(tuple(one["shape"]), latents, *parts, steps=one["steps"], epochs=epoch)


def _apply(rows: DataFrame, model: Model, column: str, make, fields: str) -> DataFrame:
    """``rows`` with columns made from their volumes; null where there is none."""
    names = [f.split()[0] for f in fields.split(", ")]
    rows = rows.drop(*names)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), ROWS_AT_ONCE):
                few = part.iloc[lo : lo + ROWS_AT_ONCE]
                fit, x = _volumes(few, column, sent.value.shape)
                made = make(sent.value, x) if len(x) else [[] for _ in names]
                cells = {}
                for name, values in zip(names, made):
                    cell = np.full(len(few), None, object)
                    for at, v in zip(np.flatnonzero(fit), values):
                        cell[at] = v
                    cells[name] = cell
                yield few.assign(**cells)

    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [fields])
    return rows.mapInPandas(run, kind)


def encode(rows: DataFrame, model: Model, column: str = "x") -> DataFrame:
    """Adds mu and logvar."""

    def make(m: Model, x: np.ndarray):
        e = _encode(m, x)
        return list(e["mean"]), list(e["logvar"])

    return _apply(rows, model, column, make, "mu array<double>, logvar array<double>")


def reconstruct(rows: DataFrame, model: Model, column: str = "x") -> DataFrame:
    """Adds predicted (the decoded mean, in row order) and its mean squared error."""

    def make(m: Model, x: np.ndarray):
        out = _decode(m, _encode(m, x)["mean"])["out"].reshape(len(x), -1)
        return list(out), ((out - x.reshape(len(x), -1)) ** 2).mean(1).tolist()

    return _apply(rows, model, column, make, "predicted array<double>, mse double")


def traverse(model: Model, z: np.ndarray, moved: int, steps: np.ndarray) -> np.ndarray:
    """(steps, *shape): what decoding gives with latent ``moved`` shifted by each step, less what it gives unshifted."""
    at = np.repeat(np.asarray(z, float)[None], len(steps) + 1, 0)
    at[1:, moved] += steps
    out = _decode(model, at)["out"][:, 0]
    return out[1:] - out[0]
