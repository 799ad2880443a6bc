"""Multichannel series: windows, detrending, connectivity, matrices as edge lists."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epochs(df: DataFrame, size: int, keys: list[str], t: str = "t") -> DataFrame:
    """Adds epoch; an incomplete last one is dropped."""
    e = df.withColumn("epoch", F.floor(F.col(t) / size).cast("int"))
    return e.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "epoch"))).filter(F.col("_n") == size).drop("_n")


def window_count(length, size: int, step: int, compat: bool = True):
    """Sliding windows in ``length`` samples. ``compat`` counts (T - size) // (step + 1) of them, which leaves part of the series out."""
    return F.floor((length - size) / (step + 1 if compat else step)) + (0 if compat else 1)


def sliding(df: DataFrame, size: int, step: int, count, t: str = "t") -> DataFrame:
    """A row per sample and window it is in; windows 0..count-1 (a number or a column) start at win * step. Each sample finds its windows by arithmetic, without a range join."""
    low, high = F.greatest(F.lit(0), F.ceil((F.col(t) - size + 1) / step)), F.least(F.lit(count) - 1, F.floor(F.col(t) / step))
    wins = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("win", F.explode(wins))


def correlations(df: DataFrame, node: str, t: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Edges (i, j, w) with i < j: Pearson correlation of each pair of nodes over t (null for constant series)."""
    by = by or []
    a, b = (df.select(*by, t, F.col(node).alias(n), F.col(value).alias(v)) for n, v in (("i", "x"), ("j", "y")))
    return a.join(b, [*by, t]).filter("i < j").groupBy(*by, "i", "j").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("w"))


def _dense(at: np.ndarray, day: np.ndarray, x: np.ndarray, low: int, high: int, rows: int) -> np.ndarray:
    """Entries of the days low..high-1 as rows x days."""
    inside = (day >= low) & (day < high)
    out = np.zeros((rows, high - low))
    out[at[inside], day[inside] - low] = x[inside]
    return out


def _packed(node: np.ndarray, t: np.ndarray, x: np.ndarray, named: np.ndarray) -> bytes:
    """Entries of a block in order of node and t, in whole numbers as narrow as they fit, compressed; those of ``named`` name a node and are no samples."""
    order = np.lexsort((t, node))
    nodes, at = np.unique(node[order], return_inverse=True)
    sample = ~named[order]
    parts = {"nodes": nodes, "sizes": np.bincount(at[sample], minlength=len(nodes)), "t": t[order][sample], "x": x[order][sample]}
    least = [next(k for k in (np.int8, np.int16, np.int32, np.int64) if not len(p) or (np.iinfo(k).min <= p.min() and p.max() <= np.iinfo(k).max)) for p in parts.values()]
    out = io.BytesIO()
    np.savez_compressed(out, **{name: p.astype(k) for (name, p), k in zip(parts.items(), least)})
    return out.getvalue()


def _entries(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a packed block in ascending order; of its entries the place of their node, t and value."""
    parts = np.load(io.BytesIO(block), allow_pickle=False)
    nodes = parts["nodes"].astype(np.int64)
    return nodes, np.repeat(np.arange(len(nodes)), parts["sizes"]), parts["t"].astype(np.int64), parts["x"].astype(np.float64)


def count_correlations(df: DataFrame, node: str, t: str, value: str, width: int = 4096, entries: int = 1 << 20) -> DataFrame:
    """Edges (i, j, w) with i < j: Pearson correlation of each pair of nodes over the whole numbers t from the first to the last of ``df``; NaN for constant series.

    Nodes and values are whole numbers; a node has at most one row per t, and 0 where it has none. A row with a null t only names its node; null nodes only
    stretch the range of t. Nodes meet in blocks of about ``width`` nodes or ``entries`` rows, as matrix products over the t that they have: neither zeros nor
    pairs of samples become rows. A block is packed before it is copied to its pairs. Sums are of whole numbers around whole numbers near the means, exact
    below 2**53.
    """
    size = df.agg(F.min(t), F.max(t), F.count(t), F.approx_count_distinct(node)).first()
    if size[0] is None:
        kind = df.schema[node].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"i {kind}, j {kind}, w double")
    start, n = size[0], size[1] - size[0] + 1
    blocks = max(1, -(-size[3] // width), -(-size[2] // entries), min(16, -(-size[3] // 64)))
    pairs = blocks * (blocks + 1) // 2

    def pack(block: pa.Table) -> pa.Table:
        when, x = (block.column(c).combine_chunks() for c in ("t", "x"))
        packed = _packed(block.column("node").to_numpy(), when.fill_null(start).to_numpy(zero_copy_only=False) - start, x.fill_null(0).to_numpy(zero_copy_only=False), when.is_null().to_numpy(zero_copy_only=False))
        return pa.table({"block": block.column("block").slice(0, 1), "x": pa.array([packed], pa.binary())})

    def edges(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column("a")[r] == batch.column("b")[r]
                left = _entries(batch.column("x")[r].as_py())
                right = left if own else _entries(batch.column("y")[r].as_py())
                days = np.unique(left[2] if own else np.concatenate([left[2], right[2]]))
                found, side = [], []
                for nodes, at, when, x in (left, right):
                    k, total = np.bincount(at, minlength=len(nodes)), np.bincount(at, x, len(nodes))
                    m = np.rint(total / n)
                    square = np.bincount(at, (x - m[at]) ** 2, len(nodes)) + (n - k) * m * m
                    rest = total - n * m
                    side.append((m, rest, n * square - rest * rest))
                    found.append((at, np.searchsorted(days, when), x))
                (ml, rl, vl), (mr, rr, vr) = side
                slab, step = max(1, (1 << 22) // len(mr)), max(1, (1 << 18) // len(mr))
                for top in range(0, len(ml), slab):
                    rows = slice(top, top + slab)
                    inside = (found[0][0] >= top) & (found[0][0] < top + slab)
                    at, when, x = (f[inside] for f in found[0])
                    dot = (n - len(days)) * np.outer(ml[rows], mr)
                    for low in range(0, len(days), 1024):
                        high = min(low + 1024, len(days))
                        dot += (_dense(at - top, when, x, low, high, len(dot)) - ml[rows, None]) @ (_dense(*found[1], low, high, len(mr)) - mr[:, None]).T
                    for low in range(0, len(dot), step):
                        part = slice(top + low, top + min(low + step, len(dot)))
                        with np.errstate(invalid="ignore", divide="ignore"):
                            w = (n * dot[low : low + step] - np.outer(rl[part], rr)) / np.sqrt(np.outer(vl[part], vr))
                        i, j = np.broadcast_arrays(left[0][part, None], right[0][None])
                        keep = i < j if own else np.ones(w.shape, bool)
                        i, j = i[keep], j[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(w[keep])], ["i", "j", "w"])

    each = df.filter(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("node"), F.col(t).cast("long").alias("t"), F.col(value).cast("long").alias("x"))
    block = each.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, x binary")
    a = block.select(F.col("block").alias("a"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("b"), "x")
    b = block.select(F.explode(F.sequence(F.lit(0), "block")).alias("a"), F.col("block").alias("b"), F.col("x").alias("y"))
    b = b.withColumn("y", F.when(F.col("a") != F.col("b"), F.col("y")))
    tasks = min(pairs, 2000)
    met = a.repartition(tasks, "a", "b").join(b.repartition(tasks, "a", "b"), ["a", "b"])
    kind = df.schema[node].dataType
    return met.mapInArrow(edges, "i long, j long, w double").select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "w")


def shrunk_correlations(df: DataFrame, by: list[str], node: str, t: str, value: str) -> DataFrame:
    """by, i, j, w with i < j: correlations from the covariance shrunk towards a multiple of the identity (Ledoit and Wolf).

    Every node has the same samples t. The shrinkage of a group follows from sums over its edges and samples alone.
    """
    means = df.groupBy(*by, node).agg(F.avg(value).alias("_m"))
    x = df.join(means, [*by, node]).select(*by, F.col(t).alias("_t"), F.col(node).alias("_node"), (F.col(value) - F.col("_m")).alias("_x"))
    a, b = (x.select(*by, "_t", F.col("_node").alias(n), F.col("_x").alias(v)) for n, v in (("_i", "_a"), ("_j", "_b")))
    cov = a.join(b, [*by, "_t"]).filter("_i <= _j").groupBy(*by, "_i", "_j").agg(F.avg(F.col("_a") * F.col("_b")).alias("_s"))
    fourth = x.groupBy(*by, "_t").agg(F.sum(F.col("_x") * F.col("_x")).alias("_q")).groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.col("_q") * F.col("_q")).alias("_fourth"))
    own, s, p = F.col("_i") == F.col("_j"), F.col("_s"), F.col("_p")
    sums = cov.groupBy(*by).agg(F.sum(F.when(own, s)).alias("_trace"), F.sum(s * s * F.when(own, 1).otherwise(2)).alias("_squares"), F.count(F.when(own, 1)).alias("_p"))
    mu = F.col("_trace") / p
    delta = (F.col("_squares") - mu * F.col("_trace")) / p
    beta = F.least((F.col("_fourth") / F.col("_n") - F.col("_squares")) / (p * F.col("_n")), delta)
    level = sums.join(fourth, by).select(*by, mu.alias("_mu"), F.when(beta > 0, beta / delta).otherwise(0.0).alias("_k"))
    var = cov.filter(own).select(*by, F.col("_i").alias("_node"), s.alias("_v"))
    e = cov.filter("_i < _j").join(level, by)
    for n in ("_i", "_j"):
        e = e.join(var.withColumnRenamed("_node", n).withColumnRenamed("_v", f"_v{n}"), [*by, n])
    kept, added = 1 - F.col("_k"), F.col("_k") * F.col("_mu")
    scale = F.sqrt((kept * F.col("_v_i") + added) * (kept * F.col("_v_j") + added))
    return e.select(*by, F.col("_i").alias("i"), F.col("_j").alias("j"), F.try_divide(kept * s, scale).alias("w"))


def mix_components(sources: DataFrame, mixing: DataFrame, excluded: DataFrame) -> DataFrame:
    """channel, t, value: sources (component, t, value) through mixing (channel, component, weight) without the excluded components."""
    kept = mixing.join(excluded.select("component"), "component", "left_anti")
    return sources.join(kept, "component").groupBy("channel", "t").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def _beside(df: DataFrame, keys: list[str], **sums) -> DataFrame:
    """Adds aggregates of each row's group; groups are summed map-side, and no task buffers a series."""
    totals = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[c.alias(n) for n, c in sums.items()])
    on = [df[k].eqNullSafe(totals[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(totals, on).drop(*[f"_k{i}" for i in range(len(keys))])


def detrend(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Value minus its least-squares line in t, per series."""
    x = _beside(df, keys, _a=F.regr_intercept(value, t), _b=F.regr_slope(value, t))
    return x.withColumn("residual", F.col(value) - (F.col("_a") + F.col("_b") * F.col(t))).drop("_a", "_b")


def zscore(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    x = _beside(df, keys, _a=F.avg(value), _b=F.stddev_samp(value))
    return x.withColumn("z", F.try_divide(F.col(value) - F.col("_a"), F.col("_b"))).drop("_a", "_b")


def p2p(df: DataFrame) -> DataFrame:
    """channel, epoch, p2p: peak-to-peak of each epoch."""
    return df.groupBy("channel", "epoch").agg((F.max("value") - F.min("value")).alias("p2p"))


def p2p_levels(df: DataFrame, levels: list[float]) -> DataFrame:
    """channel, threshold: quantiles of the channel's peak-to-peak, one row per level."""
    return p2p(df).groupBy("channel").agg(F.percentile("p2p", F.array(*[F.lit(float(x)) for x in levels])).alias("q")).select("channel", F.explode("q").alias("threshold"))


def p2p_thresholds(df: DataFrame, levels: list[float], folds: int = 5) -> DataFrame:
    """channel, threshold: the peak-to-peak limit per channel, by cross-validation over epochs; columns channel, epoch, t_in, value.

    Candidates are the channel's own quantiles at ``levels``. A candidate's loss is the distance between the mean of the other folds' epochs within the limit and the median of
    the held-out epochs, averaged over folds; a fold without epochs to average counts as infinite. Ties go to the lower limit.
    """
    x = df.join(p2p(df), ["channel", "epoch"]).withColumn("_fold", F.pmod("epoch", F.lit(folds)))
    tried = x.join(p2p_levels(df, levels).distinct(), "channel").filter("p2p <= threshold")
    parts = tried.groupBy("channel", "threshold", "t_in", "_fold").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    total = parts.groupBy("channel", "threshold", "t_in").agg(F.sum("_s").alias("_all"), F.sum("_n").alias("_m"))
    held = x.groupBy("channel", "t_in", "_fold").agg(F.percentile("value", 0.5).alias("_median"))
    pairs = held.join(total, ["channel", "t_in"]).join(parts, ["channel", "threshold", "t_in", "_fold"], "left")
    mean = F.try_divide(F.col("_all") - F.coalesce("_s", F.lit(0.0)), F.col("_m") - F.coalesce("_n", F.lit(0)))
    off = F.coalesce(F.pow(mean - F.col("_median"), F.lit(2)), F.lit(float("inf")))
    loss = pairs.groupBy("channel", "threshold", "_fold").agg(F.sqrt(F.avg(off)).alias("_l")).groupBy("channel", "threshold").agg(F.avg("_l").alias("_l"))
    return loss.groupBy("channel").agg(F.min_by("threshold", F.struct("_l", "threshold")).alias("threshold"))


def repair(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds repaired; values of epochs beyond their channel's limit become the mean of the channels within theirs at that time.

    Where no channel is within its limit the value is null. Channels without a limit stay as they are.
    """
    bad = p2p(df).join(limits, "channel", "left").select("channel", "epoch", F.coalesce(F.col("p2p") > F.col("threshold"), F.lit(False)).alias("repaired"))
    x = df.join(bad, ["channel", "epoch"])
    good = x.filter("not repaired").groupBy("epoch", "t_in").agg(F.avg("value").alias("_good"))
    return x.join(good, ["epoch", "t_in"], "left").withColumn("value", F.when(F.col("repaired"), F.col("_good")).otherwise(F.col("value"))).drop("_good")


def resample_affine(voxels: DataFrame, matrix: list[list[float]], shape: tuple[int, int, int]) -> DataFrame:
    """x, y, z, value on a grid of ``shape``: the nearest voxel (x, y, z, value) under a 3x4 affine from grid to voxels; 0 outside."""
    nx, ny, nz = shape
    grid = voxels.sparkSession.range(nx * ny * nz)
    grid = grid.select((F.col("id") % nx).cast("int").alias("x"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("y"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("z"))
    at = [F.floor(F.lit(float(a)) * F.col("x") + F.lit(float(b)) * F.col("y") + F.lit(float(c)) * F.col("z") + float(d) + 0.5).cast("int") for a, b, c, d in matrix]
    source = voxels.select(*[F.col(n).cast("int").alias(f"_{n}") for n in "xyz"], "value")
    placed = grid.select("x", "y", "z", *[c.alias(f"_{n}") for c, n in zip(at, "xyz")])
    return placed.join(source, ["_x", "_y", "_z"], "left").select("x", "y", "z", F.coalesce("value", F.lit(0).cast(voxels.schema["value"].dataType)).alias("value"))


def clean(df: DataFrame, keys: list[str], rate: float, low: float, high: float) -> DataFrame:
    """Series (t, value) without their lines, as z-scores, within [low, high]; constant series are 0."""
    flat = detrend(df, keys, "t", "value").drop("value")
    scaled = zscore(flat, keys, "residual").withColumn("value", F.coalesce("z", F.lit(0.0)))
    return band_pass(scaled.select(*keys, "t", "value"), keys, rate, low, high)


def intensity_mask(df: DataFrame, keys: list[str], value: str, lower: float = 0.2, upper: float = 0.85) -> DataFrame:
    """Adds inside: value above the middle of the widest gap between neighbouring intensities of an image.

    The gap lies between two quantiles; of equally wide ones the lowest counts. An image without a gap
    (one intensity there) has nothing inside; a null value is outside.
    """
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(lower), F.lit(upper))).alias("q"))
    levels = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")).join(q, keys).filter(F.col("_v").between(F.col("q")[0], F.col("q")[1]))
    gaps = levels.withColumn("_up", F.lead("_v").over(Window.partitionBy(*keys).orderBy("_v"))).filter("_up is not null")
    best = gaps.groupBy(*keys).agg(F.max(F.struct((F.col("_up") - F.col("_v")).alias("gap"), (-F.col("_v")).alias("low"), "_up")).alias("x"))
    cut = best.select(*keys, ((F.col("x._up") - F.col("x.low")) / 2).alias("_cut"))
    return df.join(cut, keys, "left").withColumn("inside", F.coalesce(F.col(value) > F.col("_cut"), F.lit(False))).drop("_cut")


def symmetrize(edges: DataFrame) -> DataFrame:
    """w(i, j) + w(j, i): one union and sum, no self-join."""
    return edges.select("i", "j", "w").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))


def _per_series(kernel):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return kernel(pdf)

    return run


def band_pass(df: DataFrame, keys: list[str], rate: float, low: float, high: float) -> DataFrame:
    """Keeps frequencies in [low, high] of each series (t, value), by FFT; a notch is the rest of a narrow band."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        spectrum = np.fft.rfft(pdf["value"].to_numpy())
        f = np.fft.rfftfreq(len(pdf), 1 / rate)
        spectrum[(f < low) | (f > high)] = 0
        return pdf.assign(value=np.fft.irfft(spectrum, len(pdf)))

    return df.groupBy(*keys).applyInPandas(_per_series(kernel), df.schema)


def notch(df: DataFrame, keys: list[str], rate: float, at: float, width: float = 1.0) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        spectrum = np.fft.rfft(pdf["value"].to_numpy())
        f = np.fft.rfftfreq(len(pdf), 1 / rate)
        spectrum[np.abs(f - at) <= width / 2] = 0
        return pdf.assign(value=np.fft.irfft(spectrum, len(pdf)))

    return df.groupBy(*keys).applyInPandas(_per_series(kernel), df.schema)


def resample(df: DataFrame, keys: list[str], rate: float, to: float) -> DataFrame:
    """Fourier resampling of each series (t is a sample number) to another rate."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["value"].to_numpy()
        n = max(1, round(len(x) * to / rate))
        spectrum = np.fft.rfft(x)
        keep = np.zeros(n // 2 + 1, complex)
        m = min(len(keep), len(spectrum))
        keep[:m] = spectrum[:m]
        # The bin at half of the lower rate stands for both signs of its frequency there, and for one at the higher rate.
        half = min(n, len(x))
        if half % 2 == 0 and n != len(x):
            keep[half // 2] *= 2 if n < len(x) else 0.5
        out = np.fft.irfft(keep, n) * n / len(x)
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**head, "t": np.arange(n), "value": out})[list(pdf.columns)]

    return df.groupBy(*keys).applyInPandas(_per_series(kernel), df.schema)


def coherence(df: DataFrame, keys: list[str], rate: float, bands: dict[str, tuple[float, float]], tapers: int = 4) -> DataFrame:
    """keys, band, i, j, w: multitaper (sine tapers) coherence of channels over epochs, averaged per band; columns epoch, channel, t, value.

    Only epochs that every channel of the group has in full count; without any, the group gives no rows.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, n = sorted(pdf["channel"].unique()), int(pdf["t_in"].max())
        cells = pd.MultiIndex.from_product([names, range(1, n + 1)])
        cube = pdf.pivot_table(index="epoch", columns=["channel", "t_in"], values="value").reindex(columns=cells).dropna()
        x = cube.to_numpy().reshape(-1, len(names), n)
        if not len(x):
            return pd.DataFrame({c: np.array([], dtype=object) for c in [*keys, "band", "i", "j", "w"]}, dtype=object)
        taper = np.sqrt(2 / (n + 1)) * np.sin(np.pi * np.outer(np.arange(1, tapers + 1), np.arange(1, n + 1)) / (n + 1))
        s = np.fft.rfft((x - x.mean(2, keepdims=True))[:, None] * taper[None, :, None], axis=-1)
        cross = np.einsum("etif,etjf->ijf", s, s.conj())
        power = np.einsum("iif->if", cross).real
        coh = np.abs(cross) / np.sqrt(np.maximum(power[:, None] * power[None], 1e-300))
        f, out = np.fft.rfftfreq(n, 1 / rate), []
        for band, (lo, hi) in bands.items():
            pick = (f >= lo) & (f <= hi)
            if pick.any():
                w = coh[:, :, pick].mean(2)
                out += [(band, names[i], names[j], float(w[i, j])) for i in range(len(names)) for j in range(i)]
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame(out, columns=["band", "i", "j", "w"]).assign(**head)[[*keys, "band", "i", "j", "w"]]

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "band string", f"i {types['channel']}", f"j {types['channel']}", "w double"])
    inside = df.withColumn("t_in", F.row_number().over(Window.partitionBy(*keys, "epoch", "channel").orderBy("t")))
    return inside.groupBy(*keys).applyInPandas(kernel, schema)


def fast_ica(df: DataFrame, keys: list[str], components: int, iterations: int = 100, seed: int = 97) -> DataFrame:
    """keys, component, t, value: independent components of channels (columns channel, t, value) per subject."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="channel", columns="t", values="value").fillna(0)
        x = wide.to_numpy() - wide.to_numpy().mean(1, keepdims=True)
        k = min(components, len(x))
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        white = (u[:, :k] / np.maximum(s[:k], 1e-12)).T @ x * np.sqrt(x.shape[1])
        w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
        for _ in range(iterations):
            g = np.tanh(w @ white)
            a, _, b = np.linalg.svd(g @ white.T / white.shape[1] - np.diag((1 - g * g).mean(1)) @ w)
            w = a @ b
        out = w @ white
        head = {c: pdf[c].iloc[0] for c in keys}
        i, j = np.indices(out.shape)
        return pd.DataFrame({"component": i.ravel(), "t": wide.columns.to_numpy()[j.ravel()], "value": out.ravel()}).assign(**head)[[*keys, "component", "t", "value"]]

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "component int", f"t {types['t']}", "value double"])
    return df.groupBy(*keys).applyInPandas(kernel, schema)
