"""Every registered query with SQL gives the rows of its SQL on DuckDB, and kernels give known answers."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenweft.functions.distributions import t_two_sided_p
from lumenweft.operators import autoencoder, canonical, cohort, latent, search, series
from lumenweft.plans import all_oracles, all_queries
from lumenweft.sources import tables
from lumenweft.streaming.windows import tumbling_mean

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_sql(spark, duck, name):
    got, want = all_queries()[name](spark, DIR), duck.sql(all_oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_runs(spark, name):
    assert all_queries()[name](spark, "/root/testdata/sf0.01").count() > 0


@pytest.mark.parametrize("t, df, p", [(2.0, 10, 0.0733880), (2.5, 7, 0.0409922), (12.7062, 1, 0.05)])
def test_t_p_value(spark, t, df, p):
    got = spark.range(1).select(t_two_sided_p(F.lit(t), F.lit(df)).alias("p")).first().p
    assert got == pytest.approx(p, abs=1e-6)


def test_benjamini_hochberg(spark):
    x = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "p double")
    assert [round(r.q, 9) for r in cohort.benjamini_hochberg(x, "p").orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]


def test_benjamini_hochberg_with_ties_nulls_and_many_ranges(spark):
    r = np.random.default_rng(3)
    p = [float(x) for x in np.round(r.random(500) ** 3, 2)]
    m, order = len(p), np.sort(p)
    tail = np.minimum.accumulate((order * m / np.arange(1, m + 1))[::-1])[::-1]
    want = {float(x): min(1.0, float(tail[np.searchsorted(order, x)])) for x in p}
    x = spark.createDataFrame([(v,) for v in p] + [(None,), (float("nan"),)], "p double")
    for ranges in (1, 7, 256):
        got = cohort.benjamini_hochberg(x, "p", ranges).collect()
        assert len(got) == m + 2 and sum(g.q is None for g in got) == 2
        assert all(g.q == pytest.approx(want[g.p], abs=1e-12) for g in got if g.q is not None)
    assert cohort.benjamini_hochberg(x.limit(0), "p").count() == 0


def test_window_counts(spark):
    x = spark.createDataFrame([(100,)], "n int")
    assert x.select(series.window_count(F.col("n"), 10, 1), series.window_count(F.col("n"), 10, 1, False)).first()[:] == (45, 91)


def test_detrend(spark):
    x = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.0, 3.0), (0, 2.0, 4.0)], "k int, t double, v double")
    assert [r.residual for r in series.detrend(x, ["k"], "t", "v").orderBy("t").collect()] == pytest.approx([-1 / 6, 1 / 3, -1 / 6])


def test_symmetrize(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "i int, j int, w double")
    assert [r.w for r in series.symmetrize(x).orderBy("i", "j").collect()] == [2, 5, 5, 8]


def test_constant_series_has_no_correlation(spark):
    x = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 2.0), ("b", 1, 3.0)], "n string, t int, v double")
    assert series.correlations(x, "n", "t", "v").first().w is None


def test_utf16_questionnaire(spark, tmp_path):
    (tmp_path / "c.csv").write_text("subject_id,field_name,field_value\nS1,AGE,7\nS2,AGE,9\n", encoding="utf-16")
    rows = tables.questionnaires(spark, str(tmp_path), "subject_id string, field_name string, field_value string").collect()
    assert sorted(map(tuple, rows)) == [("S1", "AGE", "7"), ("S2", "AGE", "9")]


def test_npy(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert sorted((r.i, r.j, r.value) for r in tables.npy_arrays(spark, str(tmp_path)).collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]


def test_band_pass_keeps_its_band(spark):
    t = np.arange(200)
    v = np.sin(2 * np.pi * 5 * t / 100) + np.sin(2 * np.pi * 20 * t / 100)
    x = spark.createDataFrame(pd.DataFrame({"k": 0, "t": t, "value": v}))
    got = series.band_pass(x, ["k"], 100.0, 1.0, 10.0).orderBy("t").toPandas()["value"]
    assert np.allclose(got, np.sin(2 * np.pi * 5 * t / 100), atol=1e-9)


def _two_signals():
    r = np.random.default_rng(0)
    z, x, y = r.normal(size=(300, 2)), r.normal(size=(300, 5)), r.normal(size=(300, 4))
    x[:, 2] += 3 * z[:, 0]
    y[:, 1] -= 3 * z[:, 0]
    x[:, 4] += 1.5 * z[:, 1]
    y[:, 3] += 1.5 * z[:, 1]
    return x + 7, y * 10


def test_sparse_pairs_find_the_shared_signals(spark):
    """Weights on the signals alone; scores and loadings as from the projections; odd rows take no part."""
    x, y = _two_signals()
    odd = [(300, None, [1.0] * 4), (301, [1.0], [1.0] * 4), (302, [float("nan")] * 5, [1.0] * 4)]
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))] + odd, "id int, x array<double>, y array<double>").repartition(3)
    model = canonical.fit(rows, 5, 4, 0.3, 0.9, 2)
    assert np.abs(model.weights_x).argmax(0).tolist() == [2, 4] and np.abs(model.weights_y).argmax(0).tolist() == [1, 3]
    assert (np.abs(model.weights_x[[0, 1, 3]]) < 1e-9).all()
    got = {g.id: (g.u, g.v) for g in canonical.project(rows, model).collect()}
    u, v = (np.array([got[i][k] for i in range(300)]) for k in (0, 1))
    assert got[300][0] is None and got[301][0] is None and got[302][0] is None and got[300][1] is not None
    for d in (0, 1):
        assert model.score[d] == pytest.approx(np.corrcoef(u[:, d], v[:, d])[0, 1], abs=1e-9)
        assert np.allclose(model.loadings_x[:, d], [np.corrcoef(x[:, i], u[:, d])[0, 1] for i in range(5)], atol=1e-9)
    grid = canonical.grid_search(rows, 5, 4, [0.1, 0.9], [0.1, 0.9], [1, 2], 3).collect()
    assert len(grid) == 8 and max(g.score for g in grid) > 0.8
    none = canonical.fit(rows.limit(0), 5, 4, 0.1, 0.1, 2)
    assert not none.weights_x.any() and not none.score.any()


def test_cost_search_nears_the_least(spark):
    out = search.one_plus_one(spark, {"a": (0.0, 4.0), "b": (-1.0, 1.0)}, lambda p: (p["a"] - 3) ** 2 + p["b"] ** 2 if p["a"] > 0.5 else float("nan"), 15, 4).toPandas()
    assert len(out) == 60 and out["cost"].min() < 0.1 < out["cost"].iloc[0]
    assert out[out["best"]]["cost"].is_monotonic_decreasing and out[out["best"]]["cost"].iloc[-1] == out["cost"].min()


def test_layers_survive_their_table(spark, tmp_path):
    r = np.random.default_rng(1)
    layers = [(r.normal(size=(3, 5)), r.normal(size=3)), (r.normal(size=(2, 3)), r.normal(size=2))]
    latent.layers_table(spark, layers).write.parquet(str(tmp_path / "w"))
    back = latent.read_layers(spark.read.parquet(str(tmp_path / "w")))
    assert all(np.array_equal(a, b) for one, two in zip(layers, back) for a, b in zip(one, two))
    x = r.normal(size=(4, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(4, None)], "id int, x array<double>")
    got = {g.id: g.out for g in latent.forward(rows, back, [F.tanh, None], "x", "out").collect()}
    want = np.tanh(x @ layers[0][0].T + layers[0][1]) @ layers[1][0].T + layers[1][1]
    assert np.allclose([got[i] for i in range(4)], want) and got[4] is None


def test_nifti(spark, tmp_path):
    """Both byte orders, plain and gzipped, scaled, with a time axis."""
    import gzip
    import struct

    a = np.arange(24, dtype=np.int16).reshape(2, 3, 2, 2)
    for name, order in (("a.nii", "<"), ("b.nii.gz", ">")):
        head = bytearray(352)
        head[0:4], head[40:56], head[70:72] = struct.pack(f"{order}i", 348), struct.pack(f"{order}8h", 4, 2, 3, 2, 2, 1, 1, 1), struct.pack(f"{order}h", 4)
        head[108:120] = struct.pack(f"{order}3f", 352, 2, 1)
        data = bytes(head) + a.astype(f"{order}i2").tobytes(order="F")
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    got = tables.nifti_voxels(spark, str(tmp_path)).collect()
    assert len(got) == 48 and all(g.value == 2 * a[g.x, g.y, g.z, g.t] + 1 for g in got)
    with pytest.raises(ValueError):
        list(tables.nifti_volumes(b"no image"))


def test_rank_block(spark):
    r = np.random.default_rng(4)
    x = pd.DataFrame({"id": range(60), "a": r.integers(0, 9, 60).astype(float), "b": r.normal(size=60), "c": 1.0})
    x["d"] = x["a"] * 2 + r.normal(size=60)
    rows = spark.createDataFrame([*x.itertuples(index=False, name=None), (60, None, 1.0, 1.0, 1.0)], "id int, a double, b double, c double, d double")
    got = {(g.left, g.right): g for g in cohort.spearman_block(rows, "id", ["a", "c"], ["b", "d", "a"]).collect()}
    assert got["a", "d"].rho == pytest.approx(x["a"].rank().corr(x["d"].rank())) and got["a", "d"].n == 60
    assert got["a", "d"].p < 1e-6 < got["a", "b"].p <= 1 and got["c", "b"].rho is None and got["c", "b"].p is None and got["a", "a"].p == 0
    empty = cohort.spearman_block(rows.limit(0), "id", ["a"], ["b"]).first()
    assert (empty.n, empty.rho, empty.p) == (0, None, None)


def test_rank_block_signs_and_long_series(spark, tmp_path):
    """A rho that rounds to zero keeps its sign, as in the SQL; p beyond the 9999 terms of the SQL is that of the t density."""
    r, n = np.random.default_rng(6), 300
    key, balance = np.arange(n), np.random.default_rng(7).permutation(n)
    off = lambda b: 4 * (key * b).sum() - n * (n - 1) ** 2
    while off(balance) != -4:  # a rank correlation of -4.4e-7, the nearest to 0
        i, j = r.integers(0, n, 2)
        swapped = balance.copy()
        swapped[[i, j]] = balance[[j, i]]
        if abs(off(swapped) + 4) <= max(400, abs(off(balance) + 4)):
            balance = swapped
    (tmp_path / "t").mkdir()
    pd.DataFrame({"s_suppkey": key, "s_nationkey": r.integers(0, 25, n), "s_acctbal": balance * 1.5}).to_parquet(str(tmp_path / "t" / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{tmp_path}/t/supplier.parquet'")
    rows = sorted(map(str, map(tuple, all_queries()["spearman_block"](spark, str(tmp_path / "t")).collect())))
    assert rows == sorted(map(str, con.sql(all_oracles()["spearman_block"]).fetchall())) and any("-0.0," in x for x in rows)
    t, df = 0.3, 59998
    h = np.linspace(0, t, 20001)
    f = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(h * h / df))
    want = 1 - 2 * t / 60000 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    assert spark.range(1).select(t_two_sided_p(F.lit(t), F.lit(df))).first()[0] == pytest.approx(want, abs=1e-8)


def test_repair(spark):
    """A wild channel takes the others' mean where it is wild; alone it has nothing to take."""
    cells = [(c, e, t, 1000.0 * t if (c, e) == ("w", 1) else float(t + k)) for k, c in enumerate("uvw") for e in (0, 1) for t in range(3)]
    x = spark.createDataFrame(cells, "channel string, epoch int, t_in int, value double")
    limits = spark.createDataFrame([(c, 10.0) for c in "uvw"], "channel string, threshold double")
    got = {(g.channel, g.epoch, g.t_in): (g.repaired, g.value) for g in series.repair(x, limits).collect()}
    assert len(got) == 18 and all(got["w", 1, t] == (True, t + 0.5) for t in range(3)) and got["w", 0, 1] == (False, 3.0)
    alone = series.repair(x.filter("channel = 'w'"), limits).filter("repaired").collect()
    assert len(alone) == 3 and all(g.value is None for g in alone)


def test_sparse_components_drop_noise():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 6)) * 0.1
    x[:, :2] += r.normal(size=(200, 1)) * 3
    v = latent.sparse_components(x, 1, 5.0)[0]
    assert (v[2:] == 0).all() and (v[:2] != 0).all()


def test_sparse_pca_from_cross_products(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 6)) * 0.1 + 5
    x[:, :2] += r.normal(size=(200, 1)) * 3
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(200, None), (201, [1.0]), (202, [float("nan")] * 6)], "id int, x array<double>").repartition(3)
    got = {g.id: g.pc for g in latent.sparse_pca(rows, 6, 2, 5.0).collect()}
    want = (x - x.mean(0)) @ latent.sparse_components(x, 2, 5.0).T
    assert np.allclose([got[i] for i in range(200)], want, atol=1e-6) and all(got[i] is None for i in (200, 201, 202))


def test_intensity_mask_cuts_at_the_gap(spark):
    x = spark.createDataFrame([("a", float(i)) for i in [*range(10), *range(30, 40)]] + [("a", None), ("flat", 1.0), ("flat", 1.0)], "image string, v double")
    got = series.intensity_mask(x, ["image"], "v").collect()
    assert sorted(g.v for g in got if g.inside) == list(range(30, 40)) and len(got) == 23


def test_clean_series(spark):
    t = np.arange(200)
    v = 3.0 * t + 2 * np.sin(2 * np.pi * 5 * t / 100) + 0.5 * np.cos(2 * np.pi * 30 * t / 100)
    got = series.clean(spark.createDataFrame(pd.DataFrame({"k": 0, "t": t, "value": v})), ["k"], 100.0, 1.0, 10.0).orderBy("t").toPandas()["value"]
    flat = v - np.polyval(np.polyfit(t, v, 1), t)
    spectrum, f = np.fft.rfft((flat - flat.mean()) / flat.std(ddof=1)), np.fft.rfftfreq(200, 0.01)
    assert np.allclose(got, np.fft.irfft(np.where((f >= 1) & (f <= 10), spectrum, 0), 200), atol=1e-6)


def spectra(x, tapers=4):
    n = x.shape[1]
    w = [np.sqrt(2 / (n + 1)) * np.sin(np.pi * k * np.arange(1, n + 1) / (n + 1)) for k in range(1, tapers + 1)]
    return [np.fft.rfft((row - row.mean()) * t) for row in x for t in w]


def test_coherence_of_ragged_epochs(spark):
    """Epochs that a channel lacks, or has in part, count for none; the others pair by epoch."""
    r = np.random.default_rng(4)
    x = r.normal(size=(3, 6, 20))
    x[1] += x[0]
    gone = {(0, 1), (1, 3), (2, 3)}
    rows = [(s, e, c, e * 20 + t, float(x[c, e, t])) for s in (0, 1) for c in range(3) for e in range(6) for t in range(20) if s or (c, e) not in gone]
    rows = [y for y in rows if not (y[0] == 0 and y[1] == 4 and y[2] == 1 and y[3] % 20 > 15)]
    df = spark.createDataFrame(rows, "subject int, epoch int, channel int, t int, value double").repartition(4)
    got = {(g.subject, g.i, g.j): g.w for g in series.coherence(df, ["subject"], 20.0, {"all": (2.0, 8.0)}).collect()}
    f = np.fft.rfftfreq(20, 1 / 20)
    pick = (f >= 2) & (f <= 8)
    for s, kept in ((0, [0, 2, 5]), (1, range(6))):
        z = [np.array(spectra(x[c][list(kept)])) for c in range(3)]
        for i in range(3):
            for j in range(i):
                w = np.abs((z[i] * z[j].conj()).sum(0)) / np.sqrt((np.abs(z[i]) ** 2).sum(0) * (np.abs(z[j]) ** 2).sum(0))
                assert got[s, i, j] == pytest.approx(w[pick].mean(), abs=1e-9)
    assert series.coherence(df.filter("channel = 0 or epoch = 1"), ["subject"], 20.0, {"all": (2.0, 8.0)}).filter("subject = 0").count() == 0


def test_notch_and_resample(spark):
    """A notch takes its frequency and leaves the others; a resampled sine is the sine at the new rate, at its Nyquist bin as well."""
    t = np.arange(200)
    wave = lambda f, rate, n: np.cos(2 * np.pi * f * np.arange(n) / rate)
    x = spark.createDataFrame(pd.DataFrame({"k": 0, "t": t, "value": wave(5, 100, 200) + wave(20, 100, 200)}))
    assert np.allclose(series.notch(x, ["k"], 100.0, 20.0).orderBy("t").toPandas()["value"], wave(5, 100, 200), atol=1e-9)
    for to, n in ((50.0, 100), (150.0, 300), (40.0, 80)):
        got = series.resample(x, ["k"], 100.0, to).orderBy("t").toPandas()["value"]
        want = wave(5, to, n) + (wave(20, to, n) if to >= 40 else 0)
        assert np.allclose(got, want, atol=1e-9), to


def test_independent_components_are_found(spark):
    t = np.arange(600)
    s = np.stack([np.sign(np.sin(t / 7)), (t % 37) / 37 - 0.5])
    x = np.array([[1.0, 0.5], [0.3, -1.0], [0.8, 0.2]]) @ (s - s.mean(1, keepdims=True))
    rows = spark.createDataFrame([(0, c, int(k), float(x[c, k])) for c in range(3) for k in t], "subject int, channel int, t int, value double")
    got = series.fast_ica(rows, ["subject"], 2).toPandas().pivot(index="component", columns="t", values="value").to_numpy()
    match = np.abs(np.corrcoef(np.concatenate([got, s]))[:2, 2:])
    assert (match.max(0) > 0.98).all() and (match.max(1) > 0.98).all()


def test_clusters_and_components_of_the_latents(spark):
    folder = "/root/testdata/sf0.01"
    e = tables.table(spark, folder, "embeddings").toPandas().sort_values("vec_id")
    x = np.stack(e["embedding"]).astype(float)
    cluster = all_queries()["kmeans_groups"](spark, folder).toPandas().sort_values("vec_id")["cluster"].to_numpy()
    centres = np.stack([x[cluster == k].mean(0) for k in range(3)])
    near = ((x[:, None] - centres) ** 2).sum(2)
    assert (near.argmin(1) == cluster).mean() > 0.95 and near.min(1).sum() < ((x - x.mean(0)) ** 2).sum()
    pc = np.stack(all_queries()["pca_2d"](spark, folder).toPandas().sort_values("vec_id")["pc"])
    flat = x - x.mean(0)
    want = flat @ np.linalg.svd(flat, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(pc), np.abs(want), atol=1e-4)


def test_ranks_with_ties_nulls_and_many_ranges(spark):
    r = np.random.default_rng(6)
    rows = [("a" if i % 3 else None, float(x)) for i, x in enumerate(np.round(r.random(300), 2))] + [("a", None), (None, None)]
    x = spark.createDataFrame(rows, "g string, v double")
    want = pd.DataFrame(rows, columns=["g", "v"]).fillna({"g": "none"}).assign(r=lambda f: f.groupby("g")["v"].rank())
    for ranges in (1, 5, 256):
        got = cohort.average_rank(x, ["g"], "v", "r", ranges).toPandas().fillna({"g": "none"})
        a, b = (f[["g", "v", "r"]].sort_values(["g", "v"]).reset_index(drop=True) for f in (got, want))
        pd.testing.assert_frame_equal(a, b)


def test_shrunk_correlations(spark):
    """Against the estimator's formula in matrices."""
    r = np.random.default_rng(7)
    x = r.normal(size=(30, 5)) @ r.normal(size=(5, 5))
    rows = spark.createDataFrame([(0, c, t, float(x[t, c])) for t in range(30) for c in range(5)], "s int, c int, t int, v double")
    z = x - x.mean(0)
    cov, n, p = z.T @ z / 30, 30, 5
    mu, d2 = np.trace(cov) / p, (cov**2).sum() - np.trace(cov) ** 2 / p
    b2 = sum(((np.outer(row, row) - cov) ** 2).sum() for row in z) / n**2
    k = min(b2, d2) / d2
    s = (1 - k) * cov + k * mu * np.eye(p)
    got = {(g.i, g.j): g.w for g in series.shrunk_correlations(rows, ["s"], "c", "t", "v").collect()}
    assert 0 < k < 1 and all(got[i, j] == pytest.approx(s[i, j] / np.sqrt(s[i, i] * s[j, j])) for i in range(p) for j in range(i + 1, p))


def largest_join(plan):
    """Rows out of the largest join of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return largest_join(plan.executedPlan())
    if name.endswith("QueryStage"):
        return largest_join(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if name.endswith("Join") else 0
    return max([own, *(largest_join(plan.children().apply(i)) for i in range(plan.children().size()))])


def test_spike_counts_meet_in_blocks(spark, tmp_path):
    """The rows of the SQL where neurons are null, constant or without times and days far apart; samples of a pair never become rows."""
    r = np.random.default_rng(8)
    spikes = [(int(u), f"2024-01-{d + 1:02d} 05:00:00") for u in range(-60, 60) for d in range(20) for _ in range(r.poisson(1.5))]
    spikes += [(500, None), (None, "2023-12-30 01:00:00"), (None, None), (501, "2024-02-11 23:59:59")] + [(502, str(d)) for d in pd.date_range("2023-12-30", "2024-02-11")]
    (tmp_path / "t").mkdir()
    x = pd.DataFrame(spikes, columns=["user_id", "ts"]).astype({"user_id": "Int64", "ts": "datetime64[us]"})
    x.to_parquet(str(tmp_path / "t" / "events.parquet"))
    got = all_queries()["spike_corr"](spark, str(tmp_path / "t"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/t/events.parquet'")
    rows = got.collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, con.sql(all_oracles()["spike_corr"]).fetchall())) and len(rows) == 123 * 122 // 2
    assert largest_join(got._jdf.queryExecution().executedPlan()) < len(rows)


def test_count_correlations(spark):
    """Blocks and slices of days don't change results; large counts keep their digits; no rows give none."""
    r = np.random.default_rng(9)
    k = r.poisson(0.4, (40, 2500)) * r.integers(1, 5, (40, 1))
    k[0] += 10_000_000
    k[:, [0, -1]] = 1
    rows = spark.createDataFrame([(int(i), int(t), int(k[i, t])) for i, t in zip(*np.nonzero(k))], "n int, t long, k long")
    want = np.corrcoef(k.astype(float) - np.rint(k.mean(1, keepdims=True)))
    for width, entries in ((2048, 1 << 20), (7, 1 << 20), (2048, 5000)):
        got = series.count_correlations(rows, "n", "t", "k", width, entries).collect()
        assert len(got) == len({(g.i, g.j) for g in got}) == 780 and all(g.i < g.j and g.w == pytest.approx(want[g.i, g.j], abs=1e-12) for g in got)
    for none in (rows.limit(0), rows.limit(1), spark.createDataFrame([(1, None, 0), (2, None, 0)], "n int, t long, k long")):
        assert series.count_correlations(none, "n", "t", "k").collect() == []


def shuffled(plan):
    """Bytes that the exchanges of a plan that has run wrote."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleBytesWritten").value() if name == "Exchange" else 0
    return own + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_blocks_are_packed_before_they_are_copied(spark):
    """15 blocks in 120 pairs shuffle a few bytes for each sample, not each sample once a pair; packing keeps wide numbers and nodes without samples."""
    rows = spark.range(18000).selectExpr("id % 300 as n", "id div 300 as t", "1 + pmod(hash(id), 5) as k")
    got = series.count_correlations(rows, "n", "t", "k", 20)
    edges = {(g.i, g.j): g.w for g in got.collect()}
    k = np.array([r.k for r in rows.orderBy("n", "t").collect()], float).reshape(300, 60)
    want = np.corrcoef(k)
    assert len(edges) == 300 * 299 // 2 and all(w == pytest.approx(want[i, j], abs=1e-12) for (i, j), w in edges.items())
    assert shuffled(got._jdf.queryExecution().executedPlan()) < 18000 * 50
    wide = spark.createDataFrame([(-(2**40), 2**41, 2**20), (-(2**40), 2**41 + 2, 300), (7, 2**41, 1), (9, None, 0)], "n long, t long, k long")
    assert {(g.i, g.j): round(g.w, 6) for g in series.count_correlations(wide, "n", "t", "k").filter("not isnan(w)").collect()} == {(-(2**40), 7): round(np.corrcoef([2**20, 0, 300], [1, 0, 0])[0, 1], 6)}


def test_files_and_sinks(spark, tmp_path):
    """A listing, tables written again in part, and a table as CSV."""
    x = spark.createDataFrame([("a", 1, 1.5), ("b", 2, None)], "g string, k int, v double")
    tables.write_resumable(x, str(tmp_path / "out"), "g")
    tables.write_resumable(x.filter("g = 'b'").withColumn("k", F.lit(7)), str(tmp_path / "out"), "g")
    assert sorted((r.g, r.k) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 7)]
    assert [r.g for r in tables.unfinished(x, spark.createDataFrame([("a",)], "g string"), "g").collect()] == ["b"]
    tables.write_csv(x, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "csv"), x.schema).collect())) == sorted(map(tuple, x.collect()))
    found = tables.file_catalog(spark, str(tmp_path / "csv"), "*.csv").collect()
    assert found and all(r.path.endswith(".csv") and r.length > 0 for r in found)


def test_drawn_noise_is_standard(spark):
    z = latent.reparameterize(spark.range(4000).selectExpr("1.0D as mu", "0.0D as lv"), "mu", "lv").agg(F.avg("z"), F.stddev("z")).first()
    assert z[0] == pytest.approx(1, abs=0.1) and z[1] == pytest.approx(1, abs=0.1)


def test_streaming_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    tables.table(spark, DIR, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), "value").write.parquet(src)
    stream = tumbling_mean(spark.readStream.schema("ts timestamp, channel string, value double").parquet(src), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, tumbling_mean(spark.read.parquet(src), "1 day").collect()))


@pytest.mark.parametrize("shape", [(4, 4, 4), (7, 7, 5)])
def test_autoencoder_gradients(shape):
    r = np.random.default_rng(1)
    model = autoencoder.new_model(shape, 3, (2, 3, 2))
    x, noise = r.random((2, *shape)), r.standard_normal((2, 3))
    _, g = autoencoder.loss_and_gradients(model, x, noise, True)
    for name, w in model.weights.items():
        for at in r.integers(0, w.size, 3):
            losses = []
            for h in (1e-6, -1e-6):
                w.flat[at] += h
                losses.append(autoencoder.loss_and_gradients(model, x, noise, True)[0])
                w.flat[at] -= h
            assert g[name].flat[at] == pytest.approx((losses[0] - losses[1]) / 2e-6, rel=1e-4, abs=1e-8), name


def _patterns(count):
    """One of two patterns along the last axis, with noise."""
    r = np.random.default_rng(2)
    odd = np.indices((4, 4, 4))[2] % 2
    x = np.array([np.where(odd == i % 2, 0.9, 0.1) for i in range(count)]) + r.normal(0, 0.02, (count, 4, 4, 4))
    return (x + x.swapaxes(1, 2)) / 2


def test_autoencoder_learns():
    x, r = _patterns(32), np.random.default_rng(4)
    model = autoencoder.new_model((4, 4, 4), 2, (4, 6, 4))
    losses = []
    for _ in range(300):
        loss, g = autoencoder.loss_and_gradients(model, x, r.standard_normal((32, 2)), True)
        losses.append(loss / 32)
        autoencoder._adam(model, np.concatenate([g[n].ravel() for n in model.weights]) / 32, 0.005)
    assert losses[0] > 0.3 and losses[-1] < 0.05


def test_autoencoder_goes_on_from_a_checkpoint(spark, tmp_path):
    x = _patterns(60)
    rows = [(i, [float(v) for v in x[i].ravel()], "kept") for i in range(60)]
    odd = [(60, None, "a"), (61, [0.5], "b"), (62, [float("nan")] * 64, "c"), (63, [None] * 64, "d")]
    df = spark.createDataFrame(rows + odd, "id long, x array<double>, mu string")

    def fresh():
        return [autoencoder.new_model((4, 4, 4), k, (4, 6, 4)) for k in (1, 3)]

    whole, stopped = fresh(), fresh()
    history = autoencoder.train(df.repartition(5), whole, 6, 2, 0.02)
    assert [h[:2] for h in history] == [(k, e) for e in range(1, 7) for k in (1, 3)]
    one = autoencoder.new_model((4, 4, 4), 3, (4, 6, 4))
    first = autoencoder.train(df.repartition(7), [one], 1, 1, 0.02)[0][2]
    keys = [r.key for r in df.filter("id < 60").orderBy("id").select(F.xxhash64(F.lit(42), "id").alias("key")).collect()]
    want = autoencoder.loss_and_gradients(autoencoder.new_model((4, 4, 4), 3, (4, 6, 4)), x, autoencoder._noise(np.array(keys), 1, 3), True)[0] / 60
    assert first == pytest.approx(want, rel=1e-9)
    path = f"file://{tmp_path}/models"
    autoencoder.train(df.repartition(3), stopped, 3, 2, 0.02, save=path, every=3)
    again = [autoencoder.load_model(spark, path, k) for k in (1, 3)]
    assert [m.epochs for m in again] == [3, 3]
    rest = autoencoder.train(df.repartition(2), again, 3, 2, 0.02)
    assert rest[-1][2] == pytest.approx(history[-1][2], rel=1e-6)
    for name, w in whole[1].weights.items():
        np.testing.assert_allclose(again[1].weights[name], w, rtol=1e-5, atol=1e-8)
    coded = autoencoder.reconstruct(autoencoder.encode(df, whole[1]), whole[1]).collect()
    assert len(coded) == 64 and all((r.mse is None) == (r.id >= 60) for r in coded)
    assert all(len(r.mu) == 3 and len(r.logvar) == 3 and len(r.predicted) == 64 for r in coded if r.id < 60)
    moved = autoencoder.traverse(whole[1], np.zeros(3), 0, np.linspace(-2, 2, 5))
    assert moved.shape == (5, 4, 4, 4) and np.allclose(moved[2], 0) and np.abs(moved[0]).max() > 0


def test_autoencoder_over_no_rows(spark):
    empty = spark.createDataFrame([], "id long, x array<double>")
    model = autoencoder.new_model((4, 4, 4), 2, (2, 2, 2))
    was = {n: w.copy() for n, w in model.weights.items()}
    assert np.isnan(autoencoder.train(empty, [model], 1)[0][2])
    assert all((model.weights[n] == w).all() for n, w in was.items())
    assert autoencoder.encode(empty, model).count() == 0
