"""Latent-space queries and the streaming window, on the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenweft.operators import autoencoder, canonical, latent, search
from lumenweft.plans.catalog import query
from lumenweft.sources.tables import table
from lumenweft.streaming.windows import tumbling_mean


def _halves(spark, d):
    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.slice(e, 1, 8).alias("x"), F.slice(e, 9, 6).alias("y"))


#: The grid of the sparse canonical search.
ALPHAS, RATIOS, LATENTS = [0.05, 0.1, 0.3, 0.7, 0.9], [0.05, 0.1, 0.3, 0.7, 0.9], [2, 3, 4]
#: Features of the two views.
X, Y = 18, 46


def _views(spark, d):
    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice(e, 1, X).alias("x"), F.slice(e, X + 1, Y).alias("y"))


@query()
def sparse_cca_grid(spark, d):
    return canonical.grid_search(_views(spark, d), X, Y, ALPHAS, RATIOS, LATENTS)


@query()
def sparse_cca_best(spark, d):
    return sparse_cca_grid(spark, d).orderBy(F.desc("score"), "alpha", "l1_ratio", "latents").limit(1)


def _best_pairs(spark, d):
    best = sparse_cca_best(spark, d).first()
    return canonical.fit(_views(spark, d), X, Y, best.alpha, best.l1_ratio, best.latents)


@query()
def sparse_cca_projections(spark, d):
    return canonical.project(_views(spark, d), _best_pairs(spark, d)).select("id", "u", "v")


@query()
def sparse_cca_loadings(spark, d):
    return canonical.weights_and_loadings(spark, _best_pairs(spark, d))


@query()
def cost_search(spark, d):
    """Two parameters by a (1+1) strategy against the caller's cost."""
    return search.one_plus_one(spark, {"rate": (0.0, 4.0), "delay": (-1.0, 1.0)}, lambda p: (p["rate"] - 3) ** 2 + (p["delay"] + 0.5) ** 2, 10, 4)


def _dense(sizes: list[int]):
    """Layers of fixed weights ((3 * out + 5 * in + layer) % 7 - 3) / 10 and biases out / 10."""
    return [(np.array([[((3 * o + 5 * i + k) % 7 - 3) / 10 for i in range(n)] for o in range(m)]), np.arange(m) / 10) for k, (n, m) in enumerate(zip(sizes, sizes[1:]))]


_UNIT = "list_sum(list_transform(range({n}), i -> ((3 * o + 5 * i + {k}) % 7 - 3) / 10.0::double * {x}[i + 1]::double)) + o / 10.0::double"


@query(
    f"with h as (select vec_id, embedding, list_transform(range(4), o -> tanh({_UNIT.format(n=64, k=0, x='embedding')})) as h from embeddings),"
    f" r as (select vec_id, embedding, h, list_transform(range(64), o -> {_UNIT.format(n=4, k=1, x='h')}) as r from h)"
    " select vec_id as id, round(h[1], 6) as h0, round(h[4], 6) as h3,"
    " round(list_sum(list_transform(range(64), i -> pow(r[i + 1] - embedding[i + 1]::double, 2))) / 64, 6) as loss from r".replace("i ->", "lambda i:").replace("o ->", "lambda o:")
)
def reconstruction_loss(spark, d):
    """An encoder and a decoder read back from their table of weights, and the squared error of what they give."""
    layers = latent.read_layers(latent.layers_table(spark, _dense([64, 4, 64])))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    out = latent.forward(latent.forward(e, layers[:1], [F.tanh], "x", "h"), layers[1:], [None], "h", "r")
    loss = F.aggregate(F.zip_with("r", "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / 64
    return out.select("id", F.round(F.get("h", F.lit(0)), 6).alias("h0"), F.round(F.get("h", F.lit(3)), 6).alias("h3"), F.round(loss, 6).alias("loss"))


@query("select vec_id as id, round(0.5 * embedding[1]::double - embedding[2]::double + 0.25, 6) as lat0, round(embedding[3]::double + 2 * embedding[4]::double, 6) as lat1 from embeddings")
def encode_latents(spark, d):
    w = np.zeros((2, 8))
    w[0, :2], w[1, 2:4] = (0.5, -1.0), (1.0, 2.0)
    out = latent.encode(_halves(spark, d), w, np.array([0.25, 0.0]))
    return out.select("id", *[F.round(F.get("lat", F.lit(i)), 6).alias(f"lat{i}") for i in (0, 1)])


@query("select event_type as channel, strftime(time_bucket(interval 4 hours, ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def window_mean(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), "value")
    return tumbling_mean(e).select("channel", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("select count(*)::bigint as u_pairs, round(sum(case when a.v > b.v then 1.0::double when a.v = b.v then 0.5::double else 0 end), 1) as u from (select s_acctbal v from supplier where s_nationkey < 12) a, (select s_acctbal v from supplier where s_nationkey >= 12) b")
def mann_whitney_u(spark, d):
    """U from ranks: one sort instead of all pairs."""
    from lumenweft.operators.cohort import average_rank

    s = table(spark, d, "supplier").select((F.col("s_nationkey") < 12).alias("first"), F.lit(0).alias("k"), F.col("s_acctbal").alias("v"))
    r = average_rank(s, ["k"], "v", "rank").agg(F.sum(F.when(F.col("first"), F.col("rank"))).alias("r"), F.sum(F.col("first").cast("long")).alias("n"), F.sum((~F.col("first")).cast("long")).alias("m"))
    return r.select((F.col("n") * F.col("m")).alias("u_pairs"), F.round(F.col("r") - F.col("n") * (F.col("n") + 1) / 2, 1).alias("u"))


@query()
def sparse_pca_2d(spark, d):
    out = latent.sparse_pca(_halves(spark, d), 8, 2, 1.0)
    return out.select("id", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))


@query("select vec_id as id, round(embedding[1]::double + embedding[3]::double * exp(embedding[2]::double / 2), 6) as z from embeddings")
def reparameterize(spark, d):
    x = _halves(spark, d).select("id", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(("mu", "logvar", "eps"))])
    return latent.reparameterize(x, "mu", "logvar", F.col("eps")).select("id", F.round("z", 6).alias("z"))


@query("with z as (select vec_id as id, embedding[1]::double a, embedding[2]::double b from embeddings) select id, step::double as step, round(tanh(0.5 * (a + step) - 0.25 * b) - tanh(0.5 * a - 0.25 * b), 6) as edge0, round((a + step) * b - a * b, 6) + 0.0::double as edge1 from z, (select unnest([-2.0, -1.0, 0.0, 1.0, 2.0])::double step)")
def latent_traversal(spark, d):
    z = _halves(spark, d).select("id", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))
    decoder = {"edge0": lambda c: F.tanh(0.5 * c["a"] - 0.25 * c["b"]), "edge1": lambda c: c["a"] * c["b"]}
    out = latent.traverse(z, ["a", "b"], "a", [-2, -1, 0, 1, 2], decoder)
    return out.select("id", "step", F.round("edge0", 6).alias("edge0"), (F.round("edge1", 6) + 0.0).alias("edge1"))


def _cubes(spark, d):
    """Embeddings as symmetric volumes of 4 x 4 x 4 between 0 and 1."""
    e = F.transform("embedding", lambda v: 1 / (1 + F.exp(-v.cast("double"))))
    swapped = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(e, ((i / 4).cast("int") % 4) * 16 + (i / 16).cast("int") * 4 + i % 4))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.zip_with(e, swapped, lambda a, b: (a + b) / 2).alias("x"))


def _autoencoders(spark, d):
    models = [autoencoder.new_model((4, 4, 4), k, (4, 8, 4)) for k in (2, 4)]
    return models, autoencoder.train(_cubes(spark, d), models, epochs=3, batches=2, rate=0.005)


@query()
def autoencoder_training(spark, d):
    """Mean loss by size of the bottleneck and epoch."""
    return spark.createDataFrame(_autoencoders(spark, d)[1], "latents int, epoch int, loss double")


@query()
def autoencoder_codes(spark, d):
    """Codes of all rows by the trained model, and how far what it gives is off."""
    model = _autoencoders(spark, d)[0][0]
    return autoencoder.reconstruct(autoencoder.encode(_cubes(spark, d), model), model).select("id", "mu", "logvar", "mse")
