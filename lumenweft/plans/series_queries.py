"""Time-series, connectivity, matrix and spike-train queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweft.operators import series as S
from lumenweft.plans.catalog import oracles, query
from lumenweft.plans.inputs import RECORDINGS, SERIES, recordings, seconds, series
from lumenweft.sources.tables import table

R6 = lambda c: F.round(c, 6)
EDGES = f"select a.node as i, b.node as j, corr(a.v, b.v) as w from {SERIES} a join {SERIES} b on a.t = b.t and a.node < b.node group by 1, 2"
SIZE, STEP = 10, 1
WINS = f"(select unnest(range(n)) as win from (select (max(t) + 1 - {SIZE}) // ({STEP} + 1) as n from {SERIES}))"
SPIKES = "(select user_id as neuron, epoch(ts) - 1704067200 as t from events)"


def _edges(spark, d):
    return S.correlations(series(spark, d), "node", "t", "v")


def _spikes(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("neuron"), (seconds() - 1704067200).alias("t"))


@query(f"select i, j, round(w, 6) as w from ({EDGES})")
def static_connectivity(spark, d):
    return _edges(spark, d).withColumn("w", R6("w"))


@query(f"with w as (select node, win, t, v from {SERIES} s join {WINS} on t between win * {STEP} and win * {STEP} + {SIZE} - 1) select a.win::int as win, a.node as i, b.node as j, round(case when stddev_pop(a.v) > 0 and stddev_pop(b.v) > 0 then corr(a.v, b.v) end, 6) as w from w a join w b on a.win = b.win and a.t = b.t and a.node < b.node group by 1, 2, 3")
def sliding_connectivity(spark, d):
    wins = S.sliding(series(spark, d), SIZE, STEP, S.window_count(F.col("bins"), SIZE, STEP))
    return S.correlations(wins, "node", "t", "v", ["win"]).withColumn("w", R6("w"))


@query(
    f"with b as (select max(t) + 1 as bins from {SERIES}), w as (select bins, unnest(range(bins)) as win from b)"
    f" select node, win::int as win, count(*) as n, round(avg(v), 6) as mean from {SERIES} s join w on t between win * 22 and win * 22 + 29 where win * 22 + 30 < bins group by 1, 2"
)
def overlap_windows(spark, d):
    """Windows of 30 bins, hop 22, while start + length < total."""
    return S.sliding(series(spark, d), 30, 22, F.ceil((F.col("bins") - 30) / 22)).groupBy("node", "win").agg(F.count("*").alias("n"), R6(F.avg("v")).alias("mean"))


@query(f"select node, cast(t // 6 as int) as epoch, round(avg(v), 6) as mean from {SERIES} group by 1, 2 having count(*) = 6")
def tumbling_epochs(spark, d):
    return S.epochs(series(spark, d), 6, ["node"]).groupBy("node", "epoch").agg(R6(F.avg("v")).alias("mean"))


@query(f"select node, cast(t // 6 as int) as epoch, max(v) - min(v) < 60000 as kept from {SERIES} group by 1, 2 having count(*) = 6")
def reject_p2p(spark, d):
    """Epochs whose peak-to-peak stays below a threshold."""
    return S.epochs(series(spark, d), 6, ["node"]).groupBy("node", "epoch").agg((F.max("v") - F.min("v") < 60000).alias("kept"))


@query(f"select node, t, round(v - (regr_intercept(v, t) over (partition by node) + regr_slope(v, t) over (partition by node) * t), 4) as residual from {SERIES}")
def detrend_linear(spark, d):
    return S.detrend(series(spark, d), ["node"], "t", "v").select("node", "t", F.round("residual", 4).alias("residual"))


@query(f"select node, t, round((v - avg(v) over (partition by node)) / stddev_samp(v) over (partition by node), 6) as z from {SERIES}")
def zscore(spark, d):
    return S.zscore(series(spark, d), ["node"], "v").select("node", "t", R6("z").alias("z"))


@query(f"select node, t, v from (select *, row_number() over (partition by node order by t) - 1 k, count(*) over (partition by node) n from {SERIES}) where k = n // 2".replace("t, v from (", "t, round(v, 6) as v from ("))
def middle_slice(spark, d):
    w = Window.partitionBy("node")
    x = series(spark, d).withColumn("k", F.row_number().over(w.orderBy("t")) - 1).withColumn("n", F.count("*").over(w))
    return x.filter("k = n div 2").select("node", "t", R6("v").alias("v"))


@query(f"select t, round(v, 6) as v from {SERIES} where node = (select min(event_type) from events)")
def edge_series(spark, d):
    s = series(spark, d)
    return s.join(F.broadcast(s.agg(F.min("node").alias("node"))), "node").select("t", R6("v").alias("v"))


@query(f"select node, round(avg(v), 6) as mean from {SERIES} group by 1")
def axis_mean(spark, d):
    return series(spark, d).groupBy("node").agg(R6(F.avg("v")).alias("mean"))


@query("select r_name, o_orderpriority as t, round(avg(o_totalprice), 4) as mean from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def region_mean(spark, d):
    labels = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(labels), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("r_name", F.col("o_orderpriority").alias("t")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("select c_custkey, c_acctbal * coalesce(m, 0) as v from customer left join (select n_nationkey, 1 as m from nation where n_regionkey < 2) on c_nationkey = n_nationkey")
def mask_apply(spark, d):
    m = table(spark, d, "nation").filter("n_regionkey < 2").select("n_nationkey", F.lit(1).alias("m"))
    return table(spark, d, "customer").join(m, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", (F.col("c_acctbal") * F.coalesce("m", F.lit(0))).alias("v"))


@query("select a.n_name as from_name, b.n_name as to_name, count(*) as n from customer c join supplier s on c_custkey = s_suppkey join nation a on c_nationkey = a.n_nationkey join nation b on s_nationkey = b.n_nationkey group by 1, 2")
def edge_names(spark, d):
    n = table(spark, d, "nation")
    e = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    e = e.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("from_name")), "c_nationkey")
    e = e.join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("to_name")), "s_nationkey")
    return e.groupBy("from_name", "to_name").agg(F.count("*").alias("n"))


@query(f"select i, j from ({EDGES}) order by round(abs(w), 9) desc, i, j limit 1")
def argmax_edge(spark, d):
    return _edges(spark, d).orderBy(F.desc(F.round(F.abs("w"), 9)), "i", "j").limit(1).select("i", "j")


@query(f"select i, j, round(w, 6) as w from ({EDGES}) order by round(abs(w), 9) desc, i, j limit 5")
def top_edges(spark, d):
    return _edges(spark, d).orderBy(F.desc(F.round(F.abs("w"), 9)), "i", "j").limit(5).withColumn("w", R6("w"))


MATRIX = "(select c_nationkey % 5 as i, c_nationkey // 5 as j, sum(c_acctbal) as w from customer group by 1, 2)"


def _matrix(spark, d):
    k = F.col("c_nationkey")
    return table(spark, d, "customer").groupBy((k % 5).alias("i"), F.floor(k / 5).cast("int").alias("j")).agg(F.sum("c_acctbal").alias("w"))


@query(f"select i, j, round(sum(w), 4) as w from (select i, j, w from {MATRIX} union all select j, i, w from {MATRIX}) group by 1, 2")
def symmetrize(spark, d):
    return S.symmetrize(_matrix(spark, d)).withColumn("w", F.round("w", 4))


@query(f"select j as i, i as j, round(w, 4) as w from {MATRIX}")
def transpose(spark, d):
    return _matrix(spark, d).select(F.col("j").alias("i"), F.col("i").alias("j"), F.round("w", 4).alias("w"))


@query(f"select i, j, case when i = j or j > i then 0.0::double else round(w, 4) end as w from {MATRIX}")
def tril_zero_diag(spark, d):
    return _matrix(spark, d).withColumn("w", F.when(F.col("i") <= F.col("j"), 0.0).otherwise(F.round("w", 4)))


@query(f"select i * 5 + j as k, i::varchar || '_' || j::varchar as pair, round(w, 4) as w from {MATRIX}")
def ravel_matrix(spark, d):
    return _matrix(spark, d).select((F.col("i") * 5 + F.col("j")).alias("k"), F.concat_ws("_", "i", "j").alias("pair"), F.round("w", 4).alias("w"))


@query(f"select a.i, a.j, round(a.w - b.w, 4) as w from {MATRIX} a join {MATRIX} b on a.i = b.j and a.j = b.i")
def matrix_diff(spark, d):
    b = _matrix(spark, d).select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("u"))
    return _matrix(spark, d).join(b, ["i", "j"]).select("i", "j", F.round(F.col("w") - F.col("u"), 4).alias("w"))


@query(f"select m.i as source, s.t, round(sum(m.w * s.v) / 1e6, 4) as v from {MATRIX} m join (select dense_rank() over (order by node) - 1 as j, t, v from {SERIES}) s using (j) group by 1, 2")
def linear_inverse(spark, d):
    """A linear operator (source, channel, weight) on channel series; the operator is small and broadcast."""
    s = series(spark, d)
    names = s.select("node").distinct().withColumn("j", F.row_number().over(Window.orderBy("node")) - 1)
    x = s.join(F.broadcast(names), "node").join(_matrix(spark, d), "j")
    return x.groupBy(F.col("i").alias("source"), "t").agg(F.round(F.sum(F.col("w") * F.col("v")) / 1e6, 4).alias("v"))


@query("select p_partkey, round(2.0 * p_size + 0.5 * p_retailprice + 1, 4)::double as x, round(-1.0 * p_size + 3 * p_retailprice - 2, 4)::double as y from part")
def affine_apply(spark, d):
    s, r = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(s * 2 + r * 0.5 + 1, 4).alias("x"), F.round(-s + r * 3 - 2, 4).alias("y"))


@query("select k::int as k, round(-2 + k * 1.0::double, 6) as x from (select unnest(range(5)) k)")
def linspace_grid(spark, d):
    return spark.range(5).select(F.col("id").cast("int").alias("k"), (F.lit(-2.0) + F.col("id")).alias("x"))


KDE = "(select embedding[1]::double x, embedding[2]::double y from embeddings)"


@query(f"with m as (select count(*) n, avg(x) mx, avg(y) my, var_samp(x) * pow(count(*), -1.0/3) a, covar_samp(x, y) * pow(count(*), -1.0/3) b, var_samp(y) * pow(count(*), -1.0/3) c from {KDE}), g as (select i, j, -1 + i * 0.25 gx, -1 + j * 0.25 gy from (select unnest(range(9)) i), (select unnest(range(9)) j)) select i::int as i, j::int as j, round(sum(exp(-0.5 * (c * (gx - x) * (gx - x) - 2 * b * (gx - x) * (gy - y) + a * (gy - y) * (gy - y)) / (a * c - b * b))) / any_value(n * 2 * pi() * sqrt(a * c - b * b)), 6) as density from g, m, {KDE} group by 1, 2")
def kde_2d(spark, d):
    """Gaussian density of the first two latents on a grid, Scott's bandwidth. The grid has a fixed size and is exploded per point, summed map-side."""
    e = table(spark, d, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    f = F.pow(F.count("*").cast("double"), F.lit(-1.0 / 3))
    m = e.agg(F.count("*").alias("n"), (F.var_samp("x") * f).alias("a"), (F.covar_samp("x", "y") * f).alias("b"), (F.var_samp("y") * f).alias("c"))
    g = e.crossJoin(F.broadcast(m)).select("*", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("j"))
    u, v, det = F.col("i") * 0.25 - 1 - F.col("x"), F.col("j") * 0.25 - 1 - F.col("y"), F.col("a") * F.col("c") - F.col("b") * F.col("b")
    k = F.exp((F.col("c") * u * u - F.col("b") * u * v * 2 + F.col("a") * v * v) * -0.5 / det) / (F.col("n") * 2 * F.pi() * F.sqrt(det))
    return g.groupBy("i", "j").agg(R6(F.sum(k)).alias("density"))


@query("select count(*) as n from events")
def spike_count(spark, d):
    return _spikes(spark, d).agg(F.count("*").alias("n"))


@query(f"select neuron, round(t, 3) as t from {SPIKES}")
def spike_raster(spark, d):
    return _spikes(spark, d).select("neuron", F.round("t", 3).alias("t"))


@query(f"select neuron, round(count(*) / (select max(t) - min(t) from {SPIKES}) * 86400, 6) as rate from {SPIKES} group by 1")
def firing_rate(spark, d):
    s = _spikes(spark, d)
    span = s.agg((F.max("t") - F.min("t")).alias("span"))
    return s.groupBy("neuron").agg(F.count("*").alias("n")).crossJoin(F.broadcast(span)).select("neuron", R6(F.col("n") / F.col("span") * 86400).alias("rate"))


@query(f"with i as (select neuron, t - lag(t) over (partition by neuron order by t) isi from {SPIKES}) select neuron, round(stddev_pop(isi) / avg(isi), 6) as cv from i where isi is not null group by 1")
def isi_cv(spark, d):
    x = _spikes(spark, d).withColumn("isi", F.col("t") - F.lag("t").over(Window.partitionBy("neuron").orderBy("t"))).filter("isi is not null")
    return x.groupBy("neuron").agg(R6(F.try_divide(F.stddev_pop("isi"), F.avg("isi"))).alias("cv"))


@query(
    f"with n as (select distinct neuron from {SPIKES}), d as (select unnest(range(lo, hi + 1)) as b from (select min(floor(t / 86400))::bigint as lo, max(floor(t / 86400))::bigint as hi from {SPIKES})),"
    f" g as (select neuron, b from n, d), c as (select neuron, cast(floor(t / 86400) as bigint) b, count(*) k from {SPIKES} group by 1, 2),"
    " f as (select g.neuron, g.b, coalesce(k, 0)::double k from g left join c on g.neuron = c.neuron and g.b = c.b)"
    " select x.neuron as i, y.neuron as j, round(corr(x.k, y.k), 6) + 0.0::double as w from f x join f y on x.b = y.b and x.neuron < y.neuron group by 1, 2"
)
def spike_corr(spark, d):
    """Correlation of daily spike counts of all neurons over the days from the first to the last spike, empty ones counted as 0; NaN where a neuron's count is constant."""
    counts = _spikes(spark, d).groupBy("neuron", F.floor(F.col("t") / 86400).cast("long").alias("b")).agg(F.count("t").alias("k"))
    w = F.signum("w") * F.floor(F.abs("w") * 1e6 + 0.5) / 1e6  # as DuckDB rounds, without a decimal per pair
    return S.count_correlations(counts, "neuron", "b", "k").withColumn("w", w + 0.0)  # -0.0 becomes 0.0


@query(
    f"with x as (select subject, node, t, v - avg(v) over (partition by subject, node) as x from {RECORDINGS}),"
    " s as (select a.subject, a.node as i, b.node as j, avg(a.x * b.x) as s from x a join x b on a.subject = b.subject and a.t = b.t group by 1, 2, 3),"
    " f as (select subject, count(*) as n, sum(q * q) as fourth from (select subject, t, sum(x * x) as q from x group by 1, 2) group by 1),"
    " m as (select subject, sum(case when i = j then s end) as tr, sum(s * s) as sq, sum((i = j)::int) as p from s group by 1),"
    " l as (select subject, tr / p as mu, (sq - tr * tr / p) / p as delta, (fourth / n - sq) / (p * n) as beta from m join f using (subject)),"
    " k as (select subject, mu, case when least(beta, delta) > 0 then least(beta, delta) / delta else 0 end as k from l)"
    " select e.subject, e.i, e.j, round((1 - k) * e.s / sqrt(((1 - k) * a.s + k * mu) * ((1 - k) * b.s + k * mu)), 6) + 0.0::double as w"
    " from s e join k using (subject) join s a on a.subject = e.subject and a.i = e.i and a.j = e.i join s b on b.subject = e.subject and b.i = e.j and b.j = e.j where e.i < e.j"
)
def shrunk_connectivity(spark, d):
    """Connectivity per subject from the shrunk covariance."""
    return S.shrunk_correlations(recordings(spark, d), ["subject"], "node", "t", "v").withColumn("w", R6("w") + 0.0)  # -0.0 becomes 0.0


@query(f"select m.i as channel, s.t, round(sum(m.w * s.v) / 1e6, 4) as value from {MATRIX} m join (select dense_rank() over (order by node) - 1 as j, t, v from {SERIES}) s using (j) where j not in (0, 3) group by 1, 2")
def components_excluded(spark, d):
    """Channels from components without two of them."""
    s = series(spark, d)
    names = s.select("node").distinct().withColumn("component", F.row_number().over(Window.orderBy("node")) - 1)  # one row per event type
    sources = s.join(F.broadcast(names), "node").select("component", "t", F.col("v").alias("value"))
    mixing = _matrix(spark, d).select(F.col("i").alias("channel"), F.col("j").alias("component"), F.col("w").alias("weight"))
    out = S.mix_components(sources, mixing, spark.createDataFrame([(0,), (3,)], "component int"))
    return out.withColumn("value", F.round(F.col("value") / 1e6, 4))


@query(f"select win, w from ({oracles()['sliding_connectivity']}) where i = 'click' and j = 'view'")
def connectivity_edge_series(spark, d):
    """One edge's connectivity over the windows; the filter reaches the series before they meet."""
    return sliding_connectivity(spark, d).filter("i = 'click' and j = 'view'").select("win", "w")


@query(f"select t, round(v, 4) as value from (select dense_rank() over (order by node) - 1 as component, t, v from {SERIES}) where component = 2")
def component_series(spark, d):
    """The series of one component."""
    s = series(spark, d)
    names = s.select("node").distinct().withColumn("component", F.row_number().over(Window.orderBy("node")) - 1)  # one row per event type
    return s.join(names.filter("component = 2"), "node").select("t", F.round("v", 4).alias("value"))


EPOCHS = f"(select node as channel, t // 30 as epoch, t % 30 as t_in, v as value, count(*) over (partition by node, t // 30) as n from {SERIES})"


@query(f"select a.epoch::int as epoch, a.channel as i, b.channel as j, round(case when stddev_pop(a.value) > 0 and stddev_pop(b.value) > 0 then corr(a.value, b.value) end, 6) as w from {EPOCHS} a join {EPOCHS} b on a.epoch = b.epoch and a.t_in = b.t_in and a.channel < b.channel where a.n = 30 and b.n = 30 group by 1, 2, 3")
def sensor_connectivity(spark, d):
    """Connectivity of channels, with their names as labels, in each epoch."""
    e = S.epochs(series(spark, d), 30, ["node"])
    return S.correlations(e, "node", "t", "v", ["epoch"]).withColumn("w", R6("w"))


LEVELS = [0.5, 0.7, 0.8, 0.9, 1.0]
_SIX = f"(select * from (select node as channel, t // 6 as epoch, t % 6 as t_in, v as value, max(v) over e - min(v) over e as p, count(*) over e as n from {SERIES} window e as (partition by node, t // 6)) where n = 6)"
_CHOSEN = (
    f"(with x as (select *, epoch % 5 as f from {_SIX}), c as (select channel, unnest(quantile_cont(p, {LEVELS})) as threshold from (select distinct channel, epoch, p from x) group by 1),"
    " k as (select channel, threshold, t_in, f, sum(value) as s, count(*) as n from x join c using (channel) where p <= threshold group by 1, 2, 3, 4),"
    " a as (select channel, threshold, t_in, sum(s) as s, sum(n) as n from k group by 1, 2, 3), h as (select channel, t_in, f, quantile_cont(value, 0.5) as m from x group by 1, 2, 3),"
    " o as (select h.channel, a.threshold, h.f, h.m, a.s - coalesce(k.s, 0) as s, a.n - coalesce(k.n, 0) as n from h join a on h.channel = a.channel and h.t_in = a.t_in"
    " left join k on k.channel = h.channel and k.t_in = h.t_in and k.f = h.f and k.threshold = a.threshold),"
    " l as (select channel, threshold, f, sqrt(avg(case when n > 0 then pow(s / n - m, 2) else 'inf'::double end)) as l from o group by 1, 2, 3)"
    " select channel, arg_min(threshold, struct_pack(l := l, t := threshold)) as threshold from (select channel, threshold, avg(l) as l from l group by 1, 2) group by 1)"
)


def _six(spark, d):
    e = S.epochs(series(spark, d), 6, ["node"])
    return e.select(F.col("node").alias("channel"), "epoch", (F.col("t") % 6).cast("int").alias("t_in"), F.col("v").alias("value"))


@query(f"select channel, round(threshold, 4) as threshold from {_CHOSEN}")
def epoch_thresholds(spark, d):
    """The peak-to-peak limit of each channel by cross-validation."""
    return S.p2p_thresholds(_six(spark, d), LEVELS).withColumn("threshold", F.round("threshold", 4))


@query(
    f"with x as (select * from {_SIX}), l as (select channel, quantile_cont(p, 0.8) as threshold from (select distinct channel, epoch, p from x) group by 1), b as (select *, p > threshold as repaired from x join l using (channel)),"
    " g as (select epoch, t_in, avg(value) as good from b where not repaired group by 1, 2)"
    " select channel, b.epoch::int as epoch, b.t_in::int as t_in, repaired, round(case when repaired then good else value end, 4) as value from b left join g on g.epoch = b.epoch and g.t_in = b.t_in"
)
def epoch_repair(spark, d):
    """The fifth of each channel's epochs with the largest peak-to-peak takes the mean of the channels within their limit."""
    x = _six(spark, d)
    return S.repair(x, S.p2p_levels(x, [0.8])).select("channel", "epoch", "t_in", "repaired", F.round("value", 4).alias("value"))


@query(
    "with v as (select p_partkey % 5 as x, p_partkey // 5 % 5 as y, p_partkey // 25 as z, p_size as v from part), g as (select x, y, z from (select unnest(range(6)) x), (select unnest(range(6)) y), (select unnest(range(8)) z)),"
    " s as (select *, floor(0.5 * x + 0.25 * y + 1 + 0.5)::int as sx, floor(-0.25 * x + 0.5 * y + 2 + 0.5)::int as sy, floor(0.75 * z - 0.5 + 0.5)::int as sz from g)"
    " select s.x::int as x, s.y::int as y, s.z::int as z, coalesce(v.v, 0)::int as value from s left join v on v.x = sx and v.y = sy and v.z = sz"
)
def affine_resample(spark, d):
    """An image through a 3x4 affine, nearest voxels, on another grid."""
    k = F.col("p_partkey")
    v = table(spark, d, "part").select((k % 5).alias("x"), (F.floor(k / 5) % 5).alias("y"), F.floor(k / 25).alias("z"), F.col("p_size").cast("int").alias("value"))
    return S.resample_affine(v, [[0.5, 0.25, 0, 1], [-0.25, 0.5, 0, 2], [0, 0, 0.75, -0.5]], (6, 6, 8))


def _long(spark, d):
    return recordings(spark, d).select("subject", F.col("node").alias("channel"), "t", F.col("v").alias("value"))


@query()
def band_pass(spark, d):
    return S.band_pass(_long(spark, d), ["subject", "channel"], 6.0, 0.1, 1.0)


@query()
def notch_filter(spark, d):
    return S.notch(_long(spark, d), ["subject", "channel"], 6.0, 1.0, 0.2)


@query()
def resample_series(spark, d):
    return S.resample(_long(spark, d), ["subject", "channel"], 6.0, 3.0)


@query()
def coherence_bands(spark, d):
    e = S.epochs(_long(spark, d), 30, ["subject", "channel"])
    return S.coherence(e, ["subject"], 6.0, {"slow": (0.2, 1.0), "fast": (1.0, 3.0)})


@query()
def ica_components(spark, d):
    return S.fast_ica(_long(spark, d), ["subject"], 3)


@query()
def clean_series(spark, d):
    return S.clean(_long(spark, d), ["subject", "channel"], 6.0, 0.1, 1.0)


@query("with p as (select p_brand, p_partkey, p_retailprice::double v from part), q as (select p_brand, quantile_cont(v, 0.2) lo, quantile_cont(v, 0.85) hi from p group by 1), l as (select distinct p_brand, v from p join q using (p_brand) where v between lo and hi), g as (select p_brand, v, lead(v) over (partition by p_brand order by v) up from l), k as (select p_brand, max((up - v, -v, up)) x from g where up is not null group by 1) select p_partkey, coalesce(v > (x[3] - x[2]) / 2, false) as inside from p left join k using (p_brand)")
def intensity_mask(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    return S.intensity_mask(p, ["p_brand"], "v").select("p_partkey", "inside")


@query(
    f"with e as (select node, t // 30 as epoch, t % 30 as t_in, v from {SERIES}), w as (select a.epoch, a.node as i, b.node as j, corr(a.v, b.v) as w"
    " from e a join e b on a.epoch = b.epoch and a.t_in = b.t_in and a.node < b.node group by 1, 2, 3 having count(*) = 30)"
    " select i, j, row_number() over (partition by i, j order by epoch) - 1 as at, round(w, 6) as w from w where w is not null and not isnan(w)"
)
def concat_matrices(spark, d):
    """One connectivity matrix per epoch, put behind each other along a new axis."""
    parts = S.epochs(series(spark, d), 30, ["node"])
    edges = S.correlations(parts, "node", "t", "v", ["epoch"]).filter("w is not null and not isnan(w)")
    at = F.row_number().over(Window.partitionBy("i", "j").orderBy("epoch")) - 1
    return edges.select("i", "j", at.alias("at"), R6("w").alias("w"))
