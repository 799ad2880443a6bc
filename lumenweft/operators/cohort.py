"""Cohort tables: pivots, recodes, group comparisons, false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweft.functions.distributions import t_two_sided_p


def pivot_fields(long: DataFrame, subject: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """One row per subject and one column per field; the field list is given, so no pass finds it."""
    return long.filter(F.col(field).isin(fields)).groupBy(subject).agg(*[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])


def recode(column: Column, codes: dict) -> Column:
    """Codes of known values; others are null."""
    out = F.lit(None)
    for k, v in reversed(list(codes.items())):
        out = F.when(column == k, v).otherwise(out)
    return out


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, var (sample) per group, in one aggregation."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def pooled_t(df: DataFrame, item: str, group: str, value: str) -> DataFrame:
    """Equal-variance t statistic of every pair of groups, per item. Groups meet as moments, not as rows."""
    m = moments(df, [item, group], value)
    a, b = (m.select(F.col(item), *[F.col(c).alias(f"{c}_{s}") for c in (group, "n", "mean", "var")]) for s in "ab")
    p = a.join(b, item).filter(F.col(f"{group}_a") < F.col(f"{group}_b")).withColumn("df", F.col("n_a") + F.col("n_b") - 2)
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.col("df")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b"))))
    return p.select(item, F.col(f"{group}_a").alias("group_a"), F.col(f"{group}_b").alias("group_b"), "df", t.alias("t"))


def benjamini_hochberg(df: DataFrame, p: str, ranges: int = 256) -> DataFrame:
    """Adds q: adjusted p over all rows as one family; null and NaN tests are no part of it and have a null q.

    q depends on p alone, so equal ones are counted first. Ranks and minima run inside ``ranges`` parts of p at
    approximate quantiles, on top of sums over the parts; no task holds the whole family, and the cuts don't change results.
    """
    valid = F.col(p).isNotNull() & ~F.isnan(p)
    cuts = df.filter(valid).agg(F.percentile_approx(p, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []  # at most ``ranges`` numbers
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    each = df.filter(valid).groupBy(F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_n")).withColumn("_part", F.size(F.filter(cuts, lambda c: c < F.col("_p"))))
    inside, before = Window.partitionBy("_part").orderBy("_p"), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy("_part").agg(F.sum("_n").alias("_size")).withColumns({"_base": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_m": F.sum("_size").over(Window.partitionBy())})
    raw = F.col("_p") * F.col("_m") / (F.col("_base") + F.sum("_n").over(inside))
    raised = each.join(F.broadcast(parts.drop("_size")), "_part").withColumn("_raw", raw)  # one row per part
    after = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    floors = raised.groupBy("_part").agg(F.min("_raw").alias("_least")).withColumn("_floor", F.min("_least").over(after)).select("_part", "_floor")
    own = F.min("_raw").over(Window.partitionBy("_part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    q = raised.join(F.broadcast(floors), "_part").select("_p", F.least(F.lit(1.0), own, "_floor").alias("q"))
    return df.join(q, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str, ranges: int = 256) -> DataFrame:
    """Ranks of numbers per group with ties at their mean; nulls have no rank.

    Equal values are counted first; counts are summed inside ``ranges`` parts of the value at approximate quantiles, on
    top of sums over the parts, so no task holds a group, and the cuts don't change results.
    """
    valid = df.filter(F.col(value).isNotNull())
    cuts = valid.filter(~F.isnan(F.col(value).cast("double"))).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []  # at most ``ranges`` numbers
    cuts = F.array(*[F.lit(c) for c in sorted({float(c) for c in cuts})]).cast("array<double>")
    each = valid.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_part", F.size(F.filter(cuts, lambda c: c < F.col("_v").cast("double"))))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("_below", F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("e").join(parts.alias("p"), [F.expr(f"e.`{k}` <=> p.`{k}`") for k in [*keys, "_part"]])
    ranked = ranked.select(*[F.col(f"e.`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], "_v", (F.col("_base") + F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    on = [F.col(f"_k{i}").eqNullSafe(df[k]) for i, k in enumerate(keys)] + [df[value] == F.col("_v")]
    return df.join(ranked, on, "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])


def spearman_block(rows: DataFrame, key: str, left: list[str], right: list[str]) -> DataFrame:
    """left, right, n, rho, p: rank correlation of each left with each right column, over rows that have all of them.

    ``key`` names a row. All columns are ranked together in long form; p follows from t with n - 2 degrees of freedom.
    Constant columns have no rho; p is null where n is below 3, and 0 where rho is 1 or -1.
    """
    columns = [*left, *right]
    whole = rows.dropna(subset=columns)
    long = whole.select(F.col(key).alias("_key"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("_x"))
    ranked = average_rank(long.select("_key", F.col("_x.i").alias("_i"), F.col("_x.v").alias("_value")), ["_i"], "_value", "_r")
    wide = ranked.groupBy("_key").agg(*[F.max(F.when(F.col("_i") == i, F.col("_r"))).alias(f"_{i}") for i in range(len(columns))])
    pairs = [(i, j) for i in range(len(left)) for j in range(len(left), len(columns))]
    cells = [F.struct(F.lit(columns[i]).alias("left"), F.lit(columns[j]).alias("right"), F.try_divide(F.covar_pop(f"_{i}", f"_{j}"), F.stddev_pop(f"_{i}") * F.stddev_pop(f"_{j}")).alias("rho")) for i, j in pairs]
    out = wide.agg(F.count("*").alias("n"), F.array(*cells).alias("_c")).select("n", F.explode("_c").alias("_c")).select("_c.left", "_c.right", "n", "_c.rho")
    exact = F.abs("rho") > 1 - 1e-12
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return out.withColumn("p", F.when((F.col("n") > 2) & exact, 0.0).when(F.col("n") > 2, t_two_sided_p(t, F.col("n") - 2)))


def factorize(df: DataFrame, column: str, order: str) -> DataFrame:
    """Adds code: 0, 1, ... by first appearance in ``order``."""
    first = df.groupBy(column).agg(F.min(order).alias("o")).withColumn("code", F.row_number().over(Window.orderBy("o")) - 1)
    return df.join(first.drop("o"), column)
