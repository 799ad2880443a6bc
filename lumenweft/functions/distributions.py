"""Distribution functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite trigonometric series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c2, s, c = F.pow(F.cos(theta), 2), F.sin(theta), F.cos(theta)

    def series(first: int, terms: Column) -> Column:
        # 1 + a1 c2 + a1 a2 c2**2 + ..., with a_i = (2i - 1 + first) / (2i + first)
        steps = F.sequence(F.lit(1), terms.cast("int"))
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        fold = F.aggregate(steps, start, lambda acc, i: F.struct((acc.term * c2 * (2 * i - 1 + first) / (2 * i + first)).alias("term"), (acc["sum"] + acc.term * c2 * (2 * i - 1 + first) / (2 * i + first)).alias("sum")))
        return F.when(terms >= 1, fold["sum"]).otherwise(1.0)

    even = s * series(0, (df - 2) / 2)
    odd = F.when(df == 1, 2 * theta / 3.141592653589793).otherwise(2 / 3.141592653589793 * (theta + s * c * series(1, (df - 3) / 2)))
    return 1 - F.when(df % 2 == 0, even).otherwise(odd)
