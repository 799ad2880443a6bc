"""Views that the registered queries share, on the driver's tables, and the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.sources.tables import table

#: Event values in bins of four hours per type, the region time series; bins without events are 0. t counts from the first bin of all.
BIN_S = 14_400
_BIN = "cast(floor((epoch(ts) - 1704067200) / 14400) as bigint)"
_GRID = f"(select lo, unnest(range(lo, hi + 1)) as bin from (select min({_BIN}) lo, max({_BIN}) hi from events)) g"
_NODES = "(select distinct event_type as node from events where event_type is not null) n"
SERIES = f"""(select n.node, g.bin - lo as t, coalesce(sum(value), 0) as v from {_NODES} cross join {_GRID}
              left join events e on e.event_type = n.node and {_BIN} = g.bin group by 1, 2)"""
#: The same per subject: users by their remainder.
SUBJECTS = 4
RECORDINGS = f"""(select s.subject, n.node, g.bin - lo as t, coalesce(sum(value), 0) as v from (select distinct user_id % {SUBJECTS} as subject from events) s
                  cross join {_NODES} cross join {_GRID}
                  left join events e on e.user_id % {SUBJECTS} = s.subject and e.event_type = n.node and {_BIN} = g.bin group by 1, 2, 3)"""


def seconds(column: str = "ts"):
    """Seconds since 1970 as a double."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) / 1000000.0D")


def _filled(e: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, v, bins: sums of value per cell of the grid keys x bins; ``bins`` is their number."""
    sums = e.groupBy(*keys, "bin").agg(F.sum("value").alias("v"))
    grid = e.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).filter("lo is not null").select("lo", "hi", F.explode(F.sequence("lo", "hi")).alias("bin"))
    for k in keys:
        grid = grid.crossJoin(F.broadcast(e.select(k).filter(F.col(k).isNotNull()).distinct()))  # a grid is what is asked for; types and subjects are few
    return grid.join(sums, [*keys, "bin"], "left").select(*keys, (F.col("bin") - F.col("lo")).alias("t"), F.coalesce("v", F.lit(0.0)).alias("v"), (F.col("hi") - F.col("lo") + 1).alias("bins"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_type").alias("node"), (F.col("user_id") % SUBJECTS).alias("subject"), F.floor((seconds() - 1704067200) / BIN_S).cast("long").alias("bin"), "value")


def series(spark: SparkSession, folder: str) -> DataFrame:
    """node, t, v, bins: summed event values per type and bin, 0 where there are none."""
    return _filled(_events(spark, folder).drop("subject"), ["node"])


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """subject, node, t, v: the same per subject."""
    return _filled(_events(spark, folder), ["subject", "node"]).drop("bins")
