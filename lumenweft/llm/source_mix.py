"""Sources mixed to target weights along a time-varying curriculum, in DataFrame operations only.

Method. Each source has a weight schedule over training time 0..1, a line with mean 1;
its integral G gives the share of the source's words due by time t. Documents of a
source stand in the order of the md5 of their doc_id and text; the words before a document (over repeats, too) are its
place in the source's demand, and inverting G turns that into a training
position. A copy is taken if its place is within the target, so that its position is 1 at most. Documents are range-sorted by position.

Targets. Sources by code point, null last, have weights 5, 2, 1, repeating. Shares of all
words above ``most`` times a source's size are cut there and shared again by weight, which ends at target = min(cap,
level * weight); the level is found in one pass over the sources ordered by cap / weight.

Scale. A source may hold most rows, so running sums are made in two steps: sums per (source, hash range), a
window over these few ranges, and a window inside each range. One-row-per-source tables are the
only ones handled in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweft.llm._shared import Scratch

WEIGHTS = (5, 2, 1)
#: Start and end of each weight's schedule: heavy sources come early, light ones late.
RAMPS = ((1.4, 0.6), (1.0, 1.0), (0.6, 1.4))
MOST = 3
#: Hash ranges per source: as many leading hexadecimal digits, and more where a range of the largest possible source would pass these rows.
RANGE_DIGITS, RANGE_ROWS = 3, 1 << 20


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, ramps: tuple = RAMPS) -> DataFrame:
    """``sizes``: source, source_size. Adds weight, target (double), ramp_from, ramp_to. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("turn"))
    s = sizes.withColumn("turn", turn).withColumns({"weight": at(weights), "ramp_from": at([a for a, _ in ramps]), "ramp_to": at([b for _, b in ramps]), "cap": most * F.col("source_size")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumns({
        "place": F.row_number().over(order),
        "capped": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(every),
    })
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))
    s = s.withColumn("cut", F.min(fits).over(every))
    target = F.when(F.col("place") < F.col("cut.place"), F.col("cap").cast("double")).otherwise(F.col("cut.level") * F.col("weight"))
    return s.select("source", "source_size", "weight", "ramp_from", "ramp_to", target.alias("target"))


def mix_plan(docs: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, most: int = MOST, ramps: tuple = RAMPS) -> DataFrame:
    """doc_id, source, size, source_size, target, positions, copies, taken: one row per document, sorted by its first position.

    ``copies`` (0 up to ``most``) whole passes of the document are taken, at the training positions
    ``positions`` (0..1, ascending); a source's sum of taken words differs from its target by less than one
    document. Null texts have size 0 and are never taken. The order follows from the rows
    alone, so reruns agree; rows with equal doc_id, text and source are interchangeable. Other columns take no part.
    """
    plan = _plan(docs.select("doc_id", "text", "source"), scratch, weights, most, ramps)
    # Rows that aren't taken are spread behind the others.
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0) + F.conv(F.substring("place", 1, 8), 16, 10).cast("double"))
    plan = plan.withColumn("first", first).repartitionByRange("first", "place").sortWithinPartitions("first", "place")
    return plan.select("doc_id", "source", "size", "source_size", "target", "positions", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _plan(rows: DataFrame, scratch: Scratch, weights: tuple, most: int, ramps: tuple) -> DataFrame:
    """``rows``: doc_id, text, source and others. All but text, with place, size, source_size, target, positions, copies."""
    words = F.split(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", " " * 5), " ")
    size = F.size(F.filter(words, lambda w: w != "")).cast("long")
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    # Keys that equal themselves: null sources must join, too.
    sized = rows.withColumns({"size": size, "place": place, "named": F.col("source").isNotNull(), "key": F.coalesce("source", F.lit(""))}).drop("text", "source")
    sized = scratch.table(sized, "sized")
    digits = max(RANGE_DIGITS, math.ceil(math.log(max(1, sized.count() / RANGE_ROWS), 16)))
    sized = sized.withColumn("range", F.substring("place", 1, digits))
    parts = scratch.table(sized.groupBy("named", "key", "range").agg(F.sum("size").alias("words")), "parts")
    sums = parts.groupBy("named", "key").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("named"), F.col("key")))
    targets = source_targets(sums.select("source", "source_size"), weights, most, ramps)
    targets = scratch.table(targets.withColumns({"named": F.col("source").isNotNull(), "key": F.coalesce("source", F.lit(""))}).drop("source"), "targets")
    before = Window.partitionBy("named", "key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.table(parts.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).join(targets, ["named", "key"]), "placed")
    inside = Window.partitionBy("named", "key", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(parts, ["named", "key", "range"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    middle = F.col("start") + F.col("size") / 2.0

    def position(j):
        """Where copy j stands: G(t) = from * t + (to - from) / 2 * t * t, inverted at the demand met by then."""
        share = (j * F.col("source_size") + middle) / F.col("target")
        return 2 * share / (F.col("ramp_from") + F.sqrt(F.col("ramp_from") * F.col("ramp_from") + 2 * (F.col("ramp_to") - F.col("ramp_from")) * share))

    due = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: j * F.col("source_size") + middle <= F.col("target"))
    positions = F.when(F.col("size") > 0, F.transform(due, position)).otherwise(F.array().cast("array<double>"))
    placed = placed.withColumn("positions", positions).withColumn("copies", F.size("positions"))
    return placed.withColumn("source", F.when(F.col("named"), F.col("key"))).drop("named", "key", "range", "words", "base", "start", "weight", "ramp_from", "ramp_to")


def mixed_stream(docs: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, most: int = MOST, ramps: tuple = RAMPS) -> DataFrame:
    """``docs`` (any columns, with doc_id, text, source) as the mix trains on them: each row as often as the plan takes that row, range-sorted by training position."""
    rows = scratch.table(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    plan = _plan(rows.select("rid", "row.doc_id", "row.text", "row.source"), scratch, weights, most, ramps)
    plan = scratch.table(plan.filter("copies > 0").select("rid", "place", "positions"), "plan")
    scratch.release()
    stream = rows.join(plan, "rid").select("row", "place", F.explode("positions").alias("position"))
    return stream.repartitionByRange("position", "place").sortWithinPartitions("position", "place").select("row.*")
