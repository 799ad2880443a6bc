"""Near-duplicate detection from bottom-k sketches of one hash function.

Method. A document is the set of its distinct word shingles; its sketch keeps
the ``k`` smallest hashes of one function. Documents with equal sets form a
class and go on as one member. Inverted lists of the retained values give the
overlaps: values are ordered rarest first, and a pair at the threshold shares
at least ``l`` values of its two prefixes (prefix filter over sketches; the
margin is six standard deviations below the sketch's expectation, sets of fewer
than ``k`` shingles are exact). Short lists give pairs that share enough lists;
in a long list every member is held against one pivot, so a group of n copies
gives n links and not n**2. Members of lists that are not in one component yet are compared
across components by prefixes of their whole sets, an exact filter: the smaller set of a pair
needs a shared value in its first ninth (at 0.8), the larger in its first fifth, which leaves out, before any join, texts
with a larger share of their own. Lists are joined by merging, with tables written before, so that Spark can split a long one. The
union-sketch estimate drops what is clearly below the threshold; the exact Jaccard
index on full shingle sets, made anew from the text, confirms the rest.
Components come from minimum labels with pointer jumping over DataFrames.

Defined results: null or blank texts have an empty set and no links; a text with
fewer words than the shingle length is one shingle; repeated rows and ids are
rows of their own and share a component; a null doc_id counts as larger than any id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm._shared import LOWER, U64, Scratch, mix64, row_bounds, row_tags, slices, sliding_hash, span_hashes, utf8, word_spans

SKETCH = 64
MARGIN = 0.5  # share of a sketch that two documents at the threshold have in common, with six standard deviations to spare
SHARED = 3  # lists that a pair from short lists must share
SHORT_LIST = 10
MERGE_ROUNDS = 1
PARTNERS = 8  # pairs tried per member in a merge round


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending, and the row bounds."""
    rows = len(off) - 1
    raw = LOWER[raw]
    start, end, row = word_spans(raw, off)
    words = span_hashes(raw, start, end)
    bounds = row_bounds(row, rows)
    count = np.diff(bounds)
    grams = sliding_hash(words, width)
    inside = row[: len(grams)] == row[width - 1 :] if len(grams) else np.zeros(0, bool)
    grams, of = grams[inside], row[: len(inside)][inside]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        with np.errstate(over="ignore"):
            whole = np.array([mix64(sliding_hash(words[bounds[i] : bounds[i + 1]], int(count[i])) + U64(count[i]))[0] for i in few], U64)
        grams, of = np.concatenate([grams, whole]), np.concatenate([of, few])
    grams = mix64(grams)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, row_bounds(of, rows)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Hashes with the sign bit flipped, so that Spark's signed order is their unsigned one."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((values ^ U64(1 << 63)).view(np.int64)))


def _sketch(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams, bounds = shingle_sets(*utf8(part.column("text")), width)
                size = np.diff(bounds)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[U64(0)], np.cumsum(mix64(grams ^ U64(s)))]) for s in (0x1B873593, 0xCC9E2D51)]
                a, b = (mix64(x[bounds[1:]] - x[bounds[:-1]] + size.astype(U64)).view(np.int64) for x in sums)
                place = np.arange(len(grams)) - np.repeat(bounds[:-1], size)
                kept = grams[place < k]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("tag_a"), part.column("tag_b"), pa.array(size), pa.array(a), pa.array(b), _lists(kept, np.concatenate([[0], np.cumsum(np.minimum(size, k))]))],
                    names=["doc_id", "tag_a", "tag_b", "n_shingles", "set_a", "set_b", "sketch"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams, bounds = shingle_sets(*utf8(part.column("text")), width)
                yield pa.record_batch([part.column("node"), _lists(grams, bounds)], names=["node", "grams"])

    return run


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge; edges has columns a, b."""
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        new = labels.join(near, "node").select("node", F.least("root", "r").alias("to"), F.col("root").alias("was"))
        new = scratch.table(new, f"{name}-{step}-to")
        jump = new.select(F.col("node").alias("to"), F.col("to").alias("over"))
        moved = scratch.table(new.join(jump, "to").select("node", F.least("to", "over").alias("root"), "was"), f"{name}-{step}")
        done = moved.filter("root != was").isEmpty()
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-to")
        labels = moved.select("node", "root")
        if done:
            return labels


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, threshold: float = 0.8, k: int = SKETCH) -> DataFrame:
    """One row per document: doc_id, tag_a, tag_b, n_shingles, node, component_id, is_first.

    ``threshold`` is the least Jaccard index of a link, held as a whole percentage.
    ``is_first`` marks exactly one row of every component, one with the smallest doc_id.
    """
    percent = round(100 * threshold)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text").withColumns(row_tags())
    made = base.mapInArrow(_sketch(width, k), f"doc_id {id_type}, tag_a long, tag_b long, n_shingles long, set_a long, set_b long, sketch array<long>")
    rows = scratch.table(made.withColumn("node", F.monotonically_increasing_id()), "rows")
    # Classes of equal sets; the member with the smallest node stands for all.
    classes = scratch.table(rows.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("node").alias("node")).select("node"), "classes")
    heads = scratch.table(rows.join(classes, "node").withColumn("need", F.ceil(F.lit(MARGIN) * F.size("sketch")).cast("int")), "heads")
    sizes = heads.select("node", "n_shingles", "need", F.size("sketch").alias("s"))
    prefix = scratch.table(_prefixes(heads.select("node", F.explode("sketch").alias("v")), sizes), "prefix")
    # The pivot is the member with the fewest values of its own: a text that was copied, rather than an edited copy.
    listed = scratch.table(prefix.groupBy("v").agg(F.count("*").alias("n"), F.min(F.struct("alone", F.xxhash64("node").alias("h"), F.col("node").alias("pivot"), F.col("n_shingles").alias("pn"))).alias("p")).filter("n > 1"), "listed")
    entries = scratch.table(prefix.hint("merge").join(listed, "v").select("v", "node", "n_shingles", "need", "n", "p.pivot", "p.pn"), "entries")

    def alike(x: str, y: str):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    short = entries.filter(F.col("n") <= SHORT_LIST)
    a, b = (short.select("v", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n_shingles", "need")]) for s in "ab")
    pairs = (
        a.join(b, "v").filter((F.col("node_a") < F.col("node_b")) & alike("n_shingles_a", "n_shingles_b"))
        .groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("need_a", "need_b")).alias("need"))
        .filter(F.col("c") >= F.least(F.lit(SHARED), "need")).select("a", "b")
    )

    # A long list's members go with the pivot that most of their long lists have.
    long_lists = entries.filter(F.col("n") > SHORT_LIST)
    hold = long_lists.filter((F.col("node") != F.col("pivot")) & alike("n_shingles", "pn")).groupBy("node", "pivot").agg(F.count("*").alias("c"))
    best = hold.groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("x"))
    stars = best.select(F.least("node", "x.pivot").alias("a"), F.greatest("node", "x.pivot").alias("b"))
    scratch.release()
    tried = scratch.table(pairs.union(stars).distinct(), "tried")
    # The texts that any step from here on can need, shuffled once. How many they are isn't bounded, so they are merged at every size.
    able = tried.select(F.col("a").alias("node")).union(tried.select("b")).union(long_lists.select("node")).distinct()
    able = able.join(heads.select("node", "tag_a", "tag_b"), "node")
    held = scratch.table(base.join(able.hint("merge"), ["tag_a", "tag_b"]).select("node", "text"), "texts")
    scratch.release()
    links = _confirm(held, heads, tried, scratch, width, percent, k, "c0")
    roots = components(scratch, links, "cc0")
    # Long lists whose members are in several components yet: their members are compared by prefixes of whole sets.
    named = scratch.table(long_lists.select("v", "node", "n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    split = scratch.table(named.groupBy("v").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("v"), "split")
    members = scratch.table(named.hint("merge").join(split, "v").select("node", "n_shingles", "root").distinct(), "members")
    scratch.release()
    if not members.isEmpty():
        prefix = _whole_prefixes(held, members, scratch, width, percent)
        for i in range(MERGE_ROUNDS + 1):
            lists = _open_lists(prefix, roots, scratch, f"open{i}")
            if lists.isEmpty():
                break
            more = _across(lists, percent) if i == MERGE_ROUNDS else _nearest(lists, scratch, i)
            found = _confirm(held, heads, more, scratch, width, percent, k, f"m{i}")
            links = scratch.table(links.union(found), f"links{i}")
            roots = components(scratch, links, f"mc{i}")
    # Back to all rows: the root of each class, then the smallest doc_id under each root.
    head_roots = heads.select("set_a", "set_b", "node").join(roots, "node", "left").select("set_a", "set_b", F.coalesce("root", "node").alias("root"))
    full = rows.select("doc_id", "tag_a", "tag_b", "n_shingles", "node", "set_a", "set_b").filter("n_shingles > 0").join(scratch.table(head_roots, "head-roots"), ["set_a", "set_b"])
    full = full.unionByName(rows.filter("n_shingles = 0").select("doc_id", "tag_a", "tag_b", "n_shingles", "node", F.col("node").alias("root")), allowMissingColumns=True)
    full = scratch.table(full.select("doc_id", "tag_a", "tag_b", "n_shingles", "node", "root"), "full")
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    firsts = scratch.table(full.groupBy("root").agg(F.min(last).alias("f")).select("root", F.col("f.doc_id").alias("component_id"), F.col("f.node").alias("first")), "firsts")
    return full.join(firsts, "root").select("doc_id", "tag_a", "tag_b", "n_shingles", "node", "component_id", (F.col("node") == F.col("first")).alias("is_first"))


def _prefixes(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, n_shingles, need, alone, at, v): each set's rarest values, up to its prefix length, without the ``alone`` ones that are in one set only; ``at`` is the place in the set's order.

    ``values``: node, v; ``sizes``: node, n_shingles, need (values that a pair at the threshold shares at least), s (size).
    Two sets that share ``need`` values share min(SHARED, need) values of these prefixes, whatever the common order is.
    """
    often = values.groupBy("v").agg(F.count("*").alias("f")).filter("f > 1")
    shared = values.hint("merge").join(often, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("vs")).join(sizes, "node")
    # Values of one set alone come first in its order; the rest of the prefix is taken from the shared ones.
    room = F.col("s") - F.col("need") + F.least(F.lit(SHARED), F.col("need")) - (F.col("s") - F.size("vs"))
    alone = F.col("s") - F.size("vs")
    opened = shared.filter(room > 0).select("node", "n_shingles", "need", alone.alias("alone"), F.posexplode(F.slice("vs", F.lit(1), room)).alias("i", "x"))
    return opened.select("node", "n_shingles", "need", "alone", (F.col("alone") + F.col("i")).alias("at"), F.col("x.v").alias("v"))


def _whole_prefixes(held: DataFrame, members: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Prefixes of the members' whole sets, made again from the texts.

    A set at the threshold shares percent/100 of its own shingles, so these prefixes are short: a copy that
    was edited in more places than the threshold allows has only shingles of its own there.
    """
    texts = held.join(members.select("node"), "node")
    sets = scratch.table(texts.mapInArrow(_sets(width), "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams")), "whole-sets")
    scratch.release()
    sizes = members.select("node", "n_shingles", F.ceil(F.lit(percent) * F.col("n_shingles") / 100).cast("int").alias("need"), F.col("n_shingles").cast("int").alias("s"))
    prefix = scratch.table(_prefixes(sets.select("node", F.explode("grams").alias("v")), sizes), "whole-prefix")
    scratch.drop("whole-sets")
    scratch.release()
    return prefix


def _open_lists(prefix: DataFrame, roots: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Entries of the lists whose members are in several components, with each member's root and the list's most common one."""
    rooted = scratch.table(prefix.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{name}-rooted")
    per_root = rooted.groupBy("v", "root").agg(F.count("*").alias("c"))
    major = per_root.groupBy("v").agg(F.max(F.struct("c", "root")).alias("x"), F.count("*").alias("roots")).filter("roots > 1").select("v", F.col("x.root").alias("major"))
    return scratch.table(rooted.hint("merge").join(scratch.table(major, f"{name}-major"), "v"), name)


def _nearest(lists: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """A few pairs (a, b) per member outside its list's most common component: enough to merge what is close, linear in the lists.

    A list offers its member with the fewest shingles of its own, inside and outside the most common
    component, and another one drawn anew each turn.
    """
    mine = F.col("root") != F.col("major")
    least, drawn = F.struct("alone", F.xxhash64("node").alias("h"), "node", "root"), F.struct(F.xxhash64("node", "v", F.lit(turn)).alias("h"), "node", "root")
    ends = lists.groupBy("v").agg(F.min(F.when(mine, least)).alias("p"), F.min(F.when(~mine, least)).alias("q"), F.min(F.when(~mine, drawn)).alias("r"))
    ends = ends.select("v", F.explode(F.array(*[F.struct(f"{x}.node", f"{x}.root") for x in "pqr"])).alias("e")).select("v", F.col("e.node").alias("other"), F.col("e.root").alias("other_root"))
    tried = lists.filter(mine).select("v", "node", "root").hint("merge").join(scratch.table(ends, f"ends{turn}"), "v").filter("root != other_root").groupBy("node", "other").agg(F.count("*").alias("c"))
    order = F.struct("c", F.xxhash64("node", "other", F.lit(turn)).alias("h"), "other")
    best = tried.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(order), asc=False), 1, PARTNERS).alias("x"))
    return best.select("node", F.explode("x.other").alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _roles(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(smaller, larger): the entries that can be the first value that a pair shares, in the smaller and in the larger of its sets.

    What stands before that value isn't shared, so at most the rest is. Sets of n and m values share
    percent / (100 + percent) * (n + m) at least: the smaller has a partner of its own size or more, the
    larger one of percent / 100 of its size or more. Both bounds hold for each entry by itself, so they prune before any join.
    """
    rest = (100 + percent) * (F.col("n_shingles") - F.col("at"))
    return entries.filter(rest >= 2 * percent * F.col("n_shingles")), entries.filter(100 * rest >= percent * (100 + percent) * F.col("n_shingles"))


def _across(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that whole sets leave possible.

    In a list, most members are of one component; only the others are held against all.
    """
    smaller, larger = (x.select("v", "major", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n_shingles", "at", "root")]) for x, s in zip(_roles(entries, percent), "ab"))
    lone = [smaller.filter("root_a != major"), larger.filter("root_b != major")]
    pairs = lone[0].hint("merge").join(larger.drop("major"), "v").unionByName(smaller.filter("root_a = major").drop("major").hint("merge").join(lone[1].drop("major"), "v"), allowMissingColumns=True)
    n, m = F.col("n_shingles_b"), F.col("n_shingles_a")
    sized = ((m < n) | ((m == n) & (F.col("node_a") < F.col("node_b")))) & (100 * m >= percent * n)
    # Positional filter: the first shared value leaves enough behind it in both sets.
    enough = (100 + percent) * F.least(m - F.col("at_a"), n - F.col("at_b")) >= percent * (n + m)
    kept = pairs.filter((F.col("root_a") != F.col("root_b")) & sized & enough)
    return kept.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def keep_first(docs: DataFrame, scratch: Scratch, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component; rows that agree in doc_id and text count as copies."""
    kept = scratch.table(near_duplicates(docs, scratch, width, threshold).filter("is_first").select("tag_a", "tag_b").distinct(), "kept")
    scratch.release()
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumns(row_tags("row."))
    return rows.groupBy("tag_a", "tag_b").agg(F.first("row").alias("row")).join(kept, ["tag_a", "tag_b"]).select("row.*")


def _confirm(held: DataFrame, heads: DataFrame, pairs: DataFrame, scratch: Scratch, width: int, percent: int, k: int, name: str) -> DataFrame:
    """The pairs (a, b) at or over the threshold: estimated from the union's sketch, then counted on whole sets."""
    s = heads.select("node", "sketch")
    one = scratch.table(pairs, f"{name}-pairs").join(s.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    two = one.join(s.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    likely = scratch.table(two.filter(both >= F.floor(F.lit(MARGIN) * F.size(union))).select("a", "b"), f"{name}-likely")
    # Full sets, made again from the texts of the documents that are in some pair.
    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    texts = held.join(scratch.table(wanted, f"{name}-wanted"), "node")
    sets = scratch.table(texts.mapInArrow(_sets(width), "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams")), f"{name}-sets")
    near = likely.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    near = near.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    near = near.withColumn("i", F.size(F.array_intersect("ga", "gb"))).withColumn("u", F.size("ga") + F.size("gb") - F.col("i"))
    out = scratch.table(near.filter(100 * F.col("i").cast("long") >= percent * F.col("u").cast("long")).select("a", "b"), name)
    scratch.drop(f"{name}-pairs", f"{name}-likely", f"{name}-wanted", f"{name}-sets")
    scratch.release()
    return out
