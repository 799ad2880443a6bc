"""Exact inner-product top-k with KD-trees per shard.

Method. A task reads its partition of the vectors, in shards of bounded size, and builds a KD-tree on
each: median splits on the widest side, each node with the tight bounding box of
its points. The bound of a box is the largest inner product that any point in it can have. A group of queries that lie
close together (whose best leaves are neighbours) walks a tree together, best first: nodes wait in a heap by the largest bound
that one of the group's queries has there, each query stays with a node only while its bound isn't below its kth score so
far, and a leaf is multiplied with all queries that stay at once. The kth scores are carried from tree to tree.
Ties are kept alive (a box is left only if its bound is smaller), so that
the smallest id wins them. Queries lie in the shared folder and are read block by block; nothing is broadcast. A task holds
the trees of its own partition (its vectors as 64-bit integers or, where that is exact, as doubles) and one block of queries;
each returns k rows per query and Spark merges them.

Cost. Boxes prune where vectors lie in few dimensions or in clusters. With dozens of independent dimensions a box's
bound is far above any point in it, and every leaf is read: then this is a scan by matrix products. ``Tree.read`` counts the leaf
rows that queries were held against.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweft.llm._shared import Scratch
from lumenweft.llm.token_stream import filesystem

LEAF = 256
SHARD_ROWS = 65_536
QUERY_BLOCK = 1024
#: Queries that walk a tree together.
GROUP = 64
#: The id of a place without a result; no row has it, as it is left out of the vectors.
NONE = np.iinfo(np.int64).max


class Tree:
    """A KD-tree over integer vectors; ``vectors`` are reordered so that each node is a range."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right
        lows, highs, todo = [], [], [(0, len(ids), -1, False)]
        while todo:
            a, b, parent, right = todo.pop()
            part = vectors[order[a:b]]
            lo, hi = part.min(0), part.max(0)
            me = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            lows.append(lo)
            highs.append(hi)
            if parent >= 0:
                x = self.nodes[parent]
                self.nodes[parent] = (*x[:3], me) if right else (*x[:2], me, x[3])
            if b - a > leaf and (hi > lo).any():
                axis, mid = int((hi - lo).argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
                todo += [(a, a + mid, me, False), (a + mid, b, me, True)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.largest = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))
        self.low, self.high = np.array(lows), np.array(highs)
        self.leaves = np.array([i for i, x in enumerate(self.nodes) if x[2] < 0])
        self.read = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, queries: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges into ``scores`` and ``ids`` (one row of k per query, best first) what the tree has for each query; free places have the id NONE."""
        bound = self.bounds(queries)
        near = np.argsort(self.leaves[bound[:, self.leaves].argmax(1)], kind="stable")
        for at in range(0, len(near), GROUP):
            g = near[at : at + GROUP]
            self._walk(queries[g], own[g], bound[g], g, scores, ids)

    def _walk(self, queries, own, bound, rows, scores, ids) -> None:
        k = scores.shape[1]
        heap = [(-bound[:, 0].max(), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            stay = np.flatnonzero((ids[rows, k - 1] == NONE) | (bound[:, node] >= scores[rows, k - 1]))
            if not len(stay):
                continue
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-bound[stay, child].max(), child))
                continue
            self.read += (b - a) * len(stay)
            found = (queries[stay] @ self.vectors[a:b].T).astype(scores.dtype, copy=False)
            mine = np.broadcast_to(self.ids[a:b], found.shape)
            # A query's own row goes behind all others; of equal scores the smallest ids come first.
            free = mine == own[stay][:, None]
            r = rows[stay]
            good = ((found >= scores[r, k - 1][:, None]) | (ids[r, k - 1] == NONE)[:, None]) & ~free
            some = np.flatnonzero(good.any(1))
            if not len(some):
                continue
            r = r[some]
            all_scores = np.concatenate([scores[r], found[some]], axis=1)
            all_ids = np.concatenate([ids[r], np.where(good[some], mine[some], NONE)], axis=1)
            top = np.lexsort((all_ids, -all_scores, all_ids == NONE), axis=1)[:, :k]
            scores[r], ids[r] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)


def whole_numbers(column: str, scale: int = 256):
    """floor(scale * x) of each component as longs; null where a vector is null or has a null or non-finite component."""
    x = F.transform(column, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return F.when(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)), x)


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the lengths of its lists."""
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def _exact(vectors: np.ndarray, other: int) -> np.ndarray:
    """As doubles if every inner product stays below 2**53, else as 64-bit integers; an error where these could overflow."""
    top = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))) * max(1, other) * vectors.shape[1]
    if top >= 1 << 63:
        raise OverflowError("inner products of these vectors can pass 64 bits")
    return vectors.astype(np.float64) if top < 1 << 53 else vectors


def top_k(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with all other rows.

    Both have vec_id (long) and v (array<long>). Rows with the query's own vec_id are never its
    results; repeated rows count as rows, a repeated query is one query per different
    vector. Ties go to the smaller vec_id. Null ids or vectors take no part; vectors of other lengths than the query's neither.
    The id 2**63 - 1 is reserved. Vectors so large that a product could pass 64 bits are an error.
    """
    asked = queries.filter("vec_id is not null and v is not null and size(v) > 0").select("vec_id", "v").dropDuplicates()
    scratch.table(asked, "queries")
    folder = f"{scratch.path}/queries"

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fs, root = filesystem(folder)
        files = sorted(x.path for x in fs.get_file_info(pa.fs.FileSelector(root)) if x.path.endswith(".parquet"))
        for path in files:
            with fs.open_input_file(path) as f:
                for batch in pa.parquet.ParquetFile(f).iter_batches(batch_size=QUERY_BLOCK, columns=["vec_id", "v"]):
                    flat, size = _matrix(batch.column("v"))
                    ids, ends = batch.column("vec_id").to_numpy(), np.cumsum(size)
                    for n in np.unique(size):
                        rows = np.flatnonzero(size == n)
                        yield ids[rows], np.stack([flat[ends[r] - n : ends[r]] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, list[Tree]] = {}
        held: dict[int, list] = {}

        def build(n: int) -> None:
            ids, parts = zip(*held.pop(n))
            trees.setdefault(n, []).append(Tree(np.concatenate(ids), np.concatenate(parts)))

        for batch in batches:
            flat, size = _matrix(batch.column("v"))
            ids, ends = batch.column("vec_id").to_numpy(), np.cumsum(size)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                part = flat.reshape(-1, n) if len(rows) == len(size) else np.stack([flat[ends[r] - n : ends[r]] for r in rows])
                held.setdefault(int(n), []).append((ids[rows], part))
                if sum(len(x) for x, _ in held[n]) >= shard_rows:
                    build(int(n))
        for n in list(held):
            build(n)
        if not trees:
            return
        for ids, vectors in blocks():
            scores, found = np.zeros((len(ids), k)), np.full((len(ids), k), NONE)
            for tree in trees.get(vectors.shape[1], []):
                q = _exact(vectors, tree.largest)
                tree.vectors = tree.vectors.astype(q.dtype, copy=False)
                if q.dtype != scores.dtype:  # from here on whole numbers
                    scores = scores.astype(np.int64)
                tree.search(q, ids, scores, found)
            # The vector's hash keeps different vectors of one id apart.
            rows, places = np.nonzero(found != NONE)
            if len(rows):
                keys = np.array([_key(v) for v in vectors], np.int64)
                yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (ids[rows], keys[rows], found[rows, places], scores[rows, places])], names=["query_id", "key", "vec_id", "score"])

    usable = vectors.filter(f"vec_id is not null and vec_id != {NONE} and v is not null and size(v) > 0").select("vec_id", "v")
    found = usable.mapInArrow(run, "query_id long, key long, vec_id long, score long")
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _key(vector: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(vector, "<i8").tobytes())
