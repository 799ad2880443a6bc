"""Bounded-space online best-fit packing of token sequences.

Method. Items arrive one after another. At most ``open_bins`` bins are open. A
bitset keyed by free space tells at once the smallest free space that still
takes the item (best fit); where no bin does, a new one opens, and if all are
taken the fullest one closes first. Full bins close by themselves. Longer documents are cut into pieces
of the capacity with the short piece first, so only that first piece and shorter documents are packed;
a piece of the full capacity is a sequence of its own.

Scale. Tokens never move: a task turns texts into small piece rows, which are dealt
by hash over packing tasks, each with its own bins. A task's memory is its open
bins; the cost of splitting is at most the unfilled open bins of each task. Items arrive in
rounds dealt by hash, in each the longest first: a round has about as many items as bins may be open, so its short items
still find the gaps that its long ones left. (With all of a task's items by length, bins would close before.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweft.llm._shared import Scratch, row_tags, slices
from lumenweft.llm.token_stream import END, encoder, ids_crc32

OPEN_BINS = 4096
#: Items that a packing task gets; enough that its last open bins don't count.
ITEMS_PER_TASK = 60_000


class BestFit:
    """The open bins: stacks of bin numbers by free space, and a bitset of the spaces in use."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.count = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1 up to ``capacity`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(number)
            self.bits |= 1 << rest
            self.count += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the short one first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]] if n else []


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pieces of every text (null: empty) with the end id: doc_id, row_tag, piece, start, length, ids_crc32."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = enc.dtype.type(END).tobytes()
        for batch in batches:
            for part in slices(batch):
                of, piece, start, length, crc = [], [], [], [], []
                for i, data in enumerate(enc.encode(part.column("text").to_pylist())):
                    ids = np.frombuffer(data + end, enc.dtype).astype("<u4")
                    for k, (s, n) in enumerate(cut_points(len(ids), capacity)):
                        of.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(ids_crc32(ids[s : s + n]))
                take = pa.array(of, pa.int64())
                yield pa.record_batch(
                    [part.column("doc_id").take(take), part.column("tag_a").take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "row_tag", "piece", "start", "length", "ids_crc32"],
                )

    tagged = docs.select("doc_id", "text").withColumns(row_tags()).select("doc_id", "tag_a", "text")
    return tagged.mapInArrow(run, f"doc_id {id_type}, row_tag long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: DataFrame, capacity: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """``items`` (any columns, ``length`` from 1 to capacity) with sequence_id and offset; columns of these names are replaced.

    Every partition is packed by itself in its own order; sequence_id holds the partition in its upper bits.
    """

    items = items.drop("sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            numbers, offsets = np.array(placed, np.int64).reshape(-1, 2).T
            yield pa.record_batch([*batch.columns, pa.array(numbers + base), pa.array(offsets)], names=[*batch.schema.names, "sequence_id", "offset"])

    return items.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, scratch: Scratch, tokenizer: str, capacity: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id. Repeated rows are packed as rows of their own.
    """
    pieces = scratch.table(token_pieces(docs, tokenizer, capacity), "pieces")
    small = pieces.filter(F.col("length") < capacity)
    items = small.count()
    tasks = max(1, round(items / ITEMS_PER_TASK))
    turn = F.pmod(F.xxhash64("piece", "ids_crc32", "row_tag"), F.lit(max(1, round(items / tasks / open_bins))))
    # The order inside a task follows from the rows, so a task that runs again packs alike.
    dealt = small.repartition(tasks, F.xxhash64("row_tag", "piece", "length", "ids_crc32")).sortWithinPartitions(turn, F.desc("length"), F.xxhash64("row_tag", "piece"), "ids_crc32")
    packed = best_fit(dealt, capacity, open_bins)
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole).drop("row_tag")
