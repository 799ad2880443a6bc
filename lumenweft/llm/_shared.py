"""Arrow text kernels and shared-storage scratch tables used by the operators.

Text work runs on the UTF-8 bytes of an Arrow column with numpy, one bounded
slice at a time; no Python object is made per word.
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows an Arrow batch holds at most; with long documents the default of 10000 is too large for a worker.
ARROW_ROWS = 512
#: Bytes of text that the kernels take at a time.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What separates words made of ASCII letters, digits and all non-ASCII characters.
NON_WORD = np.ones(256, dtype=bool)
NON_WORD[0x30:0x3A] = NON_WORD[0x41:0x5B] = NON_WORD[0x61:0x7B] = NON_WORD[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, applied to a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64)) | U64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, dtype=U64), np.full(size, _INV, dtype=U64)
            up[0] = down[0] = 1
            got = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size > 4 * SLICE_BYTES:  # an odd giant; not kept
            return got
        _powers[size] = got
    return _powers[size]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text; a longer text stands alone."""
    _, off = utf8(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(raw: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~breaks[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    heads = off[:-1][off[:-1] < n]
    first[heads] = word[heads]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = word[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes in every run and worker."""
    if len(start) == 0:
        return np.zeros(0, U64)
    out, at, step = np.empty(len(start), U64), 0, SLICE_BYTES
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + step, side="right")))
            lo, hi = int(start[at]), int(end[to - 1])
            up, down = powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, U64)
            np.cumsum(_BYTE[raw[lo:hi]] * up[: hi - lo], out=total[1:])
            s, e = start[at:to] - lo, end[at:to] - lo
            out[at:to] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(U64))
            at = to
    return out


def row_bounds(row_of: np.ndarray, rows: int) -> np.ndarray:
    """For sorted row numbers, where each row's items begin (rows + 1)."""
    return np.searchsorted(row_of, np.arange(rows + 1), side="left")


def sliding_hash(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive 64-bit items."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        up, down = powers(len(items) + 1)
        total = np.zeros(len(items) + 1, U64)
        np.cumsum(items * up[: len(items)], out=total[1:])
        return mix64((total[width:] - total[:-width]) * down[:n])


def prepare(spark: SparkSession) -> SparkSession:
    """Let workers import this package, and keep Arrow batches small. Returns the session."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if all tasks run in this process (tests); on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lumenweft-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


class Scratch:
    """Tables written once to the shared folder, so that lineage ends there and lost executors cost no more than a reread.

    They are removed when the driver's JVM ends, or by drop("").
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = prepare(spark), f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def row_tags(prefix: str = "") -> dict:
    """tag_a, tag_b: 128 bits that name a row by its doc_id and text; equal rows have equal tags."""
    key, text = F.col(f"{prefix}doc_id"), F.col(f"{prefix}text")
    return {"tag_a": F.xxhash64(key, text), "tag_b": F.xxhash64(F.lit(0x5EED), text, key)}


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
