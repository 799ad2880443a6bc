"""Document fingerprints by consistent weighted sampling.

Method. A text is a set of terms (64-bit hashes of shingles of two words)
weighted by how often they occur; a text of one word is that word, and one without words counts by its length alone. For each of m samples every term has gamma variates r, c of shape 2 and a
uniform b, all drawn from the term alone; with t = floor(ln w / r + b) and
a = c * exp(-r * (t - b) - r) the sample is the (term, t) of smallest a. Two texts agree in
a sample with probability equal to their generalised Jaccard similarity sum min / sum max.
The variates of a term are uniforms hashed from the whole term and the sample's number (gamma: -ln(u1 * u2)),
drawn anew for each group of texts, so there is no table and terms don't share variates however long a text is.
A fingerprint is m samples of four hex digits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweft.llm._shared import LOWER, U64, Scratch, mix64, row_bounds, sliding_hash, span_hashes, utf8, word_spans

SAMPLES = 64
#: Terms whose variates are drawn at a time, and those of neighbouring texts that are held at a time.
BLOCK, TOGETHER = 1024, 32768
_STEP = U64(0xD1342543DE82EF95)


def _variates(terms: np.ndarray, m: int):
    """r, b and ln c - r + r*b per term and sample."""
    with np.errstate(over="ignore"):
        h = terms[:, None] + np.arange(1, 2 * m + 1, dtype=U64) * _STEP
        h2 = np.right_shift(h, U64(30))  # mix64 in place
        h ^= h2
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= np.right_shift(h, U64(27), out=h2)
        h *= U64(0x94D049BB133111EB)
        h ^= np.right_shift(h, U64(31), out=h2)
    v = h.view(np.uint32)  # four draws per sample
    # Odd numbers of 24 bits are exact, and neither 0 nor 1 after scaling; b is made of what they leave.
    odd = np.right_shift(v, np.uint32(8), out=h2.view(np.uint32))
    odd |= np.uint32(1)
    u = odd.view(np.int32).astype(np.float32)
    u *= np.float32(2**-24)
    b = v[:, :m] << np.uint32(16)
    b ^= v[:, m : 2 * m] << np.uint32(8)
    b ^= v[:, 2 * m : 3 * m]
    b &= np.uint32(0xFFFFFF)
    b = b.view(np.int32).astype(np.float32)
    b *= np.float32(2**-24)
    r = u[:, :m] * u[:, m : 2 * m]
    c = u[:, 2 * m : 3 * m] * u[:, 3 * m :]
    np.log(r, out=r)
    np.log(c, out=c)
    np.negative(c, out=c)
    np.log(c, out=c)
    c += r
    c -= r * b
    return np.negative(r, out=r), b, c


def weighted_terms(texts: pa.Array, width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, ascending in each row, counts and row bounds. Texts of fewer words are one term; without words, their own bytes are."""
    raw, off = utf8(texts)
    rows = len(off) - 1
    start, end, row = word_spans(LOWER[raw], off)
    words = span_hashes(LOWER[raw], start, end)
    grams = sliding_hash(words, width)
    inside = row[: len(grams)] == row[width - 1 :] if len(grams) else np.zeros(0, bool)
    of, grams = row[: len(inside)][inside], grams[inside]
    few = np.flatnonzero(np.bincount(row, minlength=rows) < width)
    if len(few):
        bounds = row_bounds(row, rows)
        # A single word, or a blank text as it is; an empty text has no term.
        lone = np.array([words[bounds[i]] if bounds[i + 1] > bounds[i] else U64(off[i + 1] - off[i]) for i in few], U64)
        some = (off[few + 1] - off[few]) > 0
        of, grams = np.concatenate([of, few[some]]), np.concatenate([grams, lone[some]])
        order = np.argsort(of, kind="stable")
        of, grams = of[order], grams[order]
    to = row_bounds(of, rows)
    for i in np.flatnonzero(np.diff(to) > 1):  # row by row: a sort of plain numbers is far quicker than one by two keys
        grams[to[i] : to[i + 1]].sort()
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return grams[at], np.diff(at, append=len(of)), row_bounds(of[at], rows)


def _drawn(terms: np.ndarray, m: int):
    """The variates of many terms, drawn a block at a time."""
    out = tuple(np.empty((len(terms), m), np.float32) for _ in range(3))
    for lo in range(0, len(terms), BLOCK):
        for whole, part in zip(out, _variates(terms[lo : lo + BLOCK], m)):
            whole[lo : lo + BLOCK] = part
    return out


def _least(w: np.ndarray, r: np.ndarray, b: np.ndarray, a: np.ndarray, at: np.ndarray | None = None):
    """Per sample the place of the smallest a among terms of weights ``w``, that a, and its t; term i's variates stand at ``at[i]`` (or i)."""
    m = a.shape[1]
    a = a.copy() if at is None else a[at]
    many = np.flatnonzero(w > 1)  # else ln w is 0, so t is 0 as b is below 1
    mine = many if at is None else at[many]
    t = np.floor(np.log(w[many]).astype(np.float32)[:, None] / r[mine] + b[mine])
    a[many] -= r[mine] * t
    pick, cols, step = a.argmin(0), np.arange(m), np.zeros(m, U64)
    if len(many):
        where = np.full(len(w), -1)
        where[many] = np.arange(len(many))
        row = where[pick]
        step = np.where(row >= 0, t[np.maximum(row, 0), cols], 0).astype(U64)
    return pick, a[pick, cols], step


def signatures(texts: pa.Array, m: int = SAMPLES) -> np.ndarray:
    """uint16 samples, one row per text. Zeros stand for an empty text; no sample of a text is zero.

    Neighbouring texts are taken together, so that a term that several of them have is drawn once; a long text stands alone, in blocks.
    """
    terms, count, bounds = weighted_terms(texts)
    out = np.zeros((len(bounds) - 1, m), np.uint16)

    def named(best: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return (mix64(best ^ mix64(steps + U64(1))) >> U64(48)).astype(np.uint16) | np.uint16(1)

    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + TOGETHER, side="right")) - 1)
        lo, hi = bounds[first], bounds[last]
        if hi - lo > TOGETHER:
            best_a, best, steps = np.full(m, np.inf, np.float32), np.zeros(m, U64), np.zeros(m, U64)
            for at in range(lo, hi, BLOCK):
                j = terms[at : min(at + BLOCK, hi)]
                pick, low, step = _least(count[at : at + len(j)], *_variates(j, m))
                new = low < best_a  # of equal ones the smallest term stays, whatever else is in the text
                best_a[new], best[new], steps[new] = low[new], j[pick][new], step[new]
            out[first] = named(best, steps)
        elif hi > lo:
            own, at = np.unique(terms[lo:hi], return_inverse=True)
            drawn = _drawn(own, m)
            for i in range(first, last):
                x, y = bounds[i], bounds[i + 1]
                if y > x:
                    pick, _, step = _least(count[x:y], *drawn, at[x - lo : y - lo])
                    out[i] = named(terms[x:y][pick], step)
        first = last
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples; two empty texts are alike."""
    return (a == b).mean(axis=1)


def _hex(signature: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in signature]


def fingerprint(docs: DataFrame, m: int = SAMPLES) -> DataFrame:
    """``docs`` (any columns, with ``text``; null: empty) and a column fingerprint; one of that name is replaced. One pass, no shuffle."""
    docs = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenweft.llm._shared import slices

        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([*part.columns, pa.array(_hex(signatures(part.column(part.schema.get_field_index("text")), m)), pa.string())], names=[*part.schema.names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(ids: list, texts: list[str], following: list[str], m: int, id_type: pa.DataType) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following)]
    # Most following texts are the next row's own. A text stands beside its edited one, which has terms of it and of the next.
    shift = texts[1:] == following[:-1]
    both = signatures(pa.array([x for pair in zip(texts, changed) for x in pair] + (following[-1:] if shift else following), pa.string()), m)
    mine, other = both[: 2 * len(texts) : 2], both[1 : 2 * len(texts) : 2]
    then = np.concatenate([mine[1:], both[-1:]]) if shift else both[2 * len(texts) :]
    return pa.record_batch(
        [pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(_hex(mine)), pa.array(_hex(other)), pa.array(likeness(mine, other)), pa.array(likeness(mine, then))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


RESULT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, scratch: Scratch, m: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text (see ``edited``), by ascending doc_id, nulls first; equal ids by the hash of their texts.

    Texts are range-partitioned once. A task knows the next row of all but its last row; the first and the last
    text of each partition are kept aside and meet in a second, small step.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = pa.string() if id_type == "string" else pa.int64()
    names = [f.split()[0] for f in RESULT.format(id=id_type).split(", ")]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0

        def edge(kind: str, row: tuple) -> pa.RecordBatch:
            cols = {n: pa.nulls(1, t) for n, t in zip(names, (arrow_id, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))}
            cols["doc_id"] = pa.array([row[0]], arrow_id)
            return pa.record_batch([*cols.values(), pa.array([part], pa.int32()), pa.array([kind]), pa.array([row[1]], pa.string())], names=[*names, "part", "edge", "edge_text"])

        def done(rows: list[tuple]) -> pa.RecordBatch:
            ids, texts = zip(*rows)
            out = _compare(list(ids[:-1]), list(texts[:-1]), list(texts[1:]), m, arrow_id)
            n = out.num_rows
            return pa.record_batch([*out.columns, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[*names, "part", "edge", "edge_text"])

        begun = False
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist()):
                if not begun:
                    begun = True
                    yield edge("first", row)
                held.append(row)
                size += len(row[1])
                if size > 1 << 19 and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(held[-1][1])
        if begun:
            if len(held) > 1:
                yield done(held)
            yield edge("last", held[-1])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, c = (batch.column(x)[i].as_py() for x in ("doc_id", "edge_text", "next_text"))
                yield _compare([a], [b], [c], m, arrow_id)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = RESULT.format(id=id_type)
    rows = scratch.table(ordered.mapInArrow(first, f"{kind}, part int, edge string, edge_text string"), "rows")
    scratch.release()
    # Two rows per partition: each last one meets the first one of the next partition that has rows, the very last one the very first.
    ends = rows.filter("edge is not null").select("part", "edge", "doc_id", "edge_text")
    parts = ends.filter("edge = 'first'").select("part", F.col("edge_text").alias("next_text"))
    order = sorted(r.part for r in parts.select("part").toLocalIterator())
    follows = dict(zip(order, order[1:] + order[:1]))
    if not follows:
        return rows.select(*names)
    link = docs.sparkSession.createDataFrame([(a, b) for a, b in follows.items()], "part int, next_part int")
    pairs = ends.filter("edge = 'last'").join(link, "part").join(parts.withColumnRenamed("part", "next_part"), "next_part")
    return rows.filter("edge is null").select(*names).unionByName(pairs.select("doc_id", "edge_text", "next_text").mapInArrow(second, kind))
