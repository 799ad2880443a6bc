"""Repeated passages removed by recompression.

Method. The words of a text are symbols. A round first names each maximal run
of one symbol, then splits the symbols by a hash bit into left and right ones
and names each adjacent (left, right) pair. Names are hashes of what they stand
for, so they are global without a dictionary: the same words get the same name
in every task, and a round needs no shuffle. Whether a symbol inside a window
is formed depends on a few symbols beside it, so away from its two ends every
copy of a window is made of the same high-level symbols. The kernel tracks, for
each window, which symbols follow from the window's own words alone; the longest
of these (ties: smallest name) is the window's anchor. Equal windows have equal anchors, whatever surrounds
them. Spark then counts anchors; only windows whose anchor also stands elsewhere
are verified, by counting (anchor, window hash) keys; both follow from 64-bit hashes of words, and
words aren't compared. Windows without
a sure symbol (inside long runs) are verified directly. No pair of documents or
occurrences is ever formed, so large groups of copies cost their own size only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm._shared import U64, Scratch, mix64, row_bounds, row_tags, slices, sliding_hash, span_hashes, utf8, word_spans

ROUNDS = 4
#: A pair is not joined if it would stand for more words than this.
MAX_SYMBOL = 12


def _doc_heads(row_of: np.ndarray) -> np.ndarray:
    """True where an item is the first of its row."""
    head = np.ones(len(row_of), bool)
    head[1:] = row_of[1:] != row_of[:-1]
    return head


def recompress(words: np.ndarray, row_of: np.ndarray, rounds: int = ROUNDS, cap: int = MAX_SYMBOL):
    """Symbols after the rounds, and for each word position which symbols a window from or to there is sure of.

    Returns (name, first_word, left, right): symbols ``left[i]`` up to and without
    ``right[j]`` are sure for the words i..j-1. ``left`` and ``right`` have one more entry than there are words.
    """
    n = len(words)
    name, first, row = words.copy(), np.arange(n, dtype=np.int64), row_of
    left = right = np.arange(n + 1, dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(rounds):
            # Runs: a run at a window's edge may go on outside, so the first and the last are not sure.
            head = _doc_heads(row)
            head[1:] |= name[1:] != name[:-1]
            at = np.flatnonzero(head)
            run_of = np.append(np.cumsum(head) - 1, len(at))
            count = np.diff(np.append(at, len(name)))
            left = run_of[left] + 1
            right = run_of[np.maximum(right - 1, 0)]
            name, first, row = name[at], first[at], row[at]
            many = count > 1
            name[many] = mix64(name[many] * U64(0xD6E8FEB86659FD93) + count[many].astype(U64) * U64(0xA0761D6478BD642F) + U64(k))
            # Pairs: a right symbol at the front may belong to what stands before it; so may a left one at the end to what follows.
            size = np.diff(np.append(first, n))
            side = (mix64(name + U64(0x632BE59BD9B4E019) * U64(k + 1)) & U64(1)).astype(bool)
            joined = np.zeros(len(name), bool)  # with the next
            if len(name) > 1:
                joined[:-1] = ~side[:-1] & side[1:] & (row[:-1] == row[1:]) & (size[:-1] + size[1:] <= cap)
            keep = np.ones(len(name), bool)
            keep[1:] = ~joined[:-1]
            new_of = np.append(np.cumsum(keep) - 1, int(keep.sum()))
            m = len(name)
            skip = np.append(side, False)
            left = np.minimum(left, m)
            left = new_of[left + skip[left]]
            back = np.maximum(right - 1, 0)
            right = np.where((right > 0) & ~side[back] if m else False, back, right)
            right = new_of[np.minimum(right, m)]
            pair = np.flatnonzero(joined)
            name = name.copy()
            name[pair] = mix64(mix64(name[pair] + U64(0xE7037ED1A0B428DB)) * U64(3) + name[pair + 1])
            name, first, row = name[keep], first[keep], row[keep]
    return name, first, left, right


def window_anchors(words: np.ndarray, row_of: np.ndarray, width: int, rounds: int = ROUNDS):
    """For every window of ``width`` words in one row: its start and its anchor's name and whether it has one."""
    n = len(words)
    start = np.arange(max(0, n - width + 1), dtype=np.int64)
    start = start[row_of[start] == row_of[start + width - 1]] if n >= width else start
    if len(start) == 0:
        return start, np.zeros(0, U64), np.zeros(0, bool)
    name, first, left, right = recompress(words, row_of, rounds)
    size = np.diff(np.append(first, n)).astype(U64)
    # Longer symbols first, then by hash: the largest rank in the sure range is the anchor.
    rank = (np.minimum(size, U64(63)) << U64(58)) | (mix64(name) >> U64(6))
    lo, hi = left[start], right[start + width]
    sure = hi > lo
    best = np.zeros(len(start), U64)
    span = (hi - lo)[sure]
    if len(span):
        l, h, out = lo[sure], hi[sure], np.zeros(int(sure.sum()), U64)
        level, table = 0, rank
        depth = np.floor(np.log2(span)).astype(np.int64)
        while True:
            here = depth == level
            if here.any():
                out[here] = np.maximum(table[l[here]], table[h[here] - (1 << level)])
            if level >= depth.max():
                break
            half = 1 << level
            table = np.maximum(table[: len(table) - half], table[half:])
            level += 1
        best[sure] = out
    return start, best, sure


def _row_anchors(width: int):
    """Per row: words, digest of all of them, distinct anchors and whether windows of an anchor repeat inside the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, off = utf8(part.column("text"))
                start, end, row = word_spans(raw, off)
                words = span_hashes(raw, start, end)
                bounds = row_bounds(row, part.num_rows)
                at, anchor, hashes = _windows(words, row, width)
                of = row[at]
                again = _repeated_within(hashes, of)
                order = np.lexsort((anchor, of))
                a, r, g = anchor[order], of[order], again[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                heads = np.flatnonzero(new)
                many = np.maximum.reduceat(g, heads) if len(heads) else g
                a, r = a[heads], r[heads]
                to = row_bounds(r, part.num_rows).astype(np.int32)
                digests = _digests(raw, off, start, end, row)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("tag_a"), part.column("tag_b"), part.column("text_a"), part.column("text_b"), pa.array(np.diff(bounds)), pa.array(digests),
                     pa.ListArray.from_arrays(pa.array(to), pa.array(a.view(np.int64))), pa.ListArray.from_arrays(pa.array(to), pa.array(many))],
                    names=["doc_id", "tag_a", "tag_b", "text_a", "text_b", "n_words", "whole_sha256", "anchors", "many"],
                )

    return run


def _windows(words: np.ndarray, row: np.ndarray, width: int):
    """Start, anchor and hash of every window; without a sure symbol the window's own hash is the anchor."""
    at, anchor, sure = window_anchors(words, row, width)
    hashes = sliding_hash(words, width)[at] if len(at) else np.zeros(0, U64)
    return at, np.where(sure, anchor, mix64(hashes ^ U64(0x5851F42D4C957F2D))), hashes


def _repeated_within(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    order = np.lexsort((hashes, of))
    h, r = hashes[order], of[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _digests(raw: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> list[str]:
    """Per row, the SHA-256 of the given words joined by one space."""
    marks = np.zeros(len(raw) + 1, np.int8)
    np.add.at(marks, start, 1)
    np.add.at(marks, end, -1)
    mask = np.cumsum(marks[:-1], dtype=np.int8) > 0
    data = raw.copy()
    if len(start):
        gaps = end[:-1][row[1:] == row[:-1]]  # a space byte: another word of the row follows
        mask[gaps] = True
        data[gaps] = 0x20
    to = np.concatenate([[0], np.cumsum(mask)])[off].tolist()
    view = memoryview(data[mask].tobytes())
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(to[:-1], to[1:])]


def _candidate_windows(width: int):
    """Windows whose anchor stands in several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, off = utf8(part.column("text"))
                start, end, row = word_spans(raw, off)
                at, anchor, hashes = _windows(span_hashes(raw, start, end), row, width)
                of = row[at]
                lists = part.column("anchors")
                size = np.diff(lists.offsets.to_numpy())
                wanted = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
                # One search over (row, anchor): both are mixed into one 64-bit key.
                whose = np.repeat(np.arange(part.num_rows), size)
                order = np.lexsort((wanted, whose))
                wanted, whose = wanted[order], whose[order]
                with np.errstate(over="ignore"):
                    known = mix64(wanted + mix64(whose.astype(U64)))
                    mine = mix64(anchor + mix64(of.astype(U64)))
                keep = np.isin(mine, known)
                at, anchor, hashes, of = at[keep], anchor[keep], hashes[keep], of[keep]
                bounds = row_bounds(of, part.num_rows).astype(np.int32)
                first = row_bounds(row, part.num_rows)
                place = (at - first[of]).astype(np.int32)
                to = pa.array(bounds)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("tag_a"), part.column("tag_b"), part.column("copies"), part.column("text"),
                     pa.ListArray.from_arrays(to, pa.array(place)), pa.ListArray.from_arrays(to, pa.array(anchor.view(np.int64))), pa.ListArray.from_arrays(to, pa.array(hashes.view(np.int64)))],
                    names=["doc_id", "tag_a", "tag_b", "copies", "text", "place", "anchor", "hash"],
                )

    return run


def _remove(width: int):
    """From the places of repeated windows: words removed, the rest's digest, and the byte spans to cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, off = utf8(part.column("text"))
                start, end, row = word_spans(raw, off)
                bounds = row_bounds(row, part.num_rows)
                hits, alone = (bounds[np.repeat(np.arange(part.num_rows), np.diff(x.offsets.to_numpy()))] + x.flatten().to_numpy(zero_copy_only=False) for x in (part.column("place"), part.column("alone")))
                hits = np.setdiff1d(hits, alone)
                cover = np.zeros(len(start) + 1, np.int64)
                np.add.at(cover, hits, 1)
                np.add.at(cover, hits + width, -1)
                gone = np.cumsum(cover[:-1]) > 0
                keep = ~gone
                removed = np.bincount(row[gone], minlength=part.num_rows)
                digests = _digests(raw, off, start[keep], end[keep], row[keep])
                # Passages: runs of removed words in one row, each with the space after it.
                opens, closes = gone.copy(), gone.copy()
                inside = gone[1:] & gone[:-1] & (row[1:] == row[:-1])
                opens[1:] &= ~inside
                closes[:-1] &= ~inside
                f, t = np.flatnonzero(opens), np.flatnonzero(closes)
                after = np.append(start, 0)[t + 1]
                last = (t + 1 >= len(start)) | (np.append(row, -1)[t + 1] != row[t])
                after = np.where(last, off[row[t] + 1], after)
                base = off[row[f]]
                spans = pa.ListArray.from_arrays(
                    pa.array(row_bounds(row[f], part.num_rows).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(start[f] - base), pa.array(after - base)], names=["from", "to"]),
                )
                yield pa.record_batch(
                    [part.column("tag_a"), part.column("tag_b"), pa.array(removed), pa.array(digests, pa.string()), spans],
                    names=["tag_a", "tag_b", "n_removed", "kept_sha256", "spans"],
                )

    return run


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def repeated_passages(docs: DataFrame, scratch: Scratch, width: int = 35) -> DataFrame:
    """One row per document: doc_id, tag_a, tag_b, n_words, n_removed, kept_sha256, all_gone, spans (byte ranges to cut).

    A window is ``width`` consecutive words of one document; every word in a window
    whose word sequence also starts elsewhere goes. Windows are judged on the input.
    Null and blank texts have no words; repeated rows are repeats of each other.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text").withColumns(row_tags()).withColumns({"text_a": F.xxhash64("text"), "text_b": F.xxhash64(F.lit(0xC0DE), "text")})
    made = base.mapInArrow(_row_anchors(width), f"doc_id {id_type}, tag_a long, tag_b long, text_a long, text_b long, n_words long, whole_sha256 string, anchors array<long>, many array<boolean>")
    rows = scratch.table(made, "rows")
    # Equal texts: all of their windows repeat. One of them stands for the others, with double weight.
    texts = rows.groupBy("text_a", "text_b").agg(F.count("*").alias("copies"), F.min(F.struct("tag_a", "tag_b")).alias("x"))
    texts = scratch.table(texts.select("text_a", "text_b", "copies", "x.tag_a", "x.tag_b"), "texts")
    heads = rows.filter(F.size("anchors") > 0).join(texts.select("tag_a", "tag_b", "copies"), ["tag_a", "tag_b"])
    one = F.when((F.col("copies") > 1) | F.col("x.many"), 2).otherwise(1)
    found = scratch.table(heads.select("tag_a", "tag_b", "copies", F.explode(F.arrays_zip("anchors", "many")).alias("x")).select("tag_a", "tag_b", "copies", F.col("x.anchors").alias("anchor"), one.alias("n")), "anchors")
    again = found.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    wanted = found.join(again, "anchor").groupBy("tag_a", "tag_b").agg(F.max("copies").alias("copies"), F.collect_set("anchor").alias("anchors"))
    wanted = scratch.table(wanted, "wanted")
    scratch.drop("anchors")
    scratch.release()
    near = base.select("doc_id", "text", "tag_a", "tag_b").join(wanted, ["tag_a", "tag_b"]).select("doc_id", "tag_a", "tag_b", "copies", "text", "anchors")
    windows = near.mapInArrow(_candidate_windows(width), f"doc_id {id_type}, tag_a long, tag_b long, copies long, text string, place array<int>, anchor array<long>, hash array<long>")
    windows = scratch.table(windows.withColumn("rid", F.monotonically_increasing_id()), "windows")
    scratch.release()
    keys = windows.select("rid", F.when(F.col("copies") > 1, 2).otherwise(1).alias("n"), F.explode(F.arrays_zip("place", "anchor", "hash")).alias("x"))
    counted = keys.groupBy("x.anchor", "x.hash").agg(F.sum("n").alias("n"), F.min("rid").alias("rid"), F.min("x.place").alias("place"))
    alone = scratch.table(counted.filter("n = 1").groupBy("rid").agg(F.collect_list("place").alias("alone")), "alone")
    scratch.release()
    cut = windows.filter("copies = 1").select("rid", "tag_a", "tag_b", "text", "place").join(alone, "rid", "left").select("tag_a", "tag_b", "text", "place", F.coalesce("alone", F.array().cast("array<int>")).alias("alone"))
    cut = scratch.table(cut.mapInArrow(_remove(width), "tag_a long, tag_b long, n_removed long, kept_sha256 string, spans array<struct<from:long,to:long>>").filter("n_removed > 0"), "cut")
    scratch.drop("windows", "alone")
    scratch.release()
    lean = rows.select("doc_id", "tag_a", "tag_b", "text_a", "text_b", "n_words", "whole_sha256")
    out = lean.join(texts.filter("copies > 1").select("text_a", "text_b", "copies"), ["text_a", "text_b"], "left").join(cut, ["tag_a", "tag_b"], "left")
    gone = (F.col("copies").isNotNull()) & (F.col("n_words") >= width)
    return out.select(
        "doc_id", "tag_a", "tag_b", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        gone.alias("all_gone"), "spans",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone, spans = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("text", "all_gone", "spans"))
        for i, text in enumerate(texts):
            if gone[i]:
                texts[i] = ""
            elif spans[i]:
                data, parts, last = text.encode(), [], 0
                for s in spans[i]:
                    parts.append(data[last : s["from"]])
                    last = s["to"]
                texts[i] = b"".join([*parts, data[last:]]).decode()
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def remove_repeats(docs: DataFrame, scratch: Scratch, width: int = 35) -> DataFrame:
    """``docs`` with the repeated passages cut from its texts; n_chars, if there, follows.

    Rows without a repeated passage keep their text byte for byte.
    """
    found = repeated_passages(docs, scratch, width).filter("n_removed > 0").select("tag_a", "tag_b", "all_gone", "spans")
    found = scratch.table(found.dropDuplicates(["tag_a", "tag_b"]), "found")
    scratch.release()
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumns(row_tags("row.")).join(found, ["tag_a", "tag_b"], "left")
    rest = F.struct(*[F.col(f"row.{c}") for c in docs.columns if c != "text"])
    types = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    cut = rows.select(rest.alias("row"), F.col("row.text").alias("text"), "all_gone", "spans").mapInArrow(_cut, f"row struct<{types}>, text string")
    columns = {f.name: F.col("text") if f.name == "text" else F.col(f"row.{f.name}") for f in docs.schema}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("row.n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[c.alias(n) for n, c in columns.items()])
