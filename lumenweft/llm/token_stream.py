"""Token ids in Arrow IPC files of equal-length sequences.

Each shard is one Arrow IPC file: the stream format's batches with a footer, so
that a reader maps the file and reaches sequence i without decoding anything
else. A batch has two fixed-size lists of ``length`` entries per row, ``ids``
(uint16 where the vocabulary allows it, else uint32) and ``mask`` (true: a token,
false: padding at the shard's end). Uncompressed, so both are read in place: a local file is
mapped, and ids and the mask's bits are views of the map; elsewhere only the batches asked for are read. A second small
file holds the shard's documents: doc_id, start inside the shard, n_tokens.

Documents are range-partitioned and sorted by doc_id, nulls first, and among equal ids by the hash of their texts, so shards
follow each other in that order and a repeated id may fill several; a shard's place in the whole stream is the sum of the
tokens before it. A task writes its shard under a name of its own attempt and
renames it, so retries and speculative copies leave one whole file. Shards are
reached through pyarrow.fs by the URI of the shared folder.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenweft.llm._shared import Scratch, slices

END = 0
_tokenizers: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct piece of text once.

    A byte-level BPE with the usual split pattern (contractions; letters, digits or other signs, each
    with at most one space before them; white space) never joins a token across certain places: before a
    single space between two other characters, and between a letter and a sign that isn't an apostrophe.
    Texts are split at such places only, so the ids of a text are those of its pieces in order. A piece that is
    one word is one unit of the split pattern, so the library's model gets it directly; all others
    go through the whole tokenizer. Tokenizers of another kind encode the text as it is.
    """

    LIMIT = 600_000  # pieces of a generation that are remembered, some 125 MB; there are two
    LONGEST = 48  # characters of a remembered piece
    LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
    LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    SPACE = r"\s\x1c-\x1f\x85"
    PIECE = (
        rf" ?[{LETTER}]++(?=[ .,!?;:|\n])"  # a word, then a space or a sign
        rf"|[.,!?;:|]++(?= [{LETTER}])"  # signs, then the next word
        rf"|[.,!?;:|]++\n(?=[{LETTER}])"  # signs at the end of a line
        rf"|(?s:.)+?(?=(?<=[^{SPACE}]) (?=[^{SPACE}])|\Z)"  # anything, up to a single space or the end
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype, self.code = (np.dtype("<u2"), "H") if size <= 1 << 16 else (np.dtype("<u4"), "I")
        self.split = re.compile(self.PIECE).findall if self._splits() else None
        if self.split:
            self.known, self.older = _Known(self), {}
            self.model, self.word = self.tokenizer.model, re.compile(f" ?[{self.LETTER}]+").fullmatch
            # How the tokenizer writes the bytes of a space and of each letter.
            mapped = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.written = {c: mapped(chr(c))[0][0] for c in self.LETTERS} | {0x20: mapped(" a")[0][0][:-1]}

    def _splits(self) -> bool:
        made = json.loads(self.tokenizer.to_str())
        pre, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and made.get("normalizer") is None
        whole = not any(re.search(r"[\s.,!?;:]", x["content"]) or re.fullmatch(f"[{self.LETTER}]+", x["content"]) or x["lstrip"] or x["rstrip"] for x in added)
        return plain and whole and made["model"].get("type") == "BPE" and not made["model"].get("dropout")

    def _encode(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, k: str) -> bytes:
        """Ids of a piece that isn't among the newest remembered ones."""
        if k in self.older:
            return self.older[k]
        if self.word(k):
            return array(self.code, [t.id for t in self.model.tokenize(k.translate(self.written))]).tobytes()
        return self._encode([k])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, in the smallest unsigned little-endian type that holds the vocabulary."""
        if self.split is None:
            return self._encode([t or "" for t in texts])
        if len(self.known) > self.LIMIT:
            self.known, self.older = _Known(self), self.known
        get = self.known.__getitem__
        return [b"".join(map(get, self.split(t or ""))) for t in texts]


class _Known(dict):
    """Ids by piece; unknown ones are encoded as they are asked for, and kept unless long."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, k: str) -> bytes:
        ids = self.encoder.piece(k)
        if len(k) <= Encoder.LONGEST:
            self[k] = ids
        return ids


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class ShardWriter:
    """Writes one shard: whole sequences as soon as they are full, the padded rest at the end."""

    ROWS = 256

    def __init__(self, fs, path: str, length: int, dtype: np.dtype):
        self.fs, self.length, self.dtype, self.path, self.part = fs, length, dtype, path, f"{path}.{uuid.uuid4().hex}.part"
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = fs.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        for i in range(0, len(ids), self.ROWS * self.length):
            cut = slice(i, i + self.ROWS * self.length)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), self.length) for x in (ids, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.ROWS * self.length:
            joined = np.concatenate(self.held)
            whole = len(joined) // (self.ROWS * self.length) * self.ROWS * self.length  # all batches but the last are full
            self._write(joined[:whole], np.ones(whole, bool))
            self.held, self.waiting = [joined[whole:]], len(joined) - whole

    def close(self, documents: pa.Table) -> None:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        pad = -len(rest) % self.length
        self._write(np.concatenate([rest, np.zeros(pad, self.dtype)]), np.arange(len(rest) + pad) < len(rest))
        self.writer.close()
        self.out.close()
        with self.fs.open_output_stream(f"{self.part}.docs") as out, pa.ipc.new_file(out, documents.schema) as w:
            w.write_table(documents)
        self.fs.move(f"{self.part}.docs", f"{self.path}.docs")
        self.fs.move(self.part, self.path)


class ShardReader:
    """Random access to a shard's sequences: only the batches that hold them are touched, and a local file is only mapped."""

    def __init__(self, fs, path: str):
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None
        with fs.open_input_file(f"{path}.docs") as f:
            self.documents = pa.ipc.open_file(f).read_all()

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.at, self.batch = i, self.file.get_batch(i)
        return self.batch

    def _ids(self, i: int) -> np.ndarray:
        return self._batch(i).column("ids").flatten().to_numpy()

    def sequence(self, i: int) -> np.ndarray:
        """The ids of sequence i, padding included: a view."""
        return self._ids(i // ShardWriter.ROWS)[i % ShardWriter.ROWS * self.length :][: self.length]

    def mask(self, i: int) -> np.ndarray:
        """True where sequence i has a token; unpacked from the bits that the file holds."""
        bits = self._batch(i // ShardWriter.ROWS).column("mask").flatten()
        first = bits.offset + i % ShardWriter.ROWS * self.length
        held = np.frombuffer(bits.buffers()[1], np.uint8)[first // 8 : (first + self.length + 7) // 8]
        return np.unpackbits(held, bitorder="little")[first % 8 :][: self.length].astype(bool)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from position start of the shard; a view where one batch holds them all."""
        size, parts = ShardWriter.ROWS * self.length, []
        while n > 0:
            part = self._ids(start // size)[start % size : start % size + n] if start // size < self.file.num_record_batches else ()
            if not len(part):
                raise ValueError(f"the shard ends before token {start}")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, length: int = 2048, shards: int | None = None) -> DataFrame:
    """Writes the shards; returns shard (int), path, tokens, documents: one row per shard, in stream order by shard.

    Null and empty texts are the end id alone. Repeated rows are documents of their own;
    equal doc_ids are ordered by the hash of their texts. An empty table gives no shards.
    """
    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        shard, writer, ids, starts, counts = TaskContext.get().partitionId(), None, [], [], []
        enc = encoder(tokenizer)
        end = enc.dtype.type(END).tobytes()
        path = f"{root}/shard-{shard:06d}.arrow"
        for batch in batches:
            for part in slices(batch):
                writer = writer or ShardWriter(fs, path, length, enc.dtype)
                for key, data in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                    tokens = np.frombuffer(data + end, enc.dtype)
                    ids.append(key)
                    starts.append(writer.total)
                    counts.append(len(tokens))
                    writer.add(tokens)
        if writer is None:
            return
        writer.close(pa.table({"doc_id": pa.array(ids, arrow_id), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())}))
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([path]), pa.array([writer.total]), pa.array([len(ids)])], names=["shard", "path", "tokens", "documents"])

    ordered = docs.select("doc_id", "text")
    keys = ["doc_id", F.xxhash64("text")]
    ordered = ordered.repartitionByRange(shards, *keys) if shards else ordered.repartitionByRange(*keys)
    return ordered.sortWithinPartitions(*keys, "text").mapInArrow(run, "shard int, path string, tokens long, documents long")


def read_token_files(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """Reads shards back: doc_id, shard, start (in the whole stream), n_tokens, ids_crc32 per document.

    ``manifest`` is what write_token_files returned, one small row per shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for shard, path, before in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "before"))):
                reader = ShardReader(fs, path)
                for b in reader.documents.to_batches(max_chunksize=4096):
                    start, n = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
                    crc = [ids_crc32(reader.tokens(int(s), int(k))) for s, k in zip(start, n)]
                    yield pa.record_batch([b.column("doc_id"), pa.array([shard] * b.num_rows, pa.int32()), pa.array(start + before), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    return _before(manifest).mapInArrow(run, f"doc_id {id_type}, shard int, start long, n_tokens long, ids_crc32 long")


def _before(manifest: DataFrame) -> DataFrame:
    """Tokens before each shard: one row per shard, so one small window; then a task per shard."""
    from pyspark.sql import Window

    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)).cast("long"))
    return placed.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "shard")


def token_files(docs: DataFrame, scratch: Scratch, tokenizer: str, length: int = 2048) -> DataFrame:
    """Writes the token files into the scratch folder and reads every document back from them."""
    folder = f"{scratch.path}/tokens"
    manifest = scratch.table(write_token_files(docs, folder, tokenizer, length), "manifest")
    scratch.release()
    return read_token_files(manifest, folder, docs.schema["doc_id"].dataType.simpleString())
