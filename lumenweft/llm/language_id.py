"""Language identification: multinomial naive Bayes over hashed character n-grams.

Method. Texts are lower-cased; runs of one to three characters, without digits and
signs, are hashed to 2**bits buckets. Counts per language come from a bounded sample of labelled rows
(of each language the ``sample`` different rows with the smallest hash; a documented parameter), summed in Spark
per (language, bucket); priors are the languages' shares of all labelled rows. The log-probability matrix of fixed size is broadcast, and
batches are scored in numpy as sparse counts, a slice of text at a time.
The score is the posterior, tempered by the number of n-grams, since they aren't independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweft.llm._shared import U64, prepare, row_tags, slices

BITS = 14
#: Rows a language.
SAMPLE = 1_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each followed by a space, and each text's number."""
    joined = [t.lower() + " " for t in texts]
    code = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.repeat(np.arange(len(joined)), [len(t) for t in joined])


def _plain() -> np.ndarray:
    """For each code point below 2**16: itself if it may stand in a word, else a space."""
    table = np.arange(1 << 16, dtype=np.uint32)
    table[: 0x80] = 32
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    for lo, hi in ((0x80, 0xC0), (0x2000, 0x2070), (0x3000, 0x3004), (0xD7, 0xD8), (0xF7, 0xF8)):
        table[lo:hi] = 32
    table[[0xAA, 0xB5, 0xBA]] = 0xAA, 0xB5, 0xBA
    return table


_PLAIN = _plain()


def hashed_grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of 1 to 3 characters; several blanks count as one break."""
    code, of = _codes(texts)
    code = np.where(code < 1 << 16, _PLAIN[np.minimum(code, 0xFFFF)], code)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (of[1:] != of[:-1])
    code, of = code[keep].astype(U64), of[keep]
    out, rows = [], []
    with np.errstate(over="ignore"):
        gram = np.zeros(len(code), U64)
        for n in (1, 2, 3):
            m = len(code) - n + 1
            if m <= 0:
                break
            gram = gram[:m] * U64(0x110000) + code[n - 1 :]
            h = (gram * U64(0x9E3779B97F4A7C15 + 2 * n)) >> U64(64 - bits)
            good = (code[:m] != 32) if n == 1 else (of[:m] == of[n - 1 :])
            out.append(h[good].astype(np.int32))
            rows.append(of[:m][good])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64))


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # (1 << bits, languages)
    prior: np.ndarray
    bits: int

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; und and 0 where no letter is."""
        buckets, rows = hashed_grams(texts, self.bits)
        n = len(texts)
        total = np.stack([np.bincount(rows, self.log_prob[buckets, j], n) for j in range(len(self.langs))], axis=1) if self.langs else np.zeros((n, 0))
        count = np.bincount(rows, minlength=n)
        blank = np.array([not any(map(str.isalpha, t)) for t in texts], bool) if n else np.zeros(0, bool)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        logit = (total + self.prior) / np.sqrt(np.maximum(count, 1))[:, None]
        best = logit.argmax(1)
        post = 1 / np.exp(logit - logit.max(1, keepdims=True)).sum(1)
        return ["und" if b else self.langs[i] for b, i in zip(blank, best)], np.where(blank, 0.0, post)


def fit(labelled: DataFrame, sample: int = SAMPLE, bits: int = BITS, smoothing: float = 0.5) -> Model:
    """``labelled``: text, lang (rows with null text or language take no part)."""
    prepare(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                texts = [t for t, x in zip(batch.column("text").to_pylist(), langs) if x == lang]
                counts = np.bincount(hashed_grams(texts, bits)[0], minlength=1 << bits)
                some = np.flatnonzero(counts)
                yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["lang", "bucket", "n"])

    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "lang", "text").withColumns(row_tags())
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("tag_a").alias("m")).collect()  # one row per language
    docs = {r.lang: r.n for r in found}
    # The sample's tags are a table of bounded size; the texts are not sorted. Repeated rows are learned from once.
    # Only hashes below a bound that some 4 * sample different rows of a language have go to the task that ranks them.
    ends = [(r.lang, min((1 << 63) - 1, (1 << 64) * 4 * sample // max(r.m, 1) - (1 << 63))) for r in found]
    low = rows.select("lang", "tag_a", "tag_b").join(F.broadcast(rows.sparkSession.createDataFrame(ends, "lang string, last long")), "lang").filter("tag_a <= last").drop("last")
    order = Window.partitionBy("lang").orderBy("tag_a", "tag_b")
    few = low.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).drop("n")
    chosen = rows.join(F.broadcast(few), ["lang", "tag_a", "tag_b"], "left_semi").groupBy("lang", "tag_a", "tag_b").agg(F.first("text").alias("text")).select("lang", "text")
    counts = chosen.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table: dict[str, np.ndarray] = {}
    for r in counts.toLocalIterator():
        table.setdefault(r.lang, np.zeros(1 << bits))[r.bucket] = r.n
    langs = sorted(table)
    if not langs:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0), bits)
    freq = np.stack([table[x] for x in langs], axis=1) + smoothing
    total = np.array([docs[x] for x in langs], float)
    return Model(langs, np.log(freq / freq.sum(0)), np.log(total / total.sum()), bits)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns, with ``text``) and lang_pred, score; columns of these names are replaced. Whole texts are read; null or letterless: und, 0."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                langs, post = m.predict(pc.fill_null(part.column(part.schema.get_field_index("text")), "").to_pylist())
                yield pa.record_batch([*part.columns, pa.array(langs, pa.string()), pa.array(post)], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
