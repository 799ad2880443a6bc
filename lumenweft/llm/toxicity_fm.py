"""Toxicity by a factorization machine over hashed terms.

Method. A text is the set of hashes of its lower-case words, each ``1`` if
present. score = sigmoid(b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)): besides a weight per
term the machine learns a vector per term, so that pairs (an insult with
a mention of a group, say) count beyond the sum of their parts. It is trained by
Adagrad on logistic loss with L2, on a bounded sample of labelled rows (``sample`` ids, those with the
smallest hash; a documented parameter), held in the driver as hashed terms only, at most 2**bits a row. Long texts
hold thousands of terms that say nothing, so the loss is also penalised by L1, scaled by each term's own noise: the active set
grows in rounds, and a term, or both terms of a pair, enter when the gradient is far from 0 given the model so far
(``train``). Pairs enter whichever way they differ, however weak each term is alone. The model is a
fixed-size array whatever the corpus; scoring is one pass without a shuffle.

Defined results: null, empty and wordless texts have the bias alone, as has a text without active terms; repeated rows are
scored alike; of repeated ids one text each is learned from; no labels, or one class, give that class's share to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweft.llm._shared import NON_WORD, U64, prepare, row_bounds, slices, span_hashes, utf8, word_spans

BITS = 18
FACTORS = 4
SAMPLE = 8_000


def hashed_terms(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of each row, and the row bounds."""
    raw, off = utf8(pc.utf8_lower(texts))
    start, end, row = word_spans(raw, off, NON_WORD)
    key = (row.astype(U64) << U64(bits)) | (span_hashes(raw, start, end) & U64((1 << bits) - 1))
    key = np.unique(key)
    return (key & U64((1 << bits) - 1)).astype(np.int32), row_bounds((key >> U64(bits)).astype(np.int64), len(off) - 1)


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # (1 << bits,)
    factors: np.ndarray  # (1 << bits, k)
    bits: int

    def scores(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of the toxic label for each row; a row without terms has the bias alone."""
        rows = len(bounds) - 1
        of = np.repeat(np.arange(rows), np.diff(bounds))
        used = self.weights[terms] != 0
        terms, of = terms[used], of[used]
        logit = np.full(rows, self.bias) + np.bincount(of, self.weights[terms], rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[terms, f]
            logit += 0.5 * (np.bincount(of, v, rows) ** 2 - np.bincount(of, v * v, rows))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _distinct(rows: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """Rows of equal terms and label once: copies are no further evidence."""
    return list({(t.tobytes(), y): (t, y) for t, y in rows}.values())


def telling_terms(rows: list[tuple[np.ndarray, int]], chance: np.ndarray, share: float, size: int, far: float) -> np.ndarray:
    """True for terms whose documents are toxic ``far`` standard deviations oftener or more seldom than ``chance`` says.

    For oftener, nothing counts as less likely than ``share``: a fitted model would call each document it misses far off.
    """
    out = np.zeros(size, bool)
    for sign, expected in ((1, np.maximum(chance, share)), (-1, chance)):
        more, spread = np.zeros(size), np.zeros(size)
        for (t, y), p in zip(rows, expected.tolist()):
            more[t] += y - p
            spread[t] += p * (1 - p)
        out |= (sign * more >= far * np.sqrt(spread)) & (spread > 0)
    return out


def telling_pairs(rows: list[tuple[np.ndarray, int]], chance: np.ndarray, share: float, least: int, far: float, block: int = 512) -> list[tuple[int, int, bool]]:
    """(term, term, oftener) of pairs whose common documents, ``least`` or more, are toxic ``far`` standard deviations oftener or more seldom than ``chance`` says.

    Terms that can't be in such a pair are left out first: oftener takes ``least`` toxic documents that aren't foretold,
    more seldom a spread of far**2. All pairs of the others are counted, a block of terms against another at a time.
    """
    size = len(rows)
    at = np.repeat(np.arange(size), [len(t) for t, _ in rows])
    flat = np.concatenate([t for t, _ in rows])
    labels, low = np.array([y for _, y in rows], np.float32), chance.astype(np.float32)
    high = np.maximum(low, np.float32(share))  # as in telling_terms
    missed, spread, spread_up = labels * (low < 0.5), low * (1 - low), high * (1 - high)
    terms, place = np.unique(flat, return_inverse=True)
    able = (np.bincount(place, missed[at]) >= least) | (np.bincount(place, spread[at]) >= far * far)
    keep = able[place]
    at, place, terms = at[keep], (np.cumsum(able) - 1)[place[keep]], terms[able]
    order = np.argsort(place, kind="stable")
    at, place = at[order], place[order]

    def columns(lo: int) -> np.ndarray:
        i, j = np.searchsorted(place, (lo, lo + block))
        x = np.zeros((size, min(block, len(terms) - lo)), np.float32)
        x[at[i:j], place[i:j] - lo] = 1
        return x

    found = []
    for lo in range(0, len(terms), block):
        left = columns(lo)
        for to in range(lo, len(terms), block):
            right = left if to == lo else columns(to)
            sums = lambda x: (left * x[:, None]).T @ right
            up = (sums(missed) >= least) & (sums(labels - high) >= far * np.sqrt(sums(spread_up)))
            limit = np.sqrt(sums(spread))
            down = (left.T @ right >= least) & (limit >= far) & (sums(labels - low) <= -far * limit)
            for i, j in np.argwhere(up | down).tolist():
                if i + lo < j + to:
                    found.append((int(terms[i + lo]), int(terms[j + to]), bool(up[i, j])))
    return found


def _beyond_each(rows: list[tuple[np.ndarray, int]], pairs: list[tuple[int, int, bool]], far: float) -> list[tuple[int, int, bool]]:
    """The pairs whose common documents also differ that far from the documents of either term by itself."""
    held = {x for i, j, _ in pairs for x in (i, j)}
    listed = np.array(sorted(held), np.int64)
    docs: dict[int, set[int]] = {x: set() for x in held}
    for n, (t, _) in enumerate(rows):
        for x in t[np.isin(t, listed)].tolist():
            docs[x].add(n)
    toxic = {n for n, (_, y) in enumerate(rows) if y}
    out = []
    for i, j, up in pairs:
        both, shares = docs[i] & docs[j], [len(docs[x] & toxic) / len(docs[x]) for x in (i, j)]
        p = max(shares) if up else min(shares)
        gap = len(both & toxic) - len(both) * p
        if abs(gap) >= far * np.sqrt(len(both) * p * (1 - p) + 1e-9) and (gap > 0) == up:
            out.append((i, j, up))
    return out


def train(
    rows: list[tuple[np.ndarray, int]], bits: int = BITS, k: int = FACTORS, epochs: int = 12, rate: float = 0.1, l2: float = 1e-4, far: float = 5.0, pair_far: float = 7.0, least: int = 8, rounds: int = 3, seed: int = 7
) -> Model:
    """Adagrad over single documents, in an order drawn from ``seed``, on an active set of terms that grows in ``rounds``.

    Every term and every pair of terms can enter; each does when the loss's gradient by it, given the
    model so far, is ``far`` (``pair_far``) standard deviations from 0: an L1 penalty scaled by each one's own noise.
    Without rows, or with one class, the model says that class's share.
    """
    size = 1 << bits
    labels = np.array([y for _, y in rows], np.float64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, k), np.float32), bits)
    if len(set(labels.tolist())) < 2:
        return model
    once = _distinct(rows)
    bounds, flat = np.concatenate([[0], np.cumsum([len(t) for t, _ in once])]), np.concatenate([t for t, _ in once])
    known, pairs = np.zeros(size, bool), {}
    for _ in range(rounds):
        chance = model.scores(flat, bounds)
        terms = telling_terms(once, chance, share, size, far) & ~known
        fresh = [] if terms.any() else [x for x in _beyond_each(once, telling_pairs(once, chance, share, least, pair_far), pair_far) if x[:2] not in pairs]
        if not terms.any() and not fresh:
            break
        known |= terms
        for i, j, up in fresh:
            pairs[i, j] = up
            known[[i, j]] = True
        model = _adagrad(rows, labels, share, known, pairs, bits, k, epochs, rate, l2, seed)
    return model


def _adagrad(rows, labels, share, known, pairs, bits, k, epochs, rate, l2, seed) -> Model:
    size, rng = 1 << bits, np.random.default_rng(seed)
    weights, factors = np.zeros(size), np.zeros((size, k))
    bias = float(np.log(share / (1 - share)))
    data = [terms[known[terms]] for terms, _ in rows]
    factors[known] = rng.normal(0, 0.01, (int(known.sum()), k))
    # The two of a pair begin on the same side, or on opposite ones, as far out as the few documents with both would be long in bringing them.
    for n, ((i, j), up) in enumerate(pairs.items()):
        factors[i, n % k], factors[j, n % k] = 1.0, 1.0 if up else -1.0
    gw, gv, gb = np.full(size, 1e-8), np.full((size, k), 1e-8), 1e-8
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            t, y = data[i], labels[i]
            v = factors[t]
            total = v.sum(0)
            p = 1 / (1 + np.exp(-np.clip(bias + weights[t].sum() + 0.5 * float((total**2).sum() - (v * v).sum()), -30, 30)))
            g = p - y
            if abs(g) < 1e-3:
                continue
            d = g + l2 * weights[t]
            gw[t] += d * d
            weights[t] -= rate * d / np.sqrt(gw[t])
            dv = g * (total - v) + l2 * v
            gv[t] += dv * dv
            factors[t] = v - 0.5 * rate * dv / np.sqrt(gv[t])
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
    weights[known & (weights == 0)] = 1e-12
    return Model(bias, weights.astype(np.float32), factors.astype(np.float32), bits)


def fit(labelled: DataFrame, bits: int = BITS, **options) -> Model:
    """``labelled``: a bounded number of rows with text and label (0 or 1; rows with a null label take no part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                terms, bounds = hashed_terms(part.column("text"), bits)
                yield pa.record_batch([part.column("h"), part.column("label"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(terms))], names=["h", "label", "terms"])

    rows = labelled.filter("label is not null").select(F.xxhash64("text").alias("h"), F.col("label").cast("int").alias("label"), "text")
    found = rows.mapInArrow(run, "h long, label int, terms array<int>").toArrow()
    order = np.lexsort((found.column("label").to_numpy(), found.column("h").to_numpy()))
    terms = found.column("terms").combine_chunks()
    flat, off = terms.flatten().to_numpy(), terms.offsets.to_numpy()
    off = off - off[0] if len(off) else off
    labels = found.column("label").to_numpy()
    return train([(flat[off[i] : off[i + 1]].astype(np.int64), int(labels[i])) for i in order], bits, **options)


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` (any columns, with ``text``; null: empty) and a column from 0 to 1; one of that name is replaced."""
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                s = m.scores(*hashed_terms(part.column(part.schema.get_field_index("text")), m.bits))
                yield pa.record_batch([*part.columns, pa.array(s)], names=[*part.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def remainder(column: str, by: int):
    """crc32 of a column as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def fit_on_labels(spark: SparkSession, documents: DataFrame, labels: DataFrame, held_out: int = 5, sample: int = SAMPLE, **options) -> Model:
    """Fits on documents with a label; rows whose remainder by ``held_out`` is 0 take no part.

    At most ``sample`` labelled ids are used, those with the smallest hash, and one text of each, so what reaches
    the driver is bounded; only the ids' table is broadcast.
    """
    prepare(spark)
    marks = labels.filter("toxic is not null and doc_id is not null").filter(remainder("doc_id", held_out) != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text").alias("x")).join(F.broadcast(chosen), "doc_id")
    return fit(rows.groupBy("doc_id", "label").agg(F.min("x").alias("x")).select("x.text", "label"), **options)
