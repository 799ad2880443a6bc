"""The pipeline's stages, each on what the one before kept."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
from lumenweft.llm import best_fit_packing, token_stream
from lumenweft.llm._shared import read_table
from lumenweft.llm.queries import byte_bpe_path
from tests.llm import brute

DIR = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = read_table(spark, DIR, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        kept[name] = before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic = {r.doc_id for r in read_table(spark, DIR, "labels").filter("toxic = 0").collect()}
    before, after = kept["toxicity"]
    gone = {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()}
    assert gone and not gone & toxic
    before, after = kept["minhash_near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in brute.components(rows, 5)})
    before, after = kept["substring_dedup"]
    want = {k: (w - g) for k, w, g, _ in brute.substring([(r.doc_id, r.text) for r in before.collect()], 35)}
    assert {r.doc_id: len(brute.WORD.findall(r.text)) for r in after.collect()} == want
    before, after = kept["mix_sources"]
    assert after.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    assert docs.agg({"length": "max"}).first()[0] <= 2048


def test_toxicity_stage_removes_the_labelled_toxic(spark):
    docs = read_table(spark, DIR, "documents")
    labels = {r.doc_id: r.toxic for r in read_table(spark, DIR, "labels").collect()}
    rows = {r.doc_id for r in docs.select("doc_id").collect()}
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, DIR).select("doc_id").collect()}
    toxic = {i for i, y in labels.items() if y == 1} & rows
    # Measured: 33 of 51. Asked is only that most go.
    assert len(toxic - left) > 0.5 * len(toxic) and len(rows - left) <= 0.25 * len(rows)


def test_mix_and_pack_stages_lose_nothing(spark):
    """Copies of each document, and the pieces' tokens, against brute force on the stage's own input."""
    small = "/root/testdata/sf0.001"
    docs, stages = read_table(spark, small, "documents"), dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    words, by_source = [len(brute.WORD.findall(t)) for _, t, _ in rows], {}
    for n, (key, text, source) in zip(words, rows):
        by_source.setdefault(source, []).append((hashlib.md5(f"{key}:{text}".encode()).hexdigest(), n, key))
    sizes = {s: sum(n for _, n, _ in x) for s, x in by_source.items()}
    targets, want = brute.water_levels(sizes), Counter()
    for source, found in by_source.items():
        passes, at = math.floor(targets[source] / sizes[source]), 0
        for _, n, key in sorted(found):
            want[key] += min(3, passes + (at + n / 2 <= targets[source] - passes * sizes[source])) if n else 0
            at += n
    got = Counter(r.doc_id for r in stages["mix_sources"](spark, docs, small).select("doc_id").collect())
    assert got == +want
    tok, pieces = token_stream.encoder(byte_bpe_path()).tokenizer, []
    for key, text, _ in rows:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        pieces += [(key, k, s, n, brute.crc(ids[s : s + n])) for k, (s, n) in enumerate(best_fit_packing.cut_points(len(ids), 2048))]
    packed = stages["best_fit_packing"](spark, docs, small).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, packed)) == sorted(pieces)
