"""The registered queries of the ten operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm import best_fit_packing, cws_fingerprint, exact_topk, language_id, license_scan, minhash_dedup, source_mix, substring_dedup, token_stream, toxicity_fm
from lumenweft.llm._shared import Scratch, read_table


def byte_bpe_path() -> str:
    """The tokenizer file of the installed vocabulary package; operators take a path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_stream.token_files(read_table(spark, sf_dir, "documents"), Scratch(spark, "op1"), byte_bpe_path())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"), Scratch(spark, "op2"), 35)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", exact_topk.whole_numbers("embedding").alias("v"))
    return exact_topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), Scratch(spark, "op4"), k=5)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = toxicity_fm.remainder("doc_id", 4) == 2
    model = language_id.fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = source_mix.mix_plan(read_table(spark, sf_dir, "documents"), Scratch(spark, "op6"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.get("positions", F.lit(0)).alias("first_position"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), Scratch(spark, "op7"), width=2, threshold=0.8)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(read_table(spark, sf_dir, "documents"), Scratch(spark, "op8"), byte_bpe_path(), 2048)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity_fm.fit_on_labels(spark, docs, read_table(spark, sf_dir, "labels"))
    held_out = toxicity_fm.remainder("doc_id", 5) == 0
    scored = toxicity_fm.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_cws_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws_fingerprint.compare_with_next(read_table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_substring_dedup, op3_license_scan, op4_exact_topk, op5_language_id, op6_source_mix, op7_minhash_dedup, op8_best_fit_packing, op9_toxicity, op10_cws_fingerprint)}
