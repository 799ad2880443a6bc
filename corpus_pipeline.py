"""A corpus pipeline of five operators: documents in, packed training sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. run() applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm import best_fit_packing, minhash_dedup, source_mix, substring_dedup, toxicity_fm
from lumenweft.llm._shared import Scratch, free_name, read_table
from lumenweft.llm.queries import byte_bpe_path

#: Documents at or over this score go.
TOXIC = 0.5
#: Words of a passage that is cut where it repeats; words of a shingle and least similarity of near copies.
PASSAGE_WORDS, SHINGLE_WORDS, SIMILARITY = 35, 5, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the factorization machine scores as toxic; it learns from the labelled rows of sf_dir."""
    model = toxicity_fm.fit_on_labels(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    column = free_name(docs.columns, "toxicity")
    return toxicity_fm.score(docs, model, column).filter(F.col(column) < TOXIC).drop(column)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: one with the smallest doc_id. Texts without words have no copies."""
    return minhash_dedup.keep_first(docs, Scratch(spark, "pipeline-near"), SHINGLE_WORDS, SIMILARITY)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages whose words also stand elsewhere; other texts stay as they are."""
    return substring_dedup.remove_repeats(docs, Scratch(spark, "pipeline-passages"), PASSAGE_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order."""
    return source_mix.mixed_stream(docs, Scratch(spark, "pipeline-mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return best_fit_packing.pack_documents(docs, Scratch(spark, "pipeline-pack"), byte_bpe_path(), 2048)


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_duplicates), ("substring_dedup", substring_dedup_stage), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Stages learn models and encode text, which SQL can't express; tests hold each against a brute-force version, toxicity against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, f"{i}-{name}")
    return docs
