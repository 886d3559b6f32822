"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obliqua.llm import jaccard_join, langid, line_dedup, packing, pii
from obliqua.llm.common import free_names, remove_path, scratch_path, small_batches, table
from obliqua.llm.queries import tokenizer_path

LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without letters or with a score too low go."""
    small_batches(spark)
    model = langid.fit(docs.filter(langid.is_learned_from(F.col("doc_id"))).select("doc_id", "text", "lang"))
    language, score = free_names(docs.columns, "__lang_pred", "__lang_score")
    judged = langid.predict(docs, model, language, score)
    return judged.filter((F.col(language) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut out; documents made of nothing else go."""
    small_batches(spark)
    return line_dedup.remove_repeated_lines(docs, edits=2, least_bytes=20, least_equal=1, percent=5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share four fifths of their five-word shingles."""
    small_batches(spark)
    return jaccard_join.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets."""
    small_batches(spark)
    return pii.mask(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", sequence_packing),
]

#: No SQL: trained models, the genetic algorithm and edit distances have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to scratch space and read again by the next."""
    docs, written = table(spark, sf_dir, "documents"), []
    try:
        for name, stage in STAGES[:-1]:
            written.append(scratch_path(spark, name))
            stage(spark, docs, sf_dir).write.parquet(written[-1])
            docs = spark.read.parquet(written[-1])
            for path in written[:-1]:
                remove_path(spark, path)
            written = written[-1:]
        return STAGES[-1][1](spark, docs, sf_dir)  # its pieces are checkpointed, so its input may go
    finally:
        for path in written:
            remove_path(spark, path)
