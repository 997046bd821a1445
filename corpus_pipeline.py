"""A corpus pipeline: documents in some language, without exact and near copies and benchmark passages, encoded as tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each stage but the last returns the
columns that it was given. Models and decisions rest on the stage's own input. Null texts, very long ones, ties, repeated rows, empty tables and extra
columns (of any name) are handled as the operators' modules say; null and empty texts go in the first stage, which finds no language in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join
from quirelake.llm.common import held_out, table, tokenizer_path, written


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (2): documents that it rejects go, those without a letter and those in which no language stands out (language_id.LEAST_MARGIN)."""
    return language_id.in_some_language(docs, language_id.train(docs.where(~held_out("doc_id", 4, 2))))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (6): of equal texts the row with the largest doc_id stays."""
    return exact_dedup.distinct_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (8): of each group that links join, the document with the largest doc_id stays."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (5): documents that hold an item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding (7): doc_id, lang, source (null where docs lack them), n_tokens, ids and the hash of the decoded text."""
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source") if c not in docs.columns})
    rows = bpe.bpe_encode(docs, tokenizer_path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: Language ID and the tokenizer cannot be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a Parquet table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
