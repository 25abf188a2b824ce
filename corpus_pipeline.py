"""The corpus pipeline: language, near copies, benchmark passages, mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import decontaminate, language_id, mixture, ngram_join
from llm.common import in_fold, stored
from llm.queries_a import mixed, token_rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; the model learns from the labelled folds of its own input."""
    return language_id.identified(docs, language_id.fit(docs.where(~in_fold("doc_id", 5, 0))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram links connect: the one with the smallest doc_id."""
    return ngram_join.one_of_each_group(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: one row for each pass that takes a document; a leaf's last text ends where its budget does."""
    return mixture.within_budget(mixed(docs)).select("row.*").select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files written and read back: doc_id, start, n_tokens and ids_crc32 of every row."""
    return token_rows(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("mix_sources", mix),
    ("token_files", token_output),
]

#: A stage's model, links and codes are beyond SQL; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
