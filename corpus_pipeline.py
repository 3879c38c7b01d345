"""Training corpus from raw documents: quality, near duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all rows that it is given; each result is
written as Parquet and read again as the next one's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lettings.llm import decontaminate, jaccard_join, mixing, quality, token_files
from lettings.llm._shared import Cut, table
from lettings.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, at a score of 0.7 or more."""
    kept = quality.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1")
    return kept.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: documents as often as it takes them, whole."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its place, length and checksum in the token files."""
    files = token_files.write(docs, Path(tokenizer_file("word_bpe_49k.json")).read_text())
    return token_files.checksums(token_files.read(spark, files.path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]
#: The learnt and seeded stages have no form in SQL; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Cut(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return docs
