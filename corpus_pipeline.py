"""The corpus pipeline: each stage takes the documents that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayflow.llm import decontaminate, exact_dedup, packing, quality, similar
from assayflow.llm.common import materialize, table
from assayflow.llm.queries import tokenizer_path
from assayflow.sources.scratch import scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_similar(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", clean_of_benchmark),
    ("best_fit_packing", packed),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # what a stage wrote on its way goes once its result is written
        with scope(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            made.pop()
    return STAGES[-1][1](spark, docs, sf_dir)
