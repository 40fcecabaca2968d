"""The corpus pipeline: each stage works on all that the one before it kept.

language: documents without a letter go, and those that score lower than all but one in a thousand of the held-out documents
whose language is predicted right. lines: lines found in ten documents or more go. near: one document of each component of
texts whose five-word shingles are alike (Jaccard 0.8 or more) stays. benchmark: documents that hold a benchmark item, whole
or edited, go. packing: what is left is packed into sequences. All stages but the last return the columns of documents. Nulls, empty tables, ties and clashing
columns are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import decontaminate, language, line_dedup, packing, shared, similar


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_common_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.first_of_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL cannot express hyperdimensional profiles, SimHash, alignment or tokenizers; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, shared.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            shared.drop(before)  # the next stage's table no longer needs it
    return STAGES[-1][1](spark, docs, sf_dir)
