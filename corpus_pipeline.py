"""The corpus pipeline: each stage's rows are written as Parquet and read again as the next one's input.

The stages: bad lines and rejected documents go; one document of each near-duplicate group stays;
documents that hold a benchmark item go; sources are mixed to their targets, so that rows are copies in
training order; token files are written and read back.

A stage is given a direct scan of the Parquet files that the stage before it wrote (the first one the
table itself), so rows can be told apart by their place in a file.

Rows with null, empty or wordless texts end at the first stage; a null source, repeated rows and further
columns are kept as each operator defines it; empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm import decontaminate, mixing, quality, simhash, token_files
from tamarisk.llm.base import with_row_numbers
from tamarisk.session import materialise, scratch_path

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, then documents that lost too much or fail as a whole."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fingerprints of three-word shingles link at two bits, directly or over others, are a group; its first row stays."""
    return simhash.one_of_each(docs, scanned=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with edits, go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each taken copy, in training order."""
    return mixing.mixed(docs, scanned=True)


def binary_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every trained copy, in training order, read back from the token files."""
    path = scratch_path(spark, "tokens")
    token_files.write(with_row_numbers(docs, "_t_row", scanned=True), path, token_files.public_vocabulary(), order="_t_row")
    return token_files.read(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("binary_tokens", binary_tokens),
]
ORACLE_SQL = None  # fingerprints, edit-distance windows and a public vocabulary are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
