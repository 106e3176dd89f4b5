"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


from apexframe.llm import decontaminate, mixing, quality, resemblance, simhash, tokens
from apexframe.llm.common import DOCUMENT_COLUMNS, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line field is fitted on the labelled ones among them."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return quality.filtered(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS), find=resemblance.near_duplicates)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, repeated as often as it takes them, each copy with its place in the training order."""
    return mixing.training_order(docs.select(*DOCUMENT_COLUMNS))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids written as ORC in training order and read back: the place and checksum of each copy of a document."""
    return tokens.binary_output(docs, public_tokenizers.path("byte_bpe_50k.json"), order="training_position")[1]


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_id_output", token_output),
]

ORACLE_SQL = None  # tokenizer, fingerprints and the fitted field have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
