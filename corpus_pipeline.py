"""The corpus pipeline: toxicity, line dedup, near-duplicates, source mixture and packing, one after another.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns of documents, the
last one its pieces. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import lines, mixing, near, packing, toxicity
from tracewell.llm.common import landed


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each class of lines once; copies that only their edits are left of go."""
    return lines.drop_repeats(docs)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: smaller ones are read again until the largest is through, and no document is left out."""
    return mixing.mix(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture in windows of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out), ("line dedup", lines_once), ("near-dedup", near_once), ("mixing", mixed), ("packing", packed)]

#: Learned toxicity marks and tokenizer ids are beyond SQL; tests/llm compare the line and near-duplicate stages with all pairs, not the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = landed(docs, "stage")
    return docs
