"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import language_id, mixing, packing, simhash_dedup, suffix_dedup
from tidewell.llm.common import shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found stay as they are; those with null or empty text, or without a letter, go.

    Repeated rows stay or go together; a null doc_id doesn't matter; an empty table stays empty.
    """
    return language_id.keep_identified(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group stays, with all rows that repeat this id.

    Null and empty texts form one group. A null doc_id stays only where its whole group has none.
    """
    return simhash_dedup.keep_first(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere are cut out of the texts; every row stays, null texts null."""
    return suffix_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated as often as the fitted rates say; none falls below one, so no document is lost. Rows of one doc_id are one document."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), lowest=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences; null text counts as empty."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", language),
    ("simhash near-dedup", simhash),
    ("suffix-array dedup", suffixes),
    ("mixing", mixture),
    ("packing", pack),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py compares each with brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's table goes when the next one is written, but for the last that is read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _delete(spark, before)
            before = path
    return docs
