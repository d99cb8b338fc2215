"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gustline.llm import decontamination, mixing, ngram_join, quality, sharding
from gustline.llm.common import table
from gustline.session import materialise, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go.

    Null and empty texts go; repeated rows, ties and rows without an id are judged one by one; columns of any name stay; empty tables stay empty.
    """
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest id: five-word shingles, a similarity of 0.8 or more.

    Rows without an id and texts without words link with nothing and stay; of rows that repeat an id, one stays; columns of any name stay.
    """
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Texts without words hold none; rows that share an id are told apart by their texts; columns of any name stay.
    """
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target weights; a document comes once for each epoch that reaches it.

    Null names are a value of their own; texts without words come along with their place in the epoch; columns stay but for one named ``_stage_epoch``.
    """
    return mixing.corpus_mix(spark, docs, epoch="_stage_epoch").drop("_stage_epoch")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place in it.

    Null texts have the size 1; columns that are named like the outputs (size, text_crc32, curve, shard, slot) are replaced, others stay.
    """
    return sharding.hilbert_shards(docs, keep=list(docs.columns))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("ngram_join", near_duplicates), ("decontamination", decontaminated),
    ("source_mix", mixed), ("sharding", sharded)]

#: The mix and the shards follow seeded hashes that SQL lacks; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
