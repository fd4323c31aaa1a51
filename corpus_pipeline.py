"""The corpus pipeline: language, near copies, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import language, mixing, packing, pii, simhash
from chronolith.llm.common import stored, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learnt from the corpus, knows; those it rejects go."""
    return language.keep_identified(docs, language.train(table(spark, sf_dir, "documents")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_first(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and words that disclose it, out of the texts."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of source, language and topic."""
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language", identify), ("near_copies", deduplicate), ("personal_data", sanitise), ("mixture", mix), ("packing", pack)]

#: SQL expresses none of the stages but parts of them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
