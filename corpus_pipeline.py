"""The corpus pipeline: documents through five operators, each over all that the one before kept.

Language identification drops texts that have no language (null, or without a
letter); of each group of near duplicates one document stays; documents that hold benchmark passages go; the rest
is mixed to target weights by source, which repeats and leaves out documents; and
the mix is packed into shards, groups of equal texts whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleweave.llm.common import saved, table
from ruleweave.llm.decontaminate import decontaminate
from ruleweave.llm.language_id import known_language
from ruleweave.llm.mixing import mix
from ruleweave.llm.near_dedup import near_dedup
from ruleweave.llm.sharding import shard


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicates_stage),
    ("decontaminate", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Signatures, forward sums and edit distances have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, size, text_crc32, law, shard, slot and grown_shard of each document of the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
