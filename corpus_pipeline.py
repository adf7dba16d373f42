"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and
hands the files to the next stage.  All stages but the last return the columns of
``documents``.

Rows pass whole or not at all, but that mixing may repeat them.  NULL and repeated ids are handled by the operators:
rows equal in id and text share their fate, except that near-duplicate removal keeps
one row of each component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, mixing, quality, sharding, simhash
from sparkloom.llm.common import scratch, shuffle_cleanup, stored, table
from sparkloom.llm.entry import SHARDS, TARGETS

#: Setting that names the folder of the finished shards.
SHARDS_DIR = "spark.sparkloom.shards.dir"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no robust outliers."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares meet the targets: documents of rare cells are repeated."""
    return mixing.sample(docs, TARGETS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in the compacted store.

    The store is at ``spark.sparkloom.shards.dir`` and stays there; where that is unset it
    lies in the shared folder until the driver ends.
    """
    root = spark.conf.get(SHARDS_DIR, None)
    store = sharding.shard_table(docs, root) if root else sharding.shard_table(docs, scratch(spark, "shards"), SHARDS)
    return store.placement()


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: SQL has neither XXH64 fingerprints nor their components; tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffle_cleanup(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
