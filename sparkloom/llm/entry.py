"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, mixing, ngram_join, quality, sharding, simhash, spelling, substring_dedup, suffix_dedup, url_reputation, vector_codes
from .common import scratch, shuffle_cleanup, table
from .sql import ORACLE_SQL, mixing_sql

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Nobody else reads a query's own store, so replaced shards go at once.
SHARDS = sharding.Policy(retain_seconds=0.0)
#: Equal shares for twenty sources; languages and topics by hand.
TARGETS: mixing.Targets = {
    "source": {f"src{i}": 1.0 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15},
    "topic": {"general": 0.9, "legal": 0.02, "contact": 0.05, "tabular": 0.03},
}


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page is bad if its document is toxic or of low quality."""
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_key"), bad.alias("bad"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"), scratch(spark, "shards"), SHARDS).placement()


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes(spark, sf_dir), URL_RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=3)
    return df.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
        F.size("near_ids").cast("long").alias("n_near_items"), "n_near",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), TARGETS)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), every=199)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_url_reputation, op3_quality_rules, op4_substring_dedup, op5_decontamination, op6_license_scan, op7_simhash, op8_mixing, op9_suffix_dedup, op10_chat_snapshots, op11_vector_codes, op12_spelling_variants, op13_ngram_join)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {**ORACLE_SQL, "op8_mixing": mixing_sql(TARGETS)}
