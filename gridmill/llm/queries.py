"""The registered queries of the operators; ``ORACLES`` has the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.compression import compression_rules
from gridmill.llm.digest_index import exact_duplicates
from gridmill.llm.disclosure import find_personal
from gridmill.llm.divergence import audit_divergence
from gridmill.llm.filter_audit import audit_filters
from gridmill.llm.language import identify_languages
from gridmill.llm.mixing import mix_sources
from gridmill.llm.near_join import near_duplicates
from gridmill.llm.oracles import ORACLES
from gridmill.llm.packing import pack_documents
from gridmill.llm.secret_scan import scan_secrets
from gridmill.llm.sharding import shard_documents
from gridmill.llm.substring_dedup import remove_repeats
from gridmill.llm.toxicity import score_toxicity

__all__ = ["ORACLES", "QUERIES", "TOKENIZER"]

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op3_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(_table(spark, sf_dir, "documents"), learn=True)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    sizes = F.transform("removed", lambda s: s["stop"] - s["start"])
    removed = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, size: total + size)
    return cut.select(
        "doc_id", "n_words", F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_divergence(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_compression": op3_compression,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_near_join": op8_near_join,
    "op9_sharding": op9_sharding,
    "op10_secrets": op10_secrets,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_divergence": op12_divergence,
    "op13_filter_audit": op13_filter_audit,
}
