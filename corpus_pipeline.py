"""A corpus from raw documents to packed training sequences, in stages that are each stored."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridmill.llm.digest_index import drop_exact_duplicates
from gridmill.llm.mixing import take_mix
from gridmill.llm.near_join import drop_near_duplicates
from gridmill.llm.packing import pack_documents
from gridmill.llm.queries import TOKENIZER
from gridmill.llm.toxicity import drop_toxic
from gridmill.sources.scratch import delete_folder, scratch_in, scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; learned from ``labels`` of documents in ``docs``
    that are not held out."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, the one with the largest ``doc_id``."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest
    ``doc_id``: sets of five-word n-grams with a similarity of 0.8 or more."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of the documents in sequences of at most 4096 ids."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Scores, hashes of shingles and tokens are out of reach of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet and read again. What a stage
    stores on its way, and its input, go once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        path, own = scratch_path(spark, f"stage{number}"), scratch_path(spark, "scratch")
        with scratch_in(own):
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        for folder in (own, before):
            if folder is not None:
                delete_folder(spark, folder)
        before = path
    return docs
