"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of documents is reduced to
digests; those that the index lacks are found by a sort-merge anti-join, in which only the batch
is shuffled, and appended. Copies are counted by partial aggregation, so a text that makes up a
third of all rows costs one row per task.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.names import free_name
from gridmill.sources.scratch import materialize, scratch_path


class DigestIndex:
    """Digests of all texts seen so far, in ``path``, a folder that all executors share.

    ``buckets`` is fixed when the index is made; take about one for each 128 MB that it shall
    hold. A later session opens the same index by the same path and number of buckets. One
    writer at a time: two jobs that append at once could both find a text new.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digests_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        spark.sql(
            f"create table if not exists {self.name} (digest binary, keep_id bigint,"
            " keep_row bigint, copies bigint, batch string) using parquet"
            f" clustered by (digest) sorted by (digest) into {buckets} buckets"
            f" location '{path}'"
        )

    def table(self) -> DataFrame:
        """``digest, keep_id, keep_row, copies, batch``: one row per text, as its first batch
        had it."""
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate a batch ``row_id, doc_id, digest`` and append its new texts.

        Returns each row with ``keep_id, group_size, kept``. Of equal texts in the batch the row
        with the largest ``doc_id`` stays (a null id is smaller than all; of rows that repeat an
        id the one with the larger ``row_id``). A text that an earlier batch brought is dropped,
        its ``keep_id`` is the row of that batch. ``group_size`` counts the rows of this batch
        and of the batch that brought the text.

        ``batch`` names the batch. A job that died may have appended its texts, so add the same
        rows by the same name again: what that name has brought counts as new, and is not appended
        twice. Without a name each call is a batch of its own.
        """
        batch = batch or uuid.uuid4().hex
        groups = materialize(
            rows.groupBy("digest").agg(
                F.max(F.struct("doc_id", "row_id")).alias("best"), F.count("*").alias("copies")
            ),
            "digest_groups",
        )
        fresh = groups.join(self.table().hint("merge"), "digest", "left_anti").select(
            "digest",
            F.col("best.doc_id").alias("keep_id"),
            F.col("best.row_id").alias("keep_row"),
            "copies",
            F.lit(batch).alias("batch"),
        )
        # The same hash deals rows to tasks and to buckets: each task writes one file.
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )
        # Row numbers are those of this call, also where an earlier try has brought the text.
        mine = F.col("batch") == batch
        # Written once more, so that the join below shuffles both sides and adaptive execution
        # may split the rows of one text.
        verdicts = materialize(
            groups.select("digest", "best", F.col("copies").alias("here"))
            .join(self.table().hint("merge"), "digest")
            .select(
                "digest",
                F.when(mine, F.col("best.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.when(mine, F.col("best.row_id")).alias("keep_row"),
                (F.col("here") + F.when(mine, 0).otherwise(F.col("copies"))).alias("group_size"),
            ),
            "digest_verdicts",
        )
        return rows.join(verdicts, "digest").select(
            "row_id",
            "doc_id",
            "digest",
            "keep_id",
            "group_size",
            F.col("row_id").eqNullSafe(F.col("keep_row")).alias("kept"),
        )

    def forget(self) -> None:
        """Take the index out of the session's catalog; its files stay, and it can be opened again
        by its path. What ``add`` has returned does not read it any more."""
        self.spark.sql(f"drop table if exists {self.name}")


def digest_rows(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, digest`` (SHA-256 of the UTF-8 text; null counts as empty), stored once,
    so that a row keeps its number when a lost task runs again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        ),
        "digests",
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the scratch folder, with as many buckets as a shuffle has partitions."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, scratch_path(spark, "digest_index"), buckets)


def _judged(rows: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    if index is not None:
        return index.add(rows, batch)
    index = fresh_index(rows.sparkSession)
    try:
        return index.add(rows)
    finally:
        index.forget()


def exact_duplicates(
    docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null texts are empty texts,
    and empty texts are equal; very long texts count whole. Of rows that repeat both id and text
    exactly one is kept. An empty table gives an empty result. Without ``index`` the batch is judged
    by itself; ``batch`` names it in the index, see ``DigestIndex.add``.
    """
    return _judged(digest_rows(docs), index, batch).select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    The documents are stored once with a row number, which the verdicts refer to: equal rows
    have nothing else to tell them apart.
    """
    columns = docs.columns
    row = free_name(columns, "_row")
    stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored.select(
        F.col(row).alias("row_id"),
        "doc_id",
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    kept = _judged(materialize(rows, "digests"), index, batch).where("kept").select(F.col("row_id").alias(row))
    return stored.join(kept, row, "left_semi").select(*columns)
