"""Consistent hashing with virtual nodes and bounded loads.

Every shard owns many points on a ring of hashes. A document belongs to the first point clockwise
of its own hash; if that shard is full it goes on clockwise to the next shard that has room. The
walk is done for all documents at once, shard after shard: in each round the documents without
a place ask the next shard with room on their way, and the first of them by hash get in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.operators.numbering import number_rows
from gridmill.sources.scratch import materialize


class Ring:
    """``points`` virtual nodes for each of ``shards`` shards, on a ring of signed 64-bit hashes."""

    def __init__(self, shards: int, points: int, seed: int = 0):
        hashes = np.array(
            [
                [xxhash.xxh64_intdigest(f"{shard}/{point}", seed) for point in range(points)]
                for shard in range(shards)
            ],
            np.uint64,
        ).view(np.int64)
        order = np.argsort(hashes.ravel(), kind="stable")
        self.hashes = hashes.ravel()[order]
        self.owners = np.repeat(np.arange(shards), points)[order]
        # The shards in the order in which a walk from each point meets them.
        self.walks = np.array([
            list(dict.fromkeys(np.roll(self.owners, -at).tolist())) for at in range(len(order))
        ])

    def point(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hashes, hashes) % len(self.hashes)

    def next_shard(self, hashes: np.ndarray, has_room: np.ndarray) -> np.ndarray:
        """For each hash the first shard of its walk that has room."""
        walks = self.walks[self.point(hashes)]
        first = np.argmax(has_room[walks], axis=1)
        return walks[np.arange(len(walks)), first]


def assign_shards(
    rows: DataFrame, shards: int, slack: float = 0.0, points: int = 256, seed: int = 0
) -> DataFrame:
    """Add ``shard`` and ``slot`` (0, 1, ... in the shard) to stored rows ``row, hash, ...``.

    With ``slack`` 0 the counts of any two shards are at most one apart: the first shards hold
    the rows that are left over. Else a shard holds up to ``(1 + slack)`` times the mean, and a
    further shard moves fewer rows. There are at most ``shards`` rounds, as each fills one. The
    rows that ask a shard are numbered in slices, so none passes through one task, and only the
    number of rows of each shard reaches the driver.
    """
    ring = Ring(shards, points, seed)
    total = rows.count()
    if slack:
        room = np.full(shards, int(np.ceil((1 + slack) * total / shards)))
    else:
        room = total // shards + (np.arange(shards) < total % shards)
    filled = np.zeros(shards, np.int64)
    placed, left = [], rows
    while left is not None:
        has_room = filled < room

        @F.pandas_udf("int")
        def asks(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in hashes:
                yield pd.Series(ring.next_shard(batch.to_numpy(), has_room))

        asked = materialize(
            number_rows(left.withColumn("shard", asks("hash")), "shard", ["hash", "row"], "_n"),
            "asked",
        )
        free = F.array(*[F.lit(int(n)) for n in room - filled])
        before = F.array(*[F.lit(int(n)) for n in filled])
        gets_in = F.col("_n") < F.get(free, F.col("shard"))
        counts = asked.groupBy("shard").agg(
            F.count_if(gets_in).alias("in"), F.count_if(~gets_in).alias("out")
        ).collect()
        placed.append(
            asked.where(gets_in)
            .withColumn("slot", F.get(before, F.col("shard")) + F.col("_n"))
            .drop("_n")
        )
        for row in counts:
            filled[row["shard"]] += row["in"]
        left = asked.where(~gets_in).drop("shard", "_n") if any(r["out"] for r in counts) else None
    result = placed[0]
    for part in placed[1:]:
        result = result.unionByName(part)
    return result


def shard_documents(
    docs: DataFrame, shards: int = 8, slack: float = 0.0, points: int = 256, seed: int = 0
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``.

    A row's place on the ring is the hash of ``doc_id``; null has a hash like any other value.
    Rows that repeat share a place and overflow like others. ``size`` is the text's UTF-8 bytes
    plus 1 (null: none), ``text_crc32`` is 0 for null and empty texts. Other columns are ignored;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            # A second round, as the hashes of near numbers are only as mixed as one round is.
            F.xxhash64(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").alias("hash"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "to_shard",
    )
    return assign_shards(rows, shards, slack, points, seed).select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )
