"""Variables of a file from the period of its messages, for names that return within a time step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.operators.messages import discover_variables, strides
from gridmill.sources.scratch import materialize

#: Messages of a file that one task orders.
CHUNK = 1 << 16
#: Sums are taken modulo these primes, with these bases. Products of two fit 64 bits.
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = (1_103_515_245, 1_597_334_677)


def with_keys(messages: DataFrame, keys: Sequence[int]) -> DataFrame:
    """``name`` with the fields ``keys`` of the description (its colon-separated parts, from 1) behind
    it, such as the level: one variable for each of their values. Needs ``description``."""
    fields = [F.get(F.split("description", ":"), F.lit(key - 1)) for key in keys]
    return messages.withColumn("name", F.when(F.col("name").isNotNull(), F.concat_ws(" ", "name", *fields)))


def _powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    result, factor = np.ones(len(exponents), np.int64), np.int64(base)
    rest = exponents.copy()
    while rest.any():
        result = np.where(rest & 1 == 1, result * factor % prime, result)
        factor, rest = factor * factor % prime, rest >> 1
    return result


def _weighted(named: DataFrame) -> DataFrame:
    """Add for each prime ``power``, base ** msg_no, and ``weight``, that times the message's hash."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, own = batch.column("msg_no").to_numpy(), batch.column("own").to_numpy()
            columns = []
            for prime, base in zip(_PRIMES, _BASES, strict=True):
                power = _powers(base, prime, number)
                columns += [pa.array(power), pa.array(power * (own % prime) % prime)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, "power0", "weight0", "power1", "weight1"]
            )

    schema = "file string, msg_no bigint, own bigint, power0 bigint, weight0 bigint, power1 bigint, weight1 bigint"
    return named.mapInArrow(weigh, schema)


def find_periods(messages: DataFrame) -> DataFrame:
    """Stored ``file, stride``: the smallest period of each file's sequence of names of which it has
    two at least; files without one are not in it. ``msg_no`` counts from 0 without gaps.

    p is a period if the sequence without its last p names equals that without its first p. Both
    are compared by hashes that sum over the messages, weighted by powers of their number: sums
    up to each place come from sums per chunk of a file, so no task holds more than a chunk of a
    file, and one join of the places with the places opposite tests all candidates of all files.
    Different sequences are taken for equal once in 2**62.
    """
    named = messages.select("file", "msg_no", F.xxhash64("name").alias("own"))
    chunk = F.expr(f"msg_no div {CHUNK}")
    weighted = materialize(_weighted(named).withColumn("chunk", chunk), "weighted_names")
    sums = [F.sum(f"weight{k}").alias(f"sum{k}") for k in (0, 1)]
    chunks = weighted.groupBy("file", "chunk").agg(*sums)
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(
        "file", "chunk",
        *[(F.coalesce(F.sum(f"sum{k}").over(earlier), F.lit(0)) % _PRIMES[k]).alias(f"before{k}") for k in (0, 1)],
    )
    within = Window.partitionBy("file", "chunk").orderBy("msg_no").rowsBetween(Window.unboundedPreceding, -1)
    # Sums over the messages before each one.
    places = materialize(
        weighted.join(before, ["file", "chunk"]).select(
            "file", "msg_no", "own", "power0", "power1",
            *[
                ((F.col(f"before{k}") + F.coalesce(F.sum(f"weight{k}").over(within), F.lit(0))) % _PRIMES[k]).alias(f"s{k}")
                for k in (0, 1)
            ],
        ),
        "places",
    )
    whole = materialize(
        weighted.groupBy("file").agg(
            F.count("*").alias("num"),
            F.min_by("own", "msg_no").alias("opening"),
            *[(F.sum(f"weight{k}") % _PRIMES[k]).alias(f"all{k}") for k in (0, 1)],
        ),
        "whole_files",
    )
    candidates = (
        places.join(whole, "file")
        .where((F.col("msg_no") > 0) & (2 * F.col("msg_no") <= F.col("num")) & (F.col("own") == F.col("opening")))
        .drop("own", "opening")
        .withColumn("opposite", F.col("num") - F.col("msg_no"))
    )
    opposite = places.select(
        "file", F.col("msg_no").alias("opposite"), F.col("s0").alias("o0"), F.col("s1").alias("o1")
    )
    equal = F.lit(True)
    for k in (0, 1):
        prime = _PRIMES[k]
        shifted = F.col(f"o{k}") * F.col(f"power{k}") % prime
        equal = equal & (shifted == F.pmod(F.col(f"all{k}") - F.col(f"s{k}"), F.lit(prime)))
    return materialize(
        candidates.join(opposite, ["file", "opposite"])
        .where(equal)
        .groupBy("file")
        .agg(F.min("msg_no").alias("stride")),
        "periods",
    )


def discover_periods(messages: DataFrame) -> DataFrame:
    """``file, var_ix, name, stride`` as ``discover_variables`` gives them, but right for files in
    which a name returns within a time step: the stride is the period of the names, and the
    second use of a name in it is called ``name #2``, and so on. Files without a period, in which
    messages are missing or which end before the second, have the rule of the first repeat."""
    found = find_periods(messages)
    first = strides(discover_variables(messages)).join(found, "file", "left_anti")
    known = found.select("file", "stride").unionByName(first.withColumn("stride", F.col("stride").cast("bigint")))
    opening = messages.select("file", "msg_no", "name").join(known, "file").where(F.col("msg_no") < F.col("stride"))
    # A file's first period is as long as its list of variables.
    use = F.row_number().over(Window.partitionBy("file", "name").orderBy("msg_no"))
    again = F.when(use > 1, F.concat("name", F.lit(" #"), use.cast("string")))
    return opening.select(
        "file",
        F.col("msg_no").cast("int").alias("var_ix"),
        F.coalesce(again, F.col("name")).alias("name"),
        F.col("stride").cast("int").alias("stride"),
    )
