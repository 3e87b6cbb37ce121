"""Audit of how filters overlap, in every order that they can be applied in.

Each filter is judged on the whole table once. Copies are found by an existential self-join: a row
with a smaller ``doc_id``, the same hash and the same text exists. The ids of the copies and those
that fail the other filters are united, and the bits of each document become one number. What any
order of the filters keeps, removes and shares follows from the counts of those numbers, so the
documents are read once and not once for each order.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.sources.scratch import materialize

#: The filters that look at one text, in the order of their bits; the copies come after them.
TEXT_FILTERS = "ABCD"
COPIES = "E"
FILTERS = TEXT_FILTERS + COPIES
ORDERS = ["".join(order) for order in permutations(FILTERS)]
#: Copies of one text that share a task.
SALT_ROWS = 1000

_SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Whether a text (never null) fails the filters A to D."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals > 5 * F.length(text),
        F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    ]


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def copies_of_smaller_ids(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """``doc_id, digest`` of the texts that a smaller ``doc_id`` has as well.

    ``facts`` is stored and has ``doc_id, digest`` of each row. Only texts whose hash occurs twice
    are moved. Of the smaller ids one is enough, the least; the copies of a hot text are dealt to
    one task for each thousand, and the least one goes to each of them.
    """
    repeated = facts.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    salts = F.ceil(F.col("copies") / SALT_ROWS)
    wanted = materialize(
        facts.where(F.col("doc_id").isNotNull())
        .join(repeated, "digest")
        .select("digest", "doc_id", salts.alias("salts"))
        .distinct(),
        "repeated_texts",
    )
    # Digest and id together spread the copies of one text over the tasks. The merge join needs no
    # table in memory at any size.
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = materialize(
        docs.select("doc_id", text.alias("text"), _digest(text).alias("digest"))
        .join(wanted.hint("merge"), ["digest", "doc_id"])
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts"))),
        "texts_to_compare",
    )
    least = (
        texts.groupBy("digest", "text")
        .agg(F.min("doc_id").alias("least"), F.max("salts").alias("salts"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    )
    mine, other = texts.alias("mine"), least.alias("other")
    same = [F.col(f"mine.{c}") == F.col(f"other.{c}") for c in ("digest", "salt", "text")]
    smaller = F.col("other.least") < F.col("mine.doc_id")
    return mine.join(other, [*same, smaller], "left_semi").select("doc_id", "digest").distinct()


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, documents, good, toxic``: how many documents of a source fail exactly the
    filters whose bits are set, and how many of them are labelled good and toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = F.lit(0)
    for bit, fails in enumerate(text_failures(text)):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    facts = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.coalesce(F.col("source"), F.lit("")).alias("part"),
            mask.alias("mask"),
            _digest(text).alias("digest"),
        ),
        "filter_facts",
    )
    copies = copies_of_smaller_ids(docs, facts)
    failed_copies = facts.join(copies, ["doc_id", "digest"], "left_semi").select(
        "row",
        F.lit(None).cast("bigint").alias("doc_id"),
        F.lit(None).cast("string").alias("part"),
        F.lit(1 << FILTERS.index(COPIES)).alias("mask"),
    )
    judged = (
        facts.select("row", "doc_id", "part", "mask")
        .unionByName(failed_copies)
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("part").alias("part"), F.bit_or("mask").alias("mask"))
    )
    marks = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    return (
        judged.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count("*").alias("documents"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
    )


def every_order(counts: DataFrame) -> DataFrame:
    """The audit of each part from its ``failure_counts``. A part has one row for each set of
    failures at most (32), so they are held as one list."""
    parts = counts.groupBy("part").agg(
        F.collect_list(F.struct("mask", "documents", "good", "toxic")).alias("sets")
    )
    bits = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    own, before = F.lit(0), F.lit(0)
    for name, bit in bits.items():
        own = own + F.when(letter == name, bit).otherwise(0)
        before = before + F.when(F.contains(earlier, F.lit(name)), bit).otherwise(0)
    steps = (
        parts.withColumn("filter_order", F.explode(F.array(*[F.lit(order) for order in ORDERS])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("own", own)
        .withColumn("before", before)
    )

    def total(of, where):
        start = F.lit(0).cast("bigint")
        return F.aggregate("sets", start, lambda t, s: t + F.when(where(s["mask"]), of(s)).otherwise(0))

    def fails(mask):
        return mask.bitwiseAND(F.col("own")) != 0

    def gone(mask):
        return mask.bitwiseAND(F.col("before")) != 0

    def removed(mask):
        return fails(mask) & ~gone(mask)

    def of_first(found):
        # In as many orders is the filter the first of those that the documents fail.
        return found["documents"] * F.expr(f"{math.factorial(len(FILTERS))}L") / F.bit_count(found["mask"])

    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda s: s["documents"], lambda m: ~(fails(m) | gone(m))).alias("kept"),
        total(lambda s: s["documents"], removed).alias("removed"),
        total(lambda s: s["documents"], lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda s: s["documents"], lambda m: m == F.col("own")).alias("unique_fails"),
        total(lambda s: s["good"], removed).alias("good_lost"),
        total(lambda s: s["toxic"], removed).alias("toxic_lost"),
        total(lambda s: of_first(s).cast("bigint"), fails).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per source, order of the five filters and step: ``part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``docs`` has ``doc_id, text, source``, ``labels`` has ``doc_id, quality, toxic``; other columns
    are ignored. A null text is empty, a null source is the part ``''``. A row without ``doc_id``
    is no copy, has no copy and has no label. Rows that repeat an id count each; a text that
    repeats under one id only is no copy of a smaller one. A document is good or toxic if one of
    its labels says so. Very long texts count whole. Without documents there are no rows.
    """
    return every_order(materialize(failure_counts(docs, labels), "failure_counts"))
