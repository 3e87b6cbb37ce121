"""Audit of how far the sources of a language diverge, by hash-consed segment trees.

Terms of a language are numbered by falling count and cut into blocks. In a block each group (a
source, or the whole language) is a segment tree over term ids whose leaves are counts. Trees are
hash-consed: equal subtrees, of whatever group, are one node, so the long runs of terms that a group
lacks cost one node a level. Two trees are compared by walking them together from the roots. The walk
keeps each pair of nodes once with the number of places where it stands, so equal pairs of nodes
are priced once. What a block gives is a sum for each two groups and the best terms of each group.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.operators.numbering import number_rows
from gridmill.sources.scratch import materialize

#: Terms that fewer documents of the language have are left out.
LEAST_DOCUMENTS = 3
#: Ranks of terms that are returned.
TERM_RANKS = 200
#: p is in parts of this.
SCALE = 1_000_000_000
#: Cells (terms times groups) of a block at most, and terms at most.
BLOCK_CELLS = 1 << 22
BLOCK_TERMS = 1 << 12
#: Counted terms that a task holds before it passes them on.
HELD_TERMS = 400_000
#: Pairs of nodes that are walked through at a time.
_FRONT = 1 << 21
#: The leaf beyond the last term.
_OUTSIDE = -1

# Bytes that separate terms become blanks; only A to Z change case. Bytes above 127 belong to terms.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """Stored ``lang, source, term, n, documents``: occurrences, and documents that have the term.
    Tasks count before they pass on, so a hot source costs a row for each term and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, holders) in found.items():
                terms = [term.decode("utf-8") for term in times]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()),
                        pa.array([source] * len(terms), pa.string()),
                        pa.array(terms, pa.string()),
                        pa.array(times.values(), pa.int64()),
                        pa.array([holders[term] for term in times], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "documents"],
                )
            found.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
            for lang, source, text in zip(*columns, strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                times, holders = found[lang, source]
                times.update(terms)
                holders.update(set(terms))
            if sum(len(times) for times, _ in found.values()) > HELD_TERMS:
                yield from flush()
        yield from flush()

    schema = "lang string, source string, term string, n bigint, documents bigint"
    return materialize(
        docs.select("lang", "source", "text")
        .mapInArrow(count, schema)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")),
        "term_counts",
    )


def probability(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly, by long division in two steps."""
    divisor = total + terms
    if len(counts) and int(divisor.max()) >= 1 << 47:
        raise OverflowError("a language of more than 1.4e14 occurrences does not fit 64 bits")
    step = 31_250
    whole, rest = np.divmod((counts + 1) * step, divisor)
    return 1 + whole * (SCALE // step) + rest * (SCALE // step) // divisor


class Forest(NamedTuple):
    """Hash-consed trees over one block: ``leaves`` are counts by leaf id, ``children`` the left
    and right ids of each level's nodes from the leaves up, ``roots`` a node for each tree."""

    leaves: np.ndarray
    children: list[tuple[np.ndarray, np.ndarray]]
    roots: np.ndarray

    @property
    def nodes(self) -> int:
        return len(self.leaves) + sum(len(left) for left, _ in self.children)


def grow(counts: np.ndarray) -> Forest:
    """Trees over the rows of ``counts`` (a power of two wide), equal subtrees shared."""
    leaves, ids = np.unique(counts, return_inverse=True)
    ids = ids.reshape(counts.shape)
    children, known = [], len(leaves)
    while ids.shape[1] > 1:
        pairs = ids[:, 0::2].astype(np.int64) * known + ids[:, 1::2]
        nodes, below = np.unique(pairs, return_inverse=True)
        children.append((nodes // known, nodes % known))
        ids, known = below.reshape(pairs.shape), len(nodes)
    return Forest(leaves, children, ids[:, 0])


def walk(forest: Forest, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Walk the trees ``a[i]`` and ``b[i]`` together, for all i. Returns ``pair, count of a, count
    of b, places``: each two leaves that stand opposite in a pair of trees once, and how often."""
    pair = np.arange(len(a), dtype=np.int64)
    left, right = forest.roots[a].astype(np.int64), forest.roots[b].astype(np.int64)
    places = np.ones(len(a), np.int64)
    for depth in range(len(forest.children) - 1, -1, -1):
        lower, upper = forest.children[depth]
        known = len(forest.children[depth - 1][0]) if depth else len(forest.leaves)
        both = np.concatenate([lower[left], upper[left]]), np.concatenate([lower[right], upper[right]])
        # A pair of nodes met before is not walked through again.
        key = (np.tile(pair, 2) * known + both[0]) * known + both[1]
        key, met = np.unique(key, return_inverse=True)
        places = np.bincount(met, weights=np.tile(places, 2), minlength=len(key)).astype(np.int64)
        key, right = np.divmod(key, known)
        pair, left = np.divmod(key, known)
    return pair, forest.leaves[left], forest.leaves[right], places


def price_block(counts: np.ndarray, totals: np.ndarray, terms: int) -> Iterator[tuple[int, int, int]]:
    """``(group, other, value)`` for each two of the groups, the rows of ``counts``: the sum of
    f over the block with p of the group and q of the other."""
    forest = grow(counts)
    groups = len(totals)
    first, second = np.triu_indices(groups, 1)
    at_once = max(1, _FRONT // counts.shape[1])
    for start in range(0, len(first), at_once):
        a, b = first[start : start + at_once], second[start : start + at_once]
        pair, of_a, of_b, places = walk(forest, a, b)
        inside = of_a != _OUTSIDE
        pair, of_a, of_b, places = pair[inside], of_a[inside], of_b[inside], places[inside]
        p = probability(of_a, totals[a[pair]], terms)
        q = probability(of_b, totals[b[pair]], terms)
        square = (p - q) * (p - q)
        for group, other, f in ((a, b, square // q), (b, a, square // p)):
            value = np.zeros(len(a), np.int64)
            np.add.at(value, pair, f * places)
            yield from zip(group.tolist(), other.tolist(), value.tolist(), strict=True)


def best_terms(
    counts: np.ndarray, total: int, whole: np.ndarray, whole_total: int, terms: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """``slots, values`` of the terms of a group, against the whole language, that may be among the
    first ``TERM_RANKS``: of value ``least`` or more, and all that tie with the last of them but for
    those behind ``TERM_RANKS`` others of the same count in the language, which come first by term."""
    slots = np.flatnonzero(counts > 0)
    # Two leaves that stand opposite in several places are priced once.
    pairs, place = np.unique(np.stack([counts[slots], whole[slots]]), axis=1, return_inverse=True)
    place = place.reshape(-1)
    p = probability(pairs[0], np.full(pairs.shape[1], total), terms)
    q = probability(pairs[1], np.full(pairs.shape[1], whole_total), terms)
    priced = np.where(p > q, (p - q) * (p - q) // q, -1)
    order = np.argsort(place, kind="stable")
    firsts = np.cumsum(np.bincount(place, minlength=pairs.shape[1])) - np.bincount(place, minlength=pairs.shape[1])
    turn = np.empty(len(place), np.int64)
    turn[order] = np.arange(len(place)) - firsts[place[order]]
    value = priced[place]
    fits = (value >= max(least, 0)) & (turn < TERM_RANKS)
    slots, value = slots[fits], value[fits]
    if len(value) > TERM_RANKS:
        last = np.partition(value, len(value) - TERM_RANKS)[len(value) - TERM_RANKS]
        slots, value = slots[value >= last], value[value >= last]
    return slots, value


#: Rows of a block that are no counts: totals of the groups, and facts of the language.
_TOTAL, _FACTS = -1, -2
_CELLS = ["lid", "block", "gid", "slot", "n"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``language, block, [group, slot, n]`` of whole blocks. The input is sorted."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _CELLS], axis=1)
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        for part in np.split(rows, cuts):
            if not len(part):
                continue
            if held and (held[-1][0, :2] != part[0, :2]).any():
                whole = np.concatenate(held)
                yield int(whole[0, 0]), int(whole[0, 1]), whole[:, 2:]
                held = []
            held.append(part)
    if held:
        whole = np.concatenate(held)
        yield int(whole[0, 0]), int(whole[0, 1]), whole[:, 2:]


def _audit(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``lid, gid, pair, item, value``: sums for two groups, and best terms by their id."""
    # The values of the best terms of each group so far; later blocks give better ones only.
    best: dict[tuple[int, int], np.ndarray] = {}
    for lang, block, rows in _blocks(batches):
        heads = rows[rows[:, 0] == _TOTAL]
        totals = np.zeros(len(heads), np.int64)
        totals[heads[:, 1]] = heads[:, 2]
        facts = rows[rows[:, 0] == _FACTS]
        whole_total, terms = (int(facts[facts[:, 1] == k, 2][0]) for k in (0, 1))
        cells = rows[rows[:, 0] >= 0]
        size = 1 << int(cells[:, 1].max()).bit_length()
        # The whole language is the group behind the others and has every term.
        counts = np.zeros((len(totals) + 1, size), np.int64)
        counts[cells[:, 0], cells[:, 1]] = cells[:, 2]
        out = []
        for group in range(len(totals)):
            held = best.get((lang, group), np.zeros(0, np.int64))
            least = int(held.min()) if len(held) == TERM_RANKS else 0
            slots, values = best_terms(counts[group], int(totals[group]), counts[-1], whole_total, terms, least)
            best[lang, group] = np.sort(np.concatenate([held, values]))[-TERM_RANKS:]
            out += [(lang, group, False, block * width + slot, value) for slot, value in zip(slots.tolist(), values.tolist())]
        counts[:, counts[-1] == 0] = _OUTSIDE
        out += [(lang, group, True, other, value) for group, other, value in price_block(counts[:-1], totals, terms)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lid", "gid", "pair", "item", "value"]
        )


def kept_terms(counts: DataFrame) -> DataFrame:
    """Stored ``lang, term, id, n``: the terms of a language with documents enough, numbered from
    0 by falling count, ties by the term. Rare terms lie side by side, where most groups have
    none of them, so that whole subtrees are equal."""
    kept = (
        counts.groupBy("lang", "term")
        .agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))
        .where(F.col("documents") >= LEAST_DOCUMENTS)
        .select("lang", "term", "n", (-F.col("n")).alias("falling"))
    )
    return materialize(number_rows(kept, "lang", ["falling", "term"], "id").drop("falling"), "kept_terms")


def audit_divergence(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs from the
    others (part ``pair``, item the other source) and by which terms from the whole language
    (part ``term``, the first 200).

    ``docs`` has ``lang, source, text``; other columns are ignored. Nulls count as empty strings
    in all three; documents without a term still make their group occur. A language without a kept
    term has pairs of value 0 and no terms; a language of one source has no pairs. Equal values
    rank by the item's UTF-8 bytes. Rows that repeat count each; very long texts count whole; an
    empty table gives an empty result.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(docs)
    kept = kept_terms(counts)
    occurrences = materialize(
        counts.join(kept.select("lang", "term", "id"), ["lang", "term"]).select("lang", "source", "id", "n"),
        "occurrences",
    )
    totals = occurrences.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    # One row for a language: its groups in order, their occurrences, and its number of terms.
    langs = materialize(
        groups.groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("whole")), "lang", "left")
        .withColumn("lid", F.monotonically_increasing_id()),
        "languages",
    )
    members = materialize(
        langs.select("lang", "lid", F.posexplode("groups").alias("gid", "group")).select(
            "lang", "lid", "gid", "group.source", "group.total"
        ),
        "members",
    )
    most = langs.agg(F.max(F.size("groups"))).first()[0] or 0
    width = BLOCK_TERMS
    while width > 64 and width * (most + 1) > BLOCK_CELLS:
        width //= 2
    block, slot = F.floor(F.col("id") / width).alias("block"), (F.col("id") % width).cast("int").alias("slot")
    ends = langs.select("lang", "lid", F.size("groups").alias("gid"), "terms", "whole")
    blocks = (
        langs.where(F.col("terms") > 0)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("terms") - 1) / width))))
    )
    parts = [
        occurrences.join(members.drop("total"), ["lang", "source"]).select("lid", block, "gid", slot, "n"),
        kept.join(ends, "lang").select("lid", block, "gid", slot, "n"),
        blocks.select("lid", "block", F.posexplode("groups").alias("slot", "group")).select(
            "lid", "block", F.lit(_TOTAL).alias("gid"), "slot", F.col("group.total").alias("n")
        ),
        blocks.select("lid", "block", F.posexplode(F.array("whole", "terms")).alias("slot", "n")).select(
            "lid", "block", F.lit(_FACTS).alias("gid"), "slot", "n"
        ),
    ]
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    found = materialize(
        cells.repartition("lid", "block")
        .sortWithinPartitions("lid", "block")
        .mapInArrow(lambda batches: _audit(batches, width), "lid bigint, gid int, pair boolean, item bigint, value bigint"),
        "divergence",
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    other = members.select("lid", F.col("gid").cast("bigint").alias("item"), F.col("source").alias("other"))
    sums = found.where("pair").groupBy("lid", "gid", "item").agg(F.sum("value").alias("value"))
    pairs = (
        members.select("lang", "lid", "gid", "source")
        .join(other, "lid")
        .where(F.col("gid") != F.col("item"))
        .join(sums, ["lid", "gid", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"),
                F.coalesce("value", F.lit(0)).alias("value"))
        .withColumn("rank", F.row_number().over(order))
    )
    # Ids of a group are distinct, so ranks by value alone leave out what can't be among the first.
    by_value = Window.partitionBy("lid", "gid").orderBy(F.desc("value"))
    terms = (
        found.where("not pair")
        .withColumn("rank", F.rank().over(by_value))
        .where(F.col("rank") <= TERM_RANKS)
        .join(members.select("lang", "lid", "gid", "source"), ["lid", "gid"])
        .join(kept.select("lang", F.col("id").alias("item"), "term"), ["lang", "item"])
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= TERM_RANKS)
    )
    return pairs.unionByName(terms)
