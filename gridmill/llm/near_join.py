"""Jaccard similarity join on word n-grams by MinHash banding.

Equal texts are one class. Each class gets a MinHash signature of its set of n-grams; classes
that agree on all rows of a band meet in a bucket of that band. Meetings whose signatures don't
rule the threshold out make clusters. Within a cluster every pair is verified on the full n-gram
sets. Buckets and clusters are cut into blocks and each two blocks meet in a cell of their own, so
a task never holds more than two blocks at once, and what leaves a cell is one row for a member
(its number of links, and the first member it hangs together with) and not one for a pair. So a
group of many near copies costs rows in proportion to its size and its number of blocks. Groups
are connected components, found by passing on the smallest label with pointer jumping.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.names import free_name
from gridmill.sources.scratch import materialize

#: Classes of a bucket that are compared with each other at a time.
BLOCK = 256
#: N-grams that are looked at together when pairs of a cell are verified.
_COLUMNS = 4096
#: Signatures rule a pair out when their agreement is so many standard deviations too low.
DEVIATIONS = 4.0


class Bands(NamedTuple):
    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def choose_bands(threshold: float, recall: float, hashes: int) -> Bands:
    """The most rows for a band (the fewest false candidates) with which ``hashes`` hashes still
    find a pair at the threshold with probability ``recall``."""
    found = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if rows * bands > hashes:
            break
        found = Bands(bands, rows)
    if found is None:
        raise ValueError("too few hashes for this recall")
    return found


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of lower-case words (between ASCII white
    space). A text with fewer words has one n-gram, of all its words, and one without words has
    none."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(word) for word in (text or "").lower().encode("utf-8").split()], np.uint64)
    if not len(words):
        return words
    width = min(n, len(words))
    grams = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k]
        grams ^= grams >> np.uint64(29)
    return np.unique(_mixed(grams))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def signature(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set, cut to 16 bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        part = grams[at : at + 512, None] * factors[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


def _factors(count: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1 << 32, 1 << 63, count, np.uint64) | np.uint64(1)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_classes(docs: DataFrame, n: int, hashes: int) -> DataFrame:
    """One stored row per distinct text: ``class, digest, first_doc, copies, grams, signature``.

    ``first_doc`` is the smallest ``doc_id`` of the copies (null only if all are)."""
    factors = _factors(hashes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signatures = [], []
            for text in batch.column("text"):
                grams = ngram_set(text.as_py(), n)
                sizes.append(len(grams))
                signatures.append(signature(grams, factors).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("digest"),
                    pa.array(sizes, pa.int32()),
                    pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "digest", "grams", "signature"],
            )

    signed = docs.select("doc_id", "text", _digest(F.col("text")).alias("digest")).mapInArrow(
        sign, "doc_id bigint, digest binary, grams int, signature binary"
    )
    return materialize(
        signed.groupBy("digest")
        .agg(
            F.min("doc_id").alias("first_doc"),
            F.count("*").alias("copies"),
            F.first("grams").alias("grams"),
            F.first("signature").alias("signature"),
        )
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )


def _cut(members: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Each row of ``members`` once for each cell ``(group, low, high)`` that it belongs to: a
    member of block i goes to the cells of i and any other block j."""
    blocks = F.ceil(F.col(size) / block)
    return (
        members.withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), blocks))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .withColumn("low", F.least("block", "_other"))
        .withColumn("high", F.greatest("block", "_other"))
        .drop("_other", size)
        .repartition(group, "low", "high")
        .sortWithinPartitions(group, "low", "high", "class")
    )


def _cells(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells, with the row at which each cell starts. The input is sorted."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        starts = _starts(table, group)
        # The last cell may go on in the next batch.
        rest = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if rest is not None:
        yield rest.combine_chunks(), np.zeros(1, np.int64)


def _starts(table: pa.Table, group: str) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for column in (group, "low", "high"):
        values = table.column(column).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest row of its set) after joining the sets of ``i`` and ``j``."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further


def candidate_edges(
    classes: DataFrame, bands: Bands, threshold: float, block: int = BLOCK
) -> DataFrame:
    """``a, b`` with a < b: edges that connect all classes that meet in a bucket and may reach
    the threshold, at most one for a class and cell."""
    count, rows = bands
    width, hashes = 2 * rows, count * rows
    signed = classes.where("grams > 0").select("class", "grams", "signature")
    banded = signed.select(
        "class",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(count - 1)),
                lambda k: F.xxhash64(k, F.substring("signature", k * width + 1, F.lit(width))),
            )
        ).alias("bucket"),
    )
    shared = materialize(
        banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets"
    )
    spread = math.sqrt(threshold * (1 - threshold) / hashes)
    least = hashes * (threshold - DEVIATIONS * spread)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _cells(batches, "bucket"):
            bounds = np.append(starts, table.num_rows)
            at = 0
            while at < len(starts):
                # Whole cells of some thousand rows at a time.
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 4096, "right")) - 1)
                part = table.slice(bounds[at], bounds[to] - bounds[at])
                yield meeting(part, bounds[at:to] - bounds[at])
                at = to

    def meeting(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        low, high, member, own, grams = (
            table.column(c).to_numpy() for c in ("low", "high", "class", "block", "grams")
        )
        packed = b"".join(table.column("signature").to_pylist())
        signs = np.frombuffer(packed, "<u2").reshape(len(member), hashes)
        sizes = np.diff(np.append(starts, len(member)))
        ends = np.repeat(starts + sizes, sizes)
        labels, active, step = np.arange(len(member)), np.arange(len(member)), 0
        while True:
            step += 1
            active = active[active + step < ends[active]]
            if not len(active):
                break
            i, j = active, active + step
            # Those that hang together already need no comparison.
            fits = (
                (labels[i] != labels[j])
                & ((low[i] == high[i]) | (own[i] != own[j]))
                & (np.minimum(grams[i], grams[j]) >= threshold * np.maximum(grams[i], grams[j]) - 1e-9)
            )
            i, j = i[fits], j[fits]
            keep = (signs[i] == signs[j]).sum(axis=1) >= least
            if keep.any():
                labels = _unite(labels, i[keep], j[keep])
        further = np.flatnonzero(labels != np.arange(len(member)))
        a, b = member[labels[further]], member[further]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]
        )

    members = banded.join(shared, "bucket").join(signed, "class")
    return (
        _cut(members, "bucket", "members", block)
        .mapInArrow(meet, "a bigint, b bigint")
        .distinct()
    )


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, exactly: a square matrix, false on the diagonal."""
    sizes = np.array([len(s) for s in sets], np.int64)
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # An n-gram of one member only is in no intersection.
    often = np.bincount(number) > 1
    place = np.cumsum(often) - 1
    row, column = row[often[number]], place[number[often[number]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(often.sum()), _COLUMNS):
        part = slice(*np.searchsorted(column, [start, start + _COLUMNS]))
        used = np.zeros((len(sets), _COLUMNS), np.float32)
        used[row[part], column[part] - start] = 1
        shared += used @ used.T
    both = sizes[:, None] + sizes[None, :] - shared
    linked = shared >= threshold * both - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def verified(
    docs: DataFrame, classes: DataFrame, clusters: DataFrame, n: int, threshold: float,
    block: int = BLOCK,
) -> DataFrame:
    """Stored ``class, links, root``: for each cell in which a class has links their number, and
    the first class in the cell that it hangs together with.

    ``clusters`` is ``node, label``. Texts are fetched by a merge join, at every size, as it needs
    no table in memory.
    """

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngram_set(text.as_py(), n).view(np.int64) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("class"), batch.column("label"), batch.column("size"),
                    pa.array(sets, pa.list_(pa.int64())),
                ],
                ["class", "label", "size", "set"],
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _cells(batches, "label"):
            low, high, member, own = (
                table.column(c).to_numpy() for c in ("low", "high", "class", "block")
            )
            lists = table.column("set").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            for start, end in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                # Rows that repeat both id and text bring their text more than once.
                rows = start + np.unique(member[start:end], return_index=True)[1]
                if len(rows) < 2:
                    continue
                linked = _linked([lists[int(r)].values.to_numpy() for r in rows], threshold)
                if low[start] != high[start]:
                    linked &= own[rows][:, None] != own[rows][None, :]
                i, j = np.nonzero(linked)
                labels = _unite(np.arange(len(rows)), i, j)
                links = linked.sum(axis=1)
                has = links > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(member[rows][has]), pa.array(links[has].astype(np.int64)),
                        pa.array(member[rows][labels[has]]),
                    ],
                    ["class", "links", "root"],
                )

    sizes = clusters.groupBy("label").agg(F.count("*").alias("size"))
    wanted = materialize(
        clusters.join(sizes, "label")
        .join(classes, F.col("node") == F.col("class"))
        .select("class", "label", "size", F.col("digest").alias("_digest"), "first_doc"),
        "wanted",
    )
    # Digest and id together spread the copies of one text over the tasks.
    texts = docs.select("doc_id", "text", _digest(F.col("text")).alias("_own")).join(
        wanted.hint("merge"),
        (F.col("_own") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("first_doc")),
    )
    sets = texts.select("class", "label", "size", "text").mapInArrow(
        grams_of, "class bigint, label bigint, size bigint, set array<bigint>"
    )
    return materialize(
        _cut(sets, "label", "size", block).mapInArrow(verify, "class bigint, links bigint, root bigint"),
        "links",
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of stored edges ``a, b``: the smallest node of each
    connected component. Each round is stored; paths halve, so the rounds are few."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("a").alias("next"))
    )
    labels = materialize(
        both.groupBy("node").agg(F.least("node", F.min("next")).alias("label")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), "label"), "next")
        lower = (
            near.groupBy("node")
            .agg(F.min("label").alias("near"))
            .join(labels, "node")
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        )
        jumped = lower.join(
            labels.select(F.col("node").alias("near"), F.col("label").alias("far")), "near"
        )
        labels = materialize(
            jumped.select("node", F.least("near", "far").alias("label"), "old"), "labels"
        )
        if not labels.where("label < old").head(1):
            return labels.select("node", "label")
        labels = labels.drop("old")


def near_groups(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    recall: float = 0.9998,
    hashes: int = 192,
    block: int = BLOCK,
) -> DataFrame:
    """One stored row per distinct text: ``digest, first_doc, copies, grams, links, group_doc,
    group_digest``.

    ``links`` counts the other distinct texts at ``threshold`` or above, ``group_doc`` is the
    smallest ``doc_id`` in the connected component and ``group_digest`` the text it has.
    Texts without words link to nothing.
    """
    bands = choose_bands(threshold, recall, hashes)
    classes = text_classes(docs, n, bands.bands * bands.rows)
    clusters = components(materialize(candidate_edges(classes, bands, threshold, block), "edges"))
    linked = verified(docs, classes, clusters, n, threshold, block)
    degree = linked.groupBy("class").agg(F.sum("links").alias("links"))
    labels = components(
        linked.where("class != root").select(F.col("root").alias("a"), F.col("class").alias("b"))
    )
    # Null ids come last.
    order = F.struct(F.col("first_doc").isNull(), "first_doc", "digest")
    named = (
        classes.select("class", "digest", "first_doc", "copies", "grams")
        .join(degree, "class", "left")
        .join(labels.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("label", F.coalesce("label", "class"))
        .fillna(0, ["links"])
    )
    named = materialize(named.drop("class"), "named")
    first = named.groupBy("label").agg(F.min(order).alias("first"))
    return materialize(
        named.join(first, "label").select(
            "digest", "first_doc", "copies", "grams", "links",
            F.col("first.first_doc").alias("group_doc"),
            F.col("first.digest").alias("group_digest"),
        ),
        "groups",
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, **more) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, text_class, copies, n_grams``.

    ``class_id`` is the smallest ``doc_id`` of the group of near duplicates (null if the group
    has no id), ``text_class`` that of the exact copies, ``copies`` their number. Needs
    ``doc_id`` and ``text``; other columns are ignored. Null and empty texts are copies of each
    other and near nothing else; rows that repeat are copies; very long texts count whole; an
    empty table gives an empty result.
    """
    groups = near_groups(docs, threshold, n, **more)
    rows = docs.select("doc_id", _digest(F.col("text")).alias("digest"))
    return rows.join(groups, "digest").select(
        "doc_id",
        F.col("group_doc").alias("class_id"),
        F.col("links").alias("n_links"),
        F.col("first_doc").alias("text_class"),
        "copies",
        F.col("grams").alias("n_grams"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, **more) -> DataFrame:
    """The document with the smallest ``doc_id`` of each group, with all columns of ``docs``.

    Of rows that repeat both id and text one stays. Documents without words are no near
    duplicates of anything; of equal ones one stays.
    """
    columns = docs.columns
    own, digest, first = (free_name(columns, name) for name in ("_own", "_digest", "_first"))
    kept = (
        near_groups(docs, threshold, n, **more)
        .where("digest = group_digest")
        .select(F.col("digest").alias(digest), F.col("first_doc").alias(first))
    )
    return (
        docs.withColumn(own, _digest(F.col("text")))
        .join(
            kept,
            (F.col(own) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(first)),
            "left_semi",
        )
        .dropDuplicates([own, "doc_id"])
        .select(*columns)
    )
