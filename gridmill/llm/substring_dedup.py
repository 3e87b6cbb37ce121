"""Removal of passages that occur elsewhere, by a compressed FM-index per shard.

A window is a number of consecutive words. Shards are made by content, so that a document meets
only indexes in which its windows can occur: each window is sent by its anchor, the n-gram in it
with the smallest hash, and windows that follow each other and share their anchor travel as one
passage. Anchors that occur once are left out, as no window of theirs can occur twice. In a shard
the distinct passages are indexed, then streamed against the index: a backward search gives their
matching statistics, and stretches of at least a window are reported.

An anchor that very many different passages share would fill a shard by itself. Its passages are
cut anew with hot anchors, and n-grams that as many of these passages have, last in the order: a
window of a hot passage and of what surrounds it goes by its rarer n-grams, and the windows that
lie in hot text alone are few different ones. What a window is sent by depends on its words only,
so equal windows always meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.fm_index import FmIndex, repeated_windows
from gridmill.llm.names import free_name
from gridmill.sources.scratch import materialize

#: Words of a window.
WINDOW = 35
#: Words of an anchor.
ANCHOR = 12
#: Words that are indexed together, about.
SHARD_WORDS = 250_000
#: Different passages of an anchor from which it is hot; more where that makes over a million hot ones.
HOT_PASSAGES = 4096
HOT_ANCHORS = 1_000_000
#: Rounds of cutting hot passages anew.
ROUNDS = 6
#: Bytes of passages in which a task looks for equal ones before it passes them on.
HELD_BYTES = 64_000_000
#: Words whose hashes a task holds.
HELD_WORDS = 1_000_000

_PASSAGE = "digest binary, anchor bigint, start bigint, windows int, words binary, times int"
_SPAN = "digest binary, start bigint, stop bigint"
_HOT = np.uint64(1 << 63)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space."""
    return (text or "").encode("utf-8").split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def gram_hashes(words: list[bytes], known: _Hashes, n: int) -> np.ndarray:
    """A 63-bit hash of each ``n`` consecutive words."""
    of_word = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    count = len(words) - n + 1
    grams = np.full(count, n, np.uint64)
    for k in range(n):
        grams = (grams ^ of_word[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    return (grams ^ (grams >> np.uint64(32))) >> np.uint64(1)


def anchor_places(order: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive values the place of the smallest, the first of equal ones."""
    value, place, covered = order, np.arange(len(order)), 1
    while covered < width:
        step = min(covered, width - covered)
        later = value[step:] < value[: len(value) - step]
        place = np.where(later, place[step:], place[: len(place) - step])
        value = np.where(later, value[step:], value[: len(value) - step])
        covered += step
    return place


def passages(
    words: list[bytes], known: _Hashes, window: int, anchor: int, hot: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, first window, windows`` of each run of windows with one anchor."""
    grams = gram_hashes(words, known, anchor)
    order = grams
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        order = np.where(hot[at] == grams, grams | _HOT, grams)
    place = anchor_places(order, window - anchor + 1)
    starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    windows = np.diff(np.append(starts, len(place)))
    return grams[place[starts]], starts, windows


class _Cutter:
    """Rows of passages. Equal passages of a task become one row that says so; the spans of the
    others are passed on at once, as rows without words."""

    def __init__(self, window: int):
        self.window = window
        self.held: dict[bytes, list] = {}
        self.spans: list[tuple] = []
        self.bytes = 0

    def add(self, digest: bytes, anchor: int, start: int, windows: int, words: bytes, times: int) -> None:
        row = self.held.get(words)
        if row is None:
            self.held[words] = [digest, anchor, start, windows, words, times]
            self.bytes += len(words) + 150
        else:
            row[5] = 2
            self.spans.append((digest, None, start, windows, None, None))
            self.bytes += 100

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = [*self.held.values(), *self.spans]
        for at in range(0, len(rows), 20_000):
            columns = list(zip(*rows[at : at + 20_000], strict=True))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["digest", "anchor", "start", "windows", "words", "times"],
            )
        self.__init__(self.window)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_classes(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Stored ``class, digest, first_doc, copies, size, anchors``: one row per distinct text."""
    none = np.zeros(0, np.uint64)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            sizes, found = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                sizes.append(len(words))
                own = none
                if len(words) >= window:
                    own = passages(words, known, window, anchor, none)[0]
                found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "size", "anchors"],
            )

    schema = "doc_id bigint, digest binary, size bigint, anchors array<bigint>"
    rows = docs.select("doc_id", "text", _digest(F.col("text")).alias("digest"))
    return materialize(
        rows.mapInArrow(anchors, schema)
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("first_doc"),
            F.count("*").alias("copies"),
            F.first("size").alias("size"),
            F.first("anchors").alias("anchors"),
        )
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )


def shared_passages(docs: DataFrame, classes: DataFrame, window: int, anchor: int) -> DataFrame:
    """Stored passages whose anchor occurs at least twice, and spans of some that repeat."""
    occurrences = classes.where(F.size("anchors") > 0).select("class", F.explode("anchors").alias("anchor"))
    shared = materialize(
        occurrences.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"),
        "shared_anchors",
    )
    lists = occurrences.distinct().join(shared, "anchor").groupBy("class").agg(
        F.collect_list("anchor").alias("shared")
    )
    wanted = materialize(
        classes.join(lists, "class").select(
            F.col("digest").alias("_digest"), "first_doc", "shared",
            F.least("copies", F.lit(2)).cast("int").alias("times"),
        ),
        "wanted",
    )
    # Digest and id together spread the copies of one text over the tasks.
    texts = docs.select("doc_id", "text", _digest(F.col("text")).alias("digest")).join(
        wanted.hint("merge"),
        (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("first_doc")),
    )
    none = np.zeros(0, np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = _Hashes(), _Cutter(window)
        for batch in batches:
            columns = (batch.column(c) for c in ("digest", "text", "shared", "times"))
            for digest, text, wanted_here, times in zip(*columns, strict=True):
                digest, times, words = digest.as_py(), times.as_py(), words_of(text.as_py())
                wanted_here = wanted_here.values.to_numpy().view(np.uint64)
                found, starts, windows = passages(words, known, window, anchor, none)
                keep = np.isin(found, wanted_here)
                rows = zip(found[keep].view(np.int64).tolist(), starts[keep].tolist(), windows[keep].tolist())
                for own, start, count in rows:
                    out.add(digest, own, start, count, b" ".join(words[start : start + count + window - 1]), times)
                if out.bytes > HELD_BYTES:
                    yield from out.flush()
        yield from out.flush()

    return materialize(texts.select("digest", "text", "shared", "times").mapInArrow(cut, _PASSAGE), "passages")


def _frequent_grams(found: DataFrame, anchor: int, least: int) -> np.ndarray:
    """Hashes of the n-grams that over ``least`` passages hold, ``HOT_ANCHORS`` at most or so."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            grams = [np.unique(gram_hashes(w.split(b" "), known, anchor)) for w in batch.column(0).to_pylist()]
            grams, rows = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(rows)], ["gram", "rows"])

    counted = materialize(
        found.select("words").mapInArrow(count, "gram bigint, rows bigint").groupBy("gram").agg(F.sum("rows").alias("rows")),
        "grams",
    )
    total = counted.agg(F.sum("rows")).first()[0] or 0
    frequent = counted.where(F.col("rows") > max(least, total // HOT_ANCHORS)).select("gram")
    return np.array([r[0] for r in frequent.collect()], np.int64).view(np.uint64)


def spread_hot(found: DataFrame, window: int, anchor: int, hot_passages: int) -> list[DataFrame]:
    """The passages with those of hot anchors cut anew, in several tables. Hot anchors are at
    most ``HOT_ANCHORS`` by their counts, so they go along with the tasks."""
    settled, hot = [], np.zeros(0, np.uint64)
    for _ in range(ROUNDS):
        distinct = found.where("words is not null").select("anchor", F.xxhash64("words").alias("own")).distinct()
        sizes = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("passages")), "anchor_sizes")
        total = sizes.agg(F.sum("passages")).first()[0] or 0
        least = max(hot_passages, total // HOT_ANCHORS)
        large = sizes.where(F.col("passages") > least).select("anchor")
        new = np.array([r[0] for r in large.collect()], np.int64).view(np.uint64)
        if not len(np.setdiff1d(new, hot)):
            break
        chosen = F.broadcast(large)
        settled.append(found.join(chosen, "anchor", "left_anti").select(found.columns))
        again = found.join(chosen, "anchor", "left_semi").select(found.columns)
        # Other n-grams of the same hot text would be the next hot anchors.
        hot = np.union1d(hot, np.union1d(new, _frequent_grams(again, anchor, least)))
        found = materialize(again.mapInArrow(_cut_anew(window, anchor, hot), _PASSAGE), "hot_passages")
    return [*settled, found]


def _cut_anew(window: int, anchor: int, hot: np.ndarray):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = _Hashes(), _Cutter(window)
        for batch in batches:
            for row in batch.to_pylist():
                words = row["words"].split(b" ")
                anchors, starts, windows = passages(words, known, window, anchor, hot)
                rows = zip(anchors.view(np.int64).tolist(), starts.tolist(), windows.tolist())
                for own, start, count in rows:
                    part = b" ".join(words[start : start + count + window - 1])
                    out.add(row["digest"], own, row["start"] + start, count, part, row["times"])
            if out.bytes > HELD_BYTES:
                yield from out.flush()
        yield from out.flush()

    return cut


def _shards(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.Table]:
    """Whole anchors of about ``most`` words. The input is sorted by anchor."""
    held: list[pa.RecordBatch] = []
    words = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        words += int(batch.column("windows").to_numpy().sum()) + batch.num_rows * (window - 1)
        if words <= most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchors = table.column("anchor").to_numpy()
        sizes = np.cumsum(table.column("windows").to_numpy() + window - 1)
        opens = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        at = 0
        while True:
            # The last anchor may go on in the next batch.
            done = sizes[at - 1] if at else 0
            ready = opens[(opens > at) & (sizes[opens - 1] - done >= most)]
            if not len(ready):
                break
            yield table.slice(at, ready[0] - at)
            at = int(ready[0])
        rest = table.slice(at).combine_chunks()
        held, words = rest.to_batches(), int(sizes[-1] - (sizes[at - 1] if at else 0))
    if held:
        yield pa.Table.from_batches(held)


def _search(table: pa.Table, window: int) -> list[tuple]:
    """``digest, start, stop`` of the stretches in one shard that occur twice."""
    digests, starts = table.column("digest").to_pylist(), table.column("start").to_pylist()
    anchors, counts = table.column("anchor").to_pylist(), table.column("windows").to_pylist()
    rows_of: dict[bytes, list[int]] = {}
    times: dict[bytes, int] = {}
    for row, (words, of_row) in enumerate(
        zip(table.column("words").to_pylist(), table.column("times").to_pylist(), strict=True)
    ):
        rows_of.setdefault(words, []).append(row)
        times[words] = times.get(words, 0) + of_row
    spans = [
        (digests[row], starts[row], starts[row] + counts[row] + window - 1)
        for words, rows in rows_of.items() if times[words] > 1 for row in rows
    ]
    once = {anchors[rows[0]] for words, rows in rows_of.items() if times[words] == 1}
    indexed = [words for words, rows in rows_of.items() if anchors[rows[0]] in once]
    if not indexed:
        return spans
    numbers: dict[bytes, int] = {}
    parts = []
    for words in indexed:
        parts += [numbers.setdefault(word, len(numbers) + 1) for word in words.split(b" ")]
        parts.append(0)
    text = np.array(parts, np.int64)
    sizes = np.array([counts[rows_of[words][0]] + window - 1 for words in indexed], np.int64)
    places = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    single = np.array([times[words] == 1 for words in indexed])
    found = repeated_windows(FmIndex(text), text, places[single], sizes[single], window)
    opens = np.flatnonzero(found & ~np.concatenate([[False], found[:-1]]))
    closes = np.flatnonzero(found & ~np.concatenate([found[1:], [False]]))
    for first, last in zip(opens.tolist(), closes.tolist(), strict=True):
        passage = int(np.searchsorted(places, first, "right")) - 1
        row = rows_of[indexed[passage]][0]
        start = starts[row] + first - int(places[passage])
        spans.append((digests[row], start, start + last - first + window))
    return spans


def repeated_spans(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard_words: int = SHARD_WORDS,
    hot_passages: int = HOT_PASSAGES,
) -> DataFrame:
    """Stored ``digest, spans``: for each distinct text (MD5 of its UTF-8) that has some, the
    places of words, first and behind the last, that lie in a window that starts anywhere else too.
    Spans are sorted and do not touch."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor is part of a window")
    classes = text_classes(docs, window, anchor)
    found = shared_passages(docs, classes, window, anchor)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches, window, shard_words):
            spans = _search(table, window)
            columns = list(zip(*spans, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)],
                ["digest", "start", "stop"],
            )

    tables = spread_hot(found, window, anchor, hot_passages)
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    searched = (
        every.where("words is not null")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(search, _SPAN)
    )
    known = every.where("words is null").select(
        "digest", "start", (F.col("start") + F.col("windows") + (window - 1)).alias("stop")
    )
    # A text that is there twice repeats as a whole.
    copied = classes.where((F.col("copies") > 1) & (F.col("size") >= window)).select(
        "digest", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("stop")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for spans in batch.column("spans"):
                out: list[list[int]] = []
                for span in spans.as_py():
                    if out and span["start"] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], span["stop"])
                    else:
                        out.append([span["start"], span["stop"]])
                merged.append([{"start": a, "stop": b} for a, b in out])
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(merged, batch.column("spans").type)], ["digest", "spans"]
            )

    lists = (
        searched.unionByName(known)
        .unionByName(copied)
        .groupBy("digest")
        .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    )
    return materialize(lists.mapInArrow(merge, lists.schema), "repeated_spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, **more) -> DataFrame:
    """One row per document: ``doc_id, n_words, removed, kept_text``. ``removed`` has the spans of
    words (first, behind the last) that lie in a window of ``window`` words that starts
    anywhere else too, in another document or the same; ``kept_text`` has the other words, joined by
    one blank. All windows are judged on the texts as they come.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null text is empty; texts of
    fewer words than a window lose nothing; very long texts count whole. Texts of rows that repeat
    are there twice, so all of their words go if they fill a window. There are no ties: words are
    compared byte for byte. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, window, **more)
    rows = docs.select("doc_id", "text", _digest(F.col("text")).alias("digest"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept = [], []
            for text, spans_here in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = words_of(text.as_py())
                sizes.append(len(words))
                for span in reversed(spans_here.as_py() or []):
                    del words[span["start"] : span["stop"]]
                kept.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("spans"),
                    pa.array(kept, pa.string()),
                ],
                ["doc_id", "n_words", "removed", "kept_text"],
            )

    joined = rows.join(spans.hint("merge"), "digest", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        cut, "doc_id bigint, n_words bigint, removed array<struct<start:bigint,stop:bigint>>, kept_text string"
    )


def drop_repeats(docs: DataFrame, window: int = WINDOW, **more) -> DataFrame:
    """``docs`` with all its columns, each text without the passages that ``remove_repeats``
    removes. Texts that lose nothing stay as they are; null texts stay null."""
    spans = repeated_spans(docs, window, **more)
    own, removed = free_name(docs.columns, "_digest"), free_name(docs.columns, "_spans")
    joined = docs.withColumn(own, _digest(F.col("text"))).join(
        spans.select(F.col("digest").alias(own), F.col("spans").alias(removed)).hint("merge"), own, "left"
    )
    at = joined.schema.names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans_here in zip(batch.column(at), batch.column(removed), strict=True):
                text = text.as_py()
                if spans_here.is_valid:
                    words = words_of(text)
                    for span in reversed(spans_here.as_py()):
                        del words[span["start"] : span["stop"]]
                    text = b" ".join(words).decode("utf-8")
                texts.append(text)
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return joined.mapInArrow(cut, joined.schema).select(*docs.columns)
