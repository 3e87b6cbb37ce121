"""Quality rules by compression: text that compresses far better or worse than prose goes.

A text is compressed as a whole and in fixed chunks. The whole must lie within the band of its
length; of its chunks, at most a share may lie outside of theirs. Ahead of that stand plain rules
on words and repeats, whose counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.sources.scratch import materialize

#: (bytes from, least ratio, most ratio), compressed over raw size at level 3. Short texts hardly
#: compress, so they have no band; prose gets denser with length, and so do the limits. Classes of
#: too few texts to learn from have these.
BANDS = (
    (0, 0.0, 9.0),
    (128, 0.40, 1.00),
    (256, 0.36, 0.95),
    (512, 0.32, 0.90),
    (1 << 10, 0.30, 0.85),
    (1 << 11, 0.28, 0.80),
    (1 << 12, 0.26, 0.78),
    (1 << 13, 0.24, 0.76),
    (1 << 14, 0.22, 0.74),
    (1 << 15, 0.20, 0.72),
)
#: Bytes of a chunk; a shorter rest is part of the whole only.
CHUNK = 2048
#: Share of chunks that may lie outside of their band.
BAD_CHUNKS = 0.2
LEVEL = 3
WINDOW = 8
#: Learned limits lie so many spreads (median deviations, scaled to a normal curve's) around the
#: median, with a least spread, and need so many distinct texts or chunks of the class.
SPREADS = 4.5
LEAST_SPREAD = 0.006
LEAST_TEXTS = 50
_SYMBOLS = b"#*$%&|<>"

#: What one pass finds: the counts, and each chunk's ratio.
_MEASURES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
    " n_repeat_words bigint, base_failed boolean, size bigint, hash bigint, ratio double,"
    " chunks array<double>"
)


def repeat_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words, a power of two, that occur at least twice.

    Exact: the number of a window stands for the pair of its halves, and that of a word for the
    word, so equal numbers are equal words.
    """
    count = len(words) - window + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64)
    if len(numbers) == len(words):
        return 0
    width = 1
    while width < window:
        pairs = ids[:-width] * np.int64(len(words) + 1) + ids[width:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    again = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    lines = Counter(line for line in data.split(b"\n") if line.split())
    return sum(lines.values()) - len(lines)


def band(size: int) -> tuple[float, float]:
    """Least and most ratio for a text of ``size`` bytes."""
    found = BANDS[0]
    for limits in BANDS:
        if size >= limits[0]:
            found = limits
    return found[1], found[2]


def _ratio(packer: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(packer.compress(data)) / max(1, len(data))


def _measure(docs: DataFrame) -> DataFrame:
    """Counts and ratios of each document, before any limit."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode("utf-8")
                words = data.split()
                # Every byte of a word but those that continue a character.
                inside = b"".join(words)
                continued = np.count_nonzero((np.frombuffer(inside, np.uint8) & 0xC0) == 0x80)
                symbols = len(data) - len(data.translate(None, _SYMBOLS))
                repeats = repeat_words(words)
                failed = len(words) < 20 or 100 * repeats > 30 * len(words)
                chunks = [
                    _ratio(packer, data[end - CHUNK : end]) for end in range(CHUNK, len(data) + 1, CHUNK)
                ]
                rows.append((
                    len(words), len(inside) - int(continued), symbols, duplicate_lines(data),
                    repeats, failed, len(data), xxhash.xxh3_64_intdigest(data) - (1 << 63),
                    _ratio(packer, data), chunks,
                ))
            columns = list(zip(*rows, strict=True)) or [()] * 10
            types = [
                *[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                [field.split()[0] for field in _MEASURES.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(measure, _MEASURES)


def _class(size: Column) -> Column:
    """Number of the length class."""
    found = F.lit(0)
    for i, (least, _, _) in enumerate(BANDS):
        found = F.when(size >= least, i).otherwise(found)
    return found


def learn_limits(measured: DataFrame) -> dict[str | int, tuple[float, float]]:
    """Least and most ratio by class number, and of chunks by ``"chunk"``, from all distinct texts
    of ``measured`` that pass the base rules: the median and spread, so that neither copies nor
    junk widen them. Texts under 128 bytes keep their band."""
    once = (
        measured.where("not base_failed and size >= 128")
        .groupBy("hash", "size")
        .agg(F.first("ratio").alias("ratio"), F.first("chunks").alias("chunks"))
    )
    parts = F.concat(
        F.array(F.struct(_class(F.col("size")).alias("class"), F.col("ratio").alias("ratio"))),
        F.transform("chunks", lambda r: F.struct(F.lit(-1).alias("class"), r.alias("ratio"))),
    )
    ratios = materialize(once.select(F.inline(parts)), "ratios")

    def medians(table, column):
        found = table.groupBy("class").agg(
            F.percentile_approx(column, 0.5, 10_000).alias("mid"), F.count("*").alias("n")
        )
        return {r["class"]: (r["mid"], r["n"]) for r in found.collect()}

    centre = medians(ratios, "ratio")
    if not centre:
        return {}
    middle = F.element_at(F.create_map(*(F.lit(x) for k, (m, _) in centre.items() for x in (k, m))), F.col("class"))
    spread = medians(ratios.withColumn("off", F.abs(F.col("ratio") - middle)), "off")
    limits = {}
    for k, (mid, n) in centre.items():
        if n >= LEAST_TEXTS:
            wide = SPREADS * max(LEAST_SPREAD, 1.4826 * spread[k][0])
            limits["chunk" if k < 0 else k] = (mid - wide, mid + wide)
    return limits


def compression_rules(docs: DataFrame, learn: bool = False) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept`` and what decided on it.

    Needs ``doc_id`` and ``text``; other columns are ignored. Words lie between ASCII white
    space. A null or empty text has no words and fails. Rows that repeat are judged each; very
    long texts are read whole; an empty table gives an empty result. ``ratio`` is that of the
    whole text; documents that fail the base rules are measured like the others. With ``learn``
    the limits are those of ``learn_limits`` where there are enough texts, else ``BANDS``.
    """
    measured = _measure(docs)
    limits: dict = {}
    if learn:
        measured = materialize(measured, "compression")
        limits = learn_limits(measured)
    size, ratio = F.col("size"), F.col("ratio")
    inside = F.lit(True)
    for i, (least, low, high) in enumerate(BANDS):
        low, high = limits.get(i, (low, high))
        inside = F.when(size >= least, ratio.between(low, high)).otherwise(inside)
    low, high = limits.get("chunk", band(CHUNK))
    bad = F.size(F.filter("chunks", lambda r: ~r.between(low, high))).cast("bigint")
    chunks = F.size("chunks").cast("bigint")
    kept = ~F.col("base_failed") & inside & (bad <= BAD_CHUNKS * chunks)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "ratio", chunks.alias("n_chunks"), bad.alias("n_bad_chunks"),
    )
