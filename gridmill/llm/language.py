"""Language identification with bit-sliced Bloom filters over character n-grams.

Each language has a Bloom filter of the n-grams that make up a least share of its training text.
The filters lie side by side: one row of bits per position, one bit per language. The rows of an
n-gram's positions, joined by "and", give all languages that contain it. For each language the
n-grams of a text that it contains are counted, less those expected by false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.sources.scratch import materialize

#: Characters of an n-gram; the ends of words count as one.
NGRAM = 4
#: Least share of a language's n-grams; so a language has 50,000 n-grams at most.
LEAST_SHARE = 2e-5
#: Positions of an n-gram, and bits of a filter for each n-gram in it.
POSITIONS = 3
BITS = 10
_CHUNK = 1 << 20
_SPACE = 32


class _Letters:
    """Which code points are letters, looked up once each."""

    def __init__(self):
        self.known = np.zeros(0x110000, np.int8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.known[codes]
        if (kinds == 0).any():
            for code in np.unique(codes[kinds == 0]):
                self.known[code] = 2 if chr(code).isalpha() else 1
            kinds = self.known[codes]
        return kinds == 2


def _grams(texts: list[str], letters: _Letters) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of ``texts``, and how many letters and n-grams each text has.

    Runs of other characters are one space. An n-gram lies within a word and the space before and
    after it, so a word of two letters has one n-gram and one of one letter has none.
    """
    codes = np.frombuffer(" \n ".join(["", *texts, ""]).lower().encode("utf-32-le", "replace"), "<u4")
    # A text may hold line ends itself: texts are told apart by length.
    sizes = np.array([len(t.lower()) for t in texts], np.int64) + 3
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = codes[2 : 2 + len(owner)]
    is_letter = letters(codes)
    counted = np.bincount(owner[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    text = np.where(is_letter, codes, _SPACE)[keep].astype(np.uint64)
    owner = owner[keep]
    if len(text) < NGRAM:
        return np.zeros(0, np.uint64), owner[:0], counted
    width = len(text) - NGRAM + 1
    hashes = np.zeros(width, np.uint64)
    whole = np.ones(width, bool)
    for k in range(NGRAM):
        part = text[k : k + width]
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + part
        hashes ^= hashes >> np.uint64(32)
        if 0 < k < NGRAM - 1:
            whole &= part != _SPACE
    return _mixed(hashes[whole]), owner[NGRAM - 1 :][whole], counted


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _groups(texts: list[str], most: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about ``most`` characters."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


class LanguageFilters(NamedTuple):
    """``slices``: for each 64 languages, the bits of all positions. ``false_rates``: how often a
    language seems to contain an n-gram that it doesn't. Languages stand by their share in the
    training text, most first, which settles ties."""

    languages: list[str]
    slices: np.ndarray
    false_rates: np.ndarray

    def contains(self, grams: np.ndarray) -> np.ndarray:
        """For each slice the languages that contain each n-gram, as bits."""
        size = np.uint64(self.slices.shape[1] - 1)
        found = None
        for k in range(POSITIONS):
            at = position(grams, k) & size
            found = self.slices[:, at] if found is None else found & self.slices[:, at]
        return found


def position(grams: np.ndarray, k: int) -> np.ndarray:
    return _mixed(grams + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) >> np.uint64(20)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is never held out, as it has no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngram_counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows ``lang, text``: counted in each task, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters()
        for batch in batches:
            of_lang: dict[str, list[str]] = {}
            for lang, text in zip(
                batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                of_lang.setdefault(lang, []).append(text)
            for lang, texts in of_lang.items():
                parts = []
                for start, end in _groups(texts):
                    parts.append(np.unique(_grams(texts[start:end], letters)[0], return_counts=True))
                grams = np.concatenate([g for g, _ in parts])
                distinct, place = np.unique(grams, return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([n for _, n in parts]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(distinct), pa.string()),
                        pa.array(distinct.view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    ["lang", "gram", "n"],
                )

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, least_share: float = LEAST_SHARE) -> LanguageFilters:
    """Filters from all rows of ``docs`` that have a text and a language and are not held out.

    A language has ``1 / least_share`` n-grams at most, so the filters' size is bounded by the
    number of languages alone.
    """
    rows = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    counts = materialize(ngram_counts(rows), "ngrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    ranked = sorted(totals.collect(), key=lambda r: (-r["total"], r["lang"]))
    languages = [r["lang"] for r in ranked]
    slices = np.zeros((max(1, -(-len(languages) // 64)), 1), np.uint64)
    if not languages:
        return LanguageFilters(languages, slices, np.zeros(0))
    chosen = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= least_share * F.col("total"))
    number = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    sets = chosen.select(number[F.col("lang")].alias("lang"), "gram").toPandas()
    of_lang = sets["lang"].to_numpy()
    grams = sets["gram"].to_numpy(np.int64).view(np.uint64)
    sizes = np.bincount(of_lang, minlength=len(languages))
    rows_of_bits = 1 << int(np.ceil(np.log2(max(64, BITS * sizes.max()))))
    slices = np.zeros((len(slices), rows_of_bits), np.uint64)
    for i in range(len(languages)):
        mine = grams[of_lang == i]
        for k in range(POSITIONS):
            at = position(mine, k) & np.uint64(rows_of_bits - 1)
            slices[i // 64, np.unique(at)] |= np.uint64(1) << np.uint64(i % 64)
    fill = [
        float(((slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
        for i in range(len(languages))
    ]
    return LanguageFilters(languages, slices, np.array(fill) ** POSITIONS)


def identify_languages(docs: DataFrame, filters: LanguageFilters | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, n_letters``.

    Needs ``doc_id`` and ``text``, and ``lang`` to learn from; other columns are never read.
    ``lang_pred`` is ``und`` for null texts and texts without a letter. A text whose n-grams no
    language contains gets the most frequent language with score 0. ``score`` is the share of the
    winner's corrected count in those of all languages. Nothing to learn from makes all ``und``;
    rows that repeat are judged each; an empty table gives an empty result.
    """
    filters = filters or fit_languages(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(filters))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, letters = LanguageFilters(*shared.value), _Letters()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, share, counted = [], [], []
            for start, end in _groups(texts):
                part = texts[start:end]
                grams, owner, n_letters = _grams(part, letters)
                total = np.bincount(owner, minlength=len(part))
                hits = np.zeros((len(fitted.languages), len(part)))
                found = fitted.contains(grams) if len(fitted.languages) else None
                for i, rate in enumerate(fitted.false_rates):
                    has = (found[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                    hits[i] = np.bincount(owner, weights=has, minlength=len(part))
                    hits[i] = np.maximum(0, (hits[i] - rate * total) / max(1e-9, 1 - rate))
                counted.extend(n_letters.tolist())
                if len(fitted.languages):
                    winner = hits.argmax(axis=0)
                    best.extend(winner.tolist())
                    top = hits[winner, np.arange(len(part))]
                    share.extend((top / np.maximum(hits.sum(axis=0), 1e-9)).tolist())
                else:
                    best.extend([-1] * len(part))
                    share.extend([0.0] * len(part))
            found = [
                fitted.languages[i] if n and i >= 0 else "und" for i, n in zip(best, counted, strict=True)
            ]
            scores = [s if n else 0.0 for s, n in zip(share, counted, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"),
                    pa.array(found, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(counted, pa.int64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "n_letters"],
            )

    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        identify, "doc_id bigint, held_out boolean, lang_pred string, score double, n_letters bigint"
    )
