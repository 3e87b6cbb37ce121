"""Toxic passages by maximum-scoring segments.

Each word has a score: how much likelier it is in toxic documents, in log-odds under Dirichlet
priors, less a drift that makes ordinary text negative. A word's prior comes from its prefixes,
from short to long, so rare and unseen forms take after their stem. A linear scan (Ruzzo and
Tompa) finds all segments of a text whose score can't be raised by making them longer or shorter.
In clean text the number of segments above x falls as ``K * words * exp(-rate * x)``; K and rate
are fitted to clean labelled documents, and what a segment has above that gives its evidence. A
logistic curve turns the sum of a document's evidence into a probability.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm import bounded
from gridmill.llm.names import free_name
from gridmill.sources.scratch import materialize

#: Labelled documents that the model is fitted on, at most: those with the smallest hashes.
TRAIN_ROWS = 200_000
#: Weight of the prior, in documents.
PRIOR = 6.0
#: Taken from each word's log-odds.
DRIFT = 2.0
PREFIXES = (3, 4, 5, 6)
#: A passage is reported if so many as good are expected in all of its text, or fewer.
EXPECTED = 0.05

_WORD = re.compile(r"[^\W_]+")
_CACHE = 300_000


class Segment(NamedTuple):
    start: int
    end: int
    score: float


def maximal_segments(scores: np.ndarray) -> list[Segment]:
    """All maximal-scoring segments of ``scores``, in order; ends are exclusive. Linear time."""
    positive = scores > 0
    if not positive.any():
        return []
    turns = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate([[0], turns])
    ends = np.concatenate([turns, [len(scores)]])
    sums = np.add.reduceat(scores, starts)
    total, found, lower = 0.0, [], []
    # found: (start, end, total before, total after); lower: the nearest earlier one whose
    # total before is less.
    for start, end, add in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        before, total = total, total + add
        if add <= 0:
            continue
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= before:
                at = lower[at]
            if at < 0 or found[at][3] >= total:
                found.append((start, end, before, total))
                lower.append(at)
                break
            start, before = found[at][0], found[at][2]
            del found[at:], lower[at:]
    return [Segment(s, e, after - before) for s, e, before, after in found]


def _hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key)


class Keys:
    """Scores by the hash of their key, 16 bytes each, so a model may have millions."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.scores = array("Q"), array("d")
        self.hashes.frombytes(hashes[order].astype(np.uint64).tobytes())
        self.scores.frombytes(scores[order].astype(np.float64).tobytes())

    def __len__(self) -> int:
        return len(self.hashes)

    def get(self, key: str) -> float | None:
        code = _hash(key)
        at = bisect_left(self.hashes, code)
        return self.scores[at] if at < len(self.hashes) and self.hashes[at] == code else None


_NO_KEYS = Keys(np.array([], np.uint64), np.array([]))


class ToxicityModel(NamedTuple):
    """``keys``: score of words and, with a star, of prefixes. ``base``: of any other word."""

    keys: Keys
    base: float
    k: float
    rate: float
    weights: tuple[float, float]

    def evidence(self, words: int, segments: list[Segment]) -> list[float]:
        """What each segment has above what clean text of this length would show, in nats."""
        limit = math.log(max(self.k * words, 1e-9))
        return [self.rate * s.score - limit for s in segments]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.weights[0] + self.weights[1] * evidence))))


class _Scores(dict):
    """Word scores; a word that isn't known takes that of its longest known prefix."""

    def __init__(self, keys: Keys, base: float):
        super().__init__()
        self.keys_, self.base = keys, base

    def __missing__(self, word: str) -> float:
        score = self.keys_.get(word)
        for length in reversed(PREFIXES):
            if score is not None:
                break
            if len(word) >= length:
                score = self.keys_.get(word[:length] + "*")
        if len(self) > _CACHE:
            self.clear()
        self[word] = score = self.base if score is None else score
        return score


def _segments(scores: _Scores, text: str | None) -> tuple[int, list[Segment]]:
    words = _WORD.findall((text or "").lower())
    return len(words), maximal_segments(np.array([scores[w] for w in words], float))


def _fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 (held out) for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def is_held_out(doc_id: Column) -> Column:
    return _fold(doc_id) == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, toxic, fold`` of at most ``most`` labelled documents that are not held out, one
    for each text. The sample of labels is bounded, so it may be broadcast and the texts stay
    where they are read."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sample = materialize(bounded.sample(known, F.xxhash64("doc_id"), most), "labels")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = texts.join(F.broadcast(sample), "doc_id").select(
        "doc_id", "toxic", F.xxhash64("text").alias("hash")
    )
    chosen = materialize(
        hashed.groupBy("hash").agg(F.min(F.struct("doc_id", "toxic")).alias("first")).select("first.*"),
        "train_ids",
    )
    return texts.join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", _fold(F.col("doc_id")).alias("fold")
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, toxic, clean``: documents of each kind that have the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for text, toxic in zip(
                batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True
            ):
                found[toxic].update(set(_WORD.findall(text.lower())))
            words = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.string()),
                    pa.array([found[1][w] for w in words], pa.int64()),
                    pa.array([found[0][w] for w in words], pa.int64()),
                ],
                ["word", "toxic", "clean"],
            )

    counted = rows.select("text", "toxic").mapInArrow(count, "word string, toxic bigint, clean bigint")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def word_scores(counts: DataFrame) -> tuple[Keys, float]:
    """Score of each key that differs from what its prefix says, and that of all other words."""
    toxic, clean = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        return _NO_KEYS, -DRIFT
    base = toxic / (toxic + clean)
    origin = math.log(base / (1 - base)) + DRIFT
    # A word counts for itself and its prefixes.
    keys = [F.struct(F.lit(0).alias("level"), F.col("word").alias("key"))] + [
        F.when(
            F.length("word") >= n,
            F.struct(F.lit(n).alias("level"), F.concat(F.substring("word", 1, n), F.lit("*")).alias("key")),
        )
        for n in PREFIXES
    ]
    table = (
        counts.withColumn("k", F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())))
        .groupBy("k.level", "k.key")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") + F.col("clean") > 1)
    )
    table = materialize(table, "keys")
    rate = (F.col("toxic") + PRIOR * F.col("prior")) / (F.col("toxic") + F.col("clean") + PRIOR)
    known = table.where(f"level = {PREFIXES[0]}").withColumn("prior", F.lit(base)).withColumn("rate", rate)
    for level in [*PREFIXES[1:], 0]:
        # The longest prefix above: of a word as long as it allows, if that is known.
        shorter = [n for n in PREFIXES if not level or n < level]
        cases = " ".join(f"when length(key) >= {n} then {n}" for n in reversed(shorter))
        parent = F.expr(f"concat(substring(key, 1, case {cases} else 0 end), '*')")
        known = known.unionByName(
            table.where(f"level = {level}")
            .withColumn("parent", parent)
            .join(
                known.select(
                    F.col("key").alias("parent"),
                    F.col("toxic").alias("toxic_above"),
                    (F.col("toxic") + F.col("clean")).alias("all_above"),
                    F.col("prior").alias("above"),
                ),
                "parent",
                "left",
            )
            # What the other words of the prefix say; the word's own documents count once.
            .withColumn(
                "prior",
                F.coalesce(
                    (F.col("toxic_above") - F.col("toxic") + PRIOR * F.col("above"))
                    / (F.col("all_above") - F.col("toxic") - F.col("clean") + PRIOR),
                    F.lit(base),
                ),
            )
            .drop("toxic_above", "all_above", "above", "parent")
            .withColumn("rate", rate)
        )
    score = F.log(F.col("rate") / (1 - F.col("rate"))) - origin
    before = F.log(F.col("prior") / (1 - F.col("prior"))) - origin
    rated = known.select("key", score.alias("score"), F.abs(score - before).alias("news")).where(
        "news > 0.25"
    )

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([_hash(key) for key in batch.column("key").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes.view(np.int64)), batch.column("score")], ["code", "score"]
            )

    # All keys that the bounded sample of labelled documents has.
    found = rated.select("key", "score").mapInArrow(compact, "code bigint, score double").toArrow()
    codes, scores = (found.column(name).to_numpy() for name in ("code", "score"))
    return Keys(codes.view(np.uint64), scores), -DRIFT


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on labelled documents that are not held out: words on folds 2 to 4, the rest on 1.

    ``docs`` has ``doc_id, text``, ``labels`` has ``doc_id, toxic``. Without toxic or without
    clean documents the model finds nothing toxic.
    """
    rows = training_rows(docs, labels, train_rows)
    scores, base = word_scores(materialize(word_counts(rows.where("fold > 1")), "words"))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((scores, base))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(*shared.value)
        for batch in batches:
            found = [_segments(known, text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic").cast(pa.int32()),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([[s.score for s in x] for _, x in found], pa.list_(pa.float64())),
                ],
                ["toxic", "words", "scores"],
            )

    # A part of the bounded sample of labelled rows.
    sample = (
        rows.where("fold = 1").select("text", "toxic")
        .mapInArrow(scan, "toxic int, words bigint, scores array<double>")
        .toArrow()
    )
    shared.unpersist()
    found = [x.values.to_numpy() for x in sample.column("scores")]
    return _calibrate(
        scores, base,
        list(zip(sample.column("toxic").to_pylist(), sample.column("words").to_pylist(), found, strict=True)),
    )


def _calibrate(scores, base, sample) -> ToxicityModel:
    clean = [(words, found) for toxic, words, found in sample if not toxic]
    tail = np.sort(np.concatenate([[0.0], *(found for _, found in clean)]))
    if not len(scores) or len(clean) == len(sample):
        return ToxicityModel(_NO_KEYS, base, 1.0, 1.0, (-5.0, 0.0))
    # Peaks over a threshold: the upper tenth falls off exponentially.
    edge = tail[int(0.9 * len(tail))]
    over = tail[tail > edge]
    # One exceedance of mean size stands for what a small sample hasn't shown.
    rate = (len(over) + 1) / (float((over - edge).sum()) + 1.0)
    k = max(len(over), 1) * math.exp(rate * edge) / max(1, sum(words for words, _ in clean))
    model = ToxicityModel(scores, base, k, rate, (0.0, 0.0))
    x = np.array([
        np.maximum(0.0, rate * found - math.log(max(k * words, 1e-9))).sum()
        for _, words, found in sample
    ])
    y = np.array([toxic for toxic, _, _ in sample], float)
    x = np.minimum(x, 50.0)
    design = np.column_stack([np.ones(len(x)), x])
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ weights))
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, design.T @ (y - p) - 1e-3 * weights)
        weights += np.clip(step, -2, 2)
    return model._replace(weights=(float(weights[0]), float(max(0.0, weights[1]))))


_RESULT = (
    "struct<score:double,evidence:double,"
    "passages:array<struct<start:int,end:int,score:double,expected:double>>>"
)


def toxicity(model: ToxicityModel, spark):
    """A column function of the text: ``score`` (probability), ``evidence`` and the significant
    ``passages`` (code points, end exclusive; ``expected`` is how many as good clean text of this
    length has). A null text is an empty one and gets the score of a text without evidence."""
    shared = spark.sparkContext.broadcast(tuple(model))
    fields = pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]
    )

    @F.arrow_udf(_RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = ToxicityModel(*shared.value)
        known = _Scores(fitted.keys, fitted.base)
        for texts in batches:
            scores, sums, passages = [], [], []
            for text in texts.to_pylist():
                words, segments = _segments(known, text)
                evidence = fitted.evidence(words, segments)
                total = min(50.0, sum(max(0.0, e) for e in evidence))
                kept = [
                    (s, math.exp(-e))
                    for s, e in zip(segments, evidence, strict=True)
                    if math.exp(-min(e, 700)) <= EXPECTED
                ]
                places = [m.span() for m in _WORD.finditer(text.lower())] if kept else []
                sums.append(total)
                scores.append(fitted.probability(total))
                passages.append([
                    {"start": places[s.start][0], "end": places[s.end - 1][1], "score": s.score, "expected": e}
                    for s, e in kept
                ])
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(sums, pa.float64()),
                 pa.array(passages, pa.list_(fields))],
                ["score", "evidence", "passages"],
            )

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, evidence, passages``.

    Needs ``doc_id`` and ``text``; other columns are never read. Null and empty texts have no
    evidence. Rows that repeat are scored each. Empty tables give an empty result, and without
    labels nothing is toxic.
    """
    model = model or fit_toxicity(docs, labels)
    scored = docs.select("doc_id", toxicity(model, docs.sparkSession)("text").alias("t"))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("t.score").alias("score"),
        (F.col("t.score") >= 0.5).cast("int").alias("predicted"),
        F.col("t.evidence").alias("evidence"),
        F.col("t.passages").alias("passages"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = model or fit_toxicity(docs, labels)
    found = free_name(docs.columns, "_toxicity")
    scored = docs.withColumn(found, toxicity(model, docs.sparkSession)("text"))
    return scored.where(F.col(found)["score"] < 0.5).select(*docs.columns)
