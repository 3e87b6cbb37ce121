"""Scan for secrets with a random forest that removes false findings.

Patterns find candidates: values assigned to names like ``password`` and long runs of letters,
digits and a few signs with a digit in them. A forest, trained on labelled findings, then judges
each by its length, the transitions between its characters, how much of it dictionary words
cover, the path it was found in and the words around it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm import bounded
from gridmill.sources.scratch import materialize

#: Share of the documents that have a word of the dictionary, at least. So it has at most the mean
#: number of words of a document over this share, at every size.
DICTIONARY_SHARE = 0.0005
#: Labelled findings that neighbours' weights and the forest are each fitted on, at most.
TRAIN_ROWS = 50_000
#: Words with a weight, at most: the most frequent around labelled findings.
NEIGHBOURS = 20_000
#: Words on either side of a finding that count.
NEAR = 3
#: Different words that a task counts before it passes them on: memory only, the sums are the same.
COUNTED = 200_000
TREES = 40
DEPTH = 8

ASSIGNED = re.compile(
    r"""(?i)(?:password|passwd|pwd|secret|token|(?:api|access|private|auth)[_-]?key)(?:[_-]?(?:access|key|token|value)){0,3}["']?\s{0,3}[:=]\s{0,3}["']?([^\s"']{6,})"""
)
RUN = re.compile(r"[A-Za-z0-9_+/\-]{12,}={0,2}")
#: Formats that name their provider.
PROVIDER = re.compile(
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|glpat-[A-Za-z0-9_-]{20}|[rs]k_live_[A-Za-z0-9]{16,}"
)
#: Rules of their own, after assigned values; the first group is the secret.
RULES = {
    "key": re.compile(r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*-----END[A-Z ]{0,40}-----)?)"),
    "url": re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s:/@]{0,64}:([^\s/@]{1,128})@"),
    "bearer": re.compile(r"(?i)\bbearer\s{1,3}([A-Za-z0-9._~+/-]{12,}=*)"),
    "provider": re.compile(rf"(?<![A-Za-z0-9])({PROVIDER.pattern})(?![A-Za-z0-9])"),
}
#: What a match of ``ASSIGNED`` starts with, in a folded text.
_NAMES = ("password", "passwd", "pwd", "secret", "token", "key")
_NAME = re.compile(r"password|passwd|pwd|secret|token|(?:api|access|private|auth)[_-]?key")
#: What a text must have for a rule to match, one of each: cheap to look for, few texts have it.
_SIGNS = {
    "key": ("-----BEGIN ",),
    "url": ("://",),
    "bearer": ("bearer",),
    "provider": ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "glpat-", "k_live_"),
}
#: The end of a match of the rule for URLs, which needs no search for the start of the scheme.
_URL_END = re.compile(r"://[^\s:/@]{0,64}:[^\s/@]{1,128}@")
#: A run that is words only, with signs between them.
_PLAIN = re.compile(r"[+/_=-]*(?:(?:[A-Za-z][a-z]{0,23}|[A-Z]{1,23})(?:[+/_=-]+|$))+")
#: Runs that are known to be something else: numbers, dates, UUIDs.
_OTHER = re.compile(r"[0-9+/_=-]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORD = re.compile(r"[^\W\d_]{3,12}")
_TOKEN = re.compile(r"\S+")

FEATURES = (
    "length", "digits", "capitals", "signs", "transitions", "surprise", "entropy", "coverage",
    "slashes", "near_weight", "path_weight",
)
_FINDING = (
    "doc_id bigint, start int, end int, rule string, length double, digits double,"
    " capitals double, signs double, transitions double, surprise double, entropy double,"
    " coverage double, slashes double, near array<string>, path array<string>, evident boolean, known boolean"
)


def word_frequencies(docs: DataFrame) -> DataFrame:
    """``word, documents`` for the words of 3 to 12 letters of all documents, outside of
    candidates: a secret must not vouch for itself, however often it is copied."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                ["word", "documents"],
            )

        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                text, rest, at = text.as_py() or "", [], 0
                for start, end, _ in candidates(text):
                    rest.append(text[at:start])
                    at = end
                rest.append(text[at:])
                found.update(set(_WORD.findall(" ".join(rest).lower())))
                if len(found) >= COUNTED:
                    yield counted()
                    found.clear()
        yield counted()

    counted = docs.select("text").mapInArrow(count, "word string, documents bigint")
    return counted.groupBy("word").agg(F.sum("documents").alias("documents"))


class Lexicon:
    """Dictionary words and how likely one character follows another in them."""

    def __init__(self, words: Sequence[tuple[str, int]]):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        pairs: Counter[str] = Counter()
        for word, n in words:
            if len(word) >= 4:
                self.words.add_word(word, len(word))
            for i in range(len(word) - 1):
                pairs[word[i : i + 2]] += n
        self.words.make_automaton()
        firsts: Counter[str] = Counter()
        for pair, n in pairs.items():
            firsts[pair[0]] += n
        self.pairs = {p: math.log((n + 0.5) / (firsts[p[0]] + 20)) for p, n in pairs.items()}

    def coverage(self, value: str) -> float:
        covered = bytearray(len(value))
        if len(self.words):
            for end, length in self.words.iter(value.lower()[: len(value)]):
                covered[end - length + 1 : end + 1] = b"\1" * length
        return sum(covered) / max(1, len(value))

    def surprise(self, value: str) -> float:
        """Mean negative log-likelihood of the transitions between characters."""
        low = value.lower()
        return -sum(self.pairs.get(low[i : i + 2], -6.0) for i in range(len(low) - 1)) / max(1, len(low) - 1)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3


def value_features(value: str, lexicon: Lexicon) -> list[float]:
    kinds = [_kind(c) for c in value]
    n = len(value)
    counts = Counter(value)
    return [
        float(n),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        lexicon.surprise(value),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        lexicon.coverage(value),
        float(value.count("/")),
    ]


def _folded(text: str) -> str:
    """``text`` as patterns that ignore case see its letters, each at its place."""
    if not text.isascii():
        text = text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")
    return text.lower()


def _assigned(text: str, folded: str) -> Iterator[re.Match[str]]:
    """The matches of ``ASSIGNED``, tried only where one can start."""
    if not any(name in folded for name in _NAMES):
        return
    at = 0
    while name := _NAME.search(folded, at):
        if m := ASSIGNED.match(text, name.start()):
            yield m
        at = m.end() if m else name.start() + 1


def _may_match(rule: str, text: str, folded: str) -> bool:
    where = folded if rule == "bearer" else text
    return any(sign in where for sign in _SIGNS[rule]) and (rule != "url" or bool(_URL_END.search(text)))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping ``start, end, rule``; an assigned value goes before the other rules, these
    in their order, and all before a run."""
    folded = _folded(text)
    found = [(*m.span(1), "assigned") for m in _assigned(text, folded)]
    for rule, pattern in RULES.items():
        if not _may_match(rule, text, folded):
            continue
        taken, at = sorted(found), 0
        for m in pattern.finditer(text):
            start, end = m.span(1)
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at == len(taken) or taken[at][0] >= end:
                found.append((start, end, rule))
    taken = sorted(found)
    at = 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        if not _PLAIN.fullmatch(m.group()):
            found.append((start, end, "run"))
    return sorted(found)


def judge_pattern(value: str, rule: str, coverage: float) -> tuple[bool, bool]:
    """Whether a finding is evident by its pattern, and whether the pattern says anything: a run
    that is neither words nor a known other thing may be a secret or not."""
    mixed = any(c.isdigit() for c in value) or (value != value.lower() and value != value.upper())
    evident = (
        rule in ("key", "provider")
        or bool(PROVIDER.fullmatch(value))
        or (rule != "run" and coverage < 0.5 and mixed)
    )
    return evident, evident or coverage >= 0.5 or bool(_OTHER.fullmatch(value))


def _around(text: str, start: int, end: int) -> list[str]:
    """The words next to a finding, lower-case, with their side."""
    before = _TOKEN.findall(text[max(0, start - 80) : start])[-NEAR:]
    after = _TOKEN.findall(text[end : end + 80])[:NEAR]
    return [f"-{w.lower()[:40]}" for w in before] + [f"+{w.lower()[:40]}" for w in after]


def find_candidates(docs: DataFrame, words: Sequence[tuple[str, int]], path: str | None) -> DataFrame:
    """Stored findings with their features. ``evident``: the pattern alone says that it is a
    secret (a provider's format, or a value without dictionary words given to such a name)."""
    shared = docs.sparkSession.sparkContext.broadcast(list(words))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        names = [field.split()[0] for field in _FINDING.split(", ")]
        types = [
            pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 9,
            pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.bool_(),
        ]
        for batch in batches:
            rows = []
            for doc_id, text, where in zip(
                batch.column("doc_id").to_pylist(), batch.column("text"),
                batch.column("path").to_pylist(), strict=True,
            ):
                text = text.as_py() or ""
                parts = [p for p in re.split(r"[/._\-\s]+", (where or "").lower()) if p][-8:]
                for start, end, rule in candidates(text):
                    value = text[start:end]
                    features = value_features(value, lexicon)
                    evident, known = judge_pattern(value, rule, features[7])
                    rows.append((
                        doc_id, start, end, rule, *features, _around(text, start, end), parts, evident, known,
                    ))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
            )

    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    found = docs.select("doc_id", "text", where.alias("path")).mapInArrow(find, _FINDING)
    return materialize(found, "findings")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def _log_odds(labelled: DataFrame, column: str, most: int) -> dict[str, float]:
    """Weights of the most frequent words, under a Dirichlet prior."""
    counts = (
        labelled.select(F.explode(column).alias("word"), "label")
        .groupBy("word")
        .agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no"))
        .withColumn("n", F.col("yes") + F.col("no"))
    )
    counts = bounded.highest(materialize(counts, "neighbours"), "n", most).collect()
    yes = sum(r["yes"] for r in counts) + 1.0
    no = sum(r["no"] for r in counts) + 1.0
    share = yes / (yes + no)
    return {
        r["word"]: math.log((r["yes"] + 2 * share) / (r["no"] + 2 * (1 - share))) - math.log(yes / no)
        for r in counts
    }


def _weigh(spark, weights: dict[str, float]):
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array(
                [sum(shared.value.get(w, 0.0) for w in words or ()) for words in lists.to_pylist()],
                pa.float64(),
            )

    return weigh


def judge_findings(
    findings: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 7
) -> DataFrame:
    """Add ``probability`` to stored ``findings``.

    ``labelled`` are findings with ``label`` 0 or 1. One half, by hash, gives the weights of
    words nearby and of path parts, the other trains the forest, each on the ``train_rows`` with
    the smallest hashes at most. If a class is missing, the probability is the share of 1 (or
    null without any label), as there is nothing to tell apart.
    """
    key = F.xxhash64("doc_id", "start", F.lit(seed))
    further = F.xxhash64("start", "doc_id", F.lit(seed))
    halves = [
        materialize(
            bounded.sample(labelled.where(F.pmod(key, F.lit(2)) == half), further, train_rows), "labelled"
        )
        for half in (0, 1)
    ]
    spark = findings.sparkSession
    near = _weigh(spark, _log_odds(halves[0], "near", NEIGHBOURS))
    path = _weigh(spark, _log_odds(halves[0], "path", NEIGHBOURS))
    weighted = [
        t.withColumn("near_weight", near("near")).withColumn("path_weight", path("path"))
        for t in (halves[1], findings)
    ]
    ones, rows = halves[1].agg(F.sum("label"), F.count("*")).first()
    if not ones or ones == rows:
        share = F.lit(float(ones or 0) / rows if rows else None).cast("double")
        return findings.withColumn("probability", share)
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction", numTrees=TREES, maxDepth=DEPTH,
        seed=seed,
    ).fit(vector.transform(weighted[0].withColumn("label", F.col("label").cast("double"))))
    return (
        forest.transform(vector.transform(weighted[1]))
        .withColumn("probability", vector_to_array("_probability")[1])
        .drop("_features", "_raw", "_probability", "_prediction")
    )


def scan_secrets(
    docs: DataFrame, labels: DataFrame | None = None, path: str | None = "source"
) -> DataFrame:
    """One row per finding: ``doc_id, start, end`` (code points, end exclusive), ``rule,
    probability, is_secret, held_out`` and the features.

    ``labels`` has ``doc_id, start, label`` for known findings. Without it the findings that are
    evident by their pattern alone count as secrets, words, numbers and the like as false, and
    runs that may be either have no label, in documents that are not held out. Needs ``doc_id`` and ``text``; ``path`` may name a column that says where a
    document is from. Null and empty texts have no findings, rows that repeat have theirs each,
    texts are read whole, other columns are ignored and an empty table gives an empty result.
    """
    words = materialize(word_frequencies(docs), "words")
    frequent = words.where(F.col("documents") >= DICTIONARY_SHARE * docs.count())
    dictionary = sorted((r["word"], r["documents"]) for r in frequent.collect())
    findings = find_candidates(docs, dictionary, path)
    if labels is None:
        labelled = findings.where(~is_held_out(F.col("doc_id")) & F.col("known")).withColumn(
            "label", F.col("evident").cast("int")
        )
    else:
        labelled = findings.join(
            labels.select("doc_id", "start", F.col("label").cast("int").alias("label")),
            ["doc_id", "start"],
        )
    judged = judge_findings(findings, labelled)
    return judged.select(
        "doc_id", "start", "end", "rule", "probability",
        F.coalesce(F.col("probability") >= 0.5, F.lit(False)).alias("is_secret"),
        is_held_out(F.col("doc_id")).alias("held_out"),
        "evident", *FEATURES[:9],
    )
