"""Repeated passages against all windows of all texts, and the index against plain counting."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridmill.llm import fm_index, queries, substring_dedup
from gridmill.llm.oracles import ORACLES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
W = 35


def by_hand(rows, window=W):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    seen = Counter()
    for words in texts:
        seen.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, texts):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), kept))
    return sorted(out, key=repr)


def documents(spark, rows, partitions=5):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return frame.repartition(partitions)


def removed(rows):
    return sorted(
        [(r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["removed"] or []), r["kept_text"]) for r in rows],
        key=repr,
    )


def corpus(seed, size=200, passages=6):
    """Prose of few words with copies, near copies and passages that many texts share."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ä", "ä", "日本", "a\x1cb", "x y"]

    def prose(n):
        return [draw.choice(words) for _ in range(n)]

    shared = [prose(draw.choice([34, 35, 36, 50, 90])) for _ in range(passages)]
    rows = []
    for i in range(size):
        body = prose(draw.randrange(120))
        for _ in range(draw.choice([0, 0, 1, 2])):
            at = draw.randrange(len(body) + 1)
            body[at:at] = draw.choice(shared)
        if rows and draw.random() < 0.2:
            body = (draw.choice(rows)[1] or "").split(" ")
            if draw.random() < 0.7 and len(body) > 3:
                body[draw.randrange(len(body))] = f"new{i}"
        rows.append((i, draw.choice([" ", "  ", "\t", "\n"]).join(body)))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "x " * 5000), (904, "one two " * 60), (905, "p q r " * 12 + "s")]
    rows += [(906, " ".join(prose(34)))] * 3 + [(907, " ".join(prose(35)))] * 2 + [(None, " ".join(shared[0] + ["end"]))]
    long = prose(9000)
    rows += [(908, " ".join(long)), (909, " ".join(prose(50) + long[4000:4100] + prose(50) + long[100:135] + long[100:134]))]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [{}, {"shard_words": 300}, {"hot_passages": 3, "shard_words": 2000}, {"anchor": 1}, {"anchor": 35}])
def test_repeats(spark, settings):
    rows = corpus(1)
    got = removed(substring_dedup.remove_repeats(documents(spark, rows), **settings).collect())
    want = by_hand(rows)
    assert got == want
    assert sum(r[2] for r in want) > 1000 and any(0 < r[2] < r[1] for r in want)


def test_hot_passage_in_many_texts(spark, monkeypatch):
    """A passage in each text, between words that are all different: the anchors in the passage
    are hot, and the windows at its edges go by other anchors."""
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = [[f"{side}{i}x{k}" for k in range(draw.randrange(40))] for side in "lr"]
        rows.append((i, " ".join(own[0] + passage[: draw.choice([60, 60, 40])] + own[1])))
    monkeypatch.setattr(substring_dedup, "HELD_BYTES", 20_000)
    docs = documents(spark, rows, 8)
    assert removed(substring_dedup.remove_repeats(docs, hot_passages=20).collect()) == by_hand(rows)
    classes = substring_dedup.text_classes(docs, W, 12)
    found = substring_dedup.shared_passages(docs, classes, W, 12)
    largest = [
        max(Counter(r["anchor"] for r in {(r["anchor"], r["words"]): r for t in tables for r in t.collect() if r["words"]}.values()).values())
        for tables in ([found], substring_dedup.spread_hot(found, W, 12, 20))
    ]
    assert largest[0] > 100 and largest[1] < 40


def test_other_windows(spark):
    rows = corpus(2, 80)
    for window, anchor in ((5, 3), (12, 12), (60, 20)):
        got = removed(substring_dedup.remove_repeats(documents(spark, rows), window, anchor=anchor).collect())
        assert got == by_hand(rows, window)


def test_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeats(empty).collect() == []
    assert substring_dedup.drop_repeats(empty).collect() == []
    rows = corpus(3, 60)
    clash = "digest string, spans int, anchor int, words string, _digest int, _spans int"
    docs = spark.createDataFrame(
        [(i, t, None, None, 0, "d", 1, 2, "w", 3, 4) for i, t in rows], SCHEMA + ", " + clash
    ).repartition(3)
    assert removed(substring_dedup.remove_repeats(docs).collect()) == by_hand(rows)
    cut = substring_dedup.drop_repeats(docs)
    assert cut.columns == docs.columns
    want = {(i, n, kept) for i, n, gone, kept in by_hand(rows) if gone}
    same = [r for r in cut.collect() if (r["doc_id"], r["text"]) in set(rows)]
    changed = [r for r in cut.collect() if (r["doc_id"], r["text"]) not in set(rows)]
    assert {(r["doc_id"], r["text"]) for r in changed} == {(i, kept) for i, _, kept in want}
    assert len(same) + len(changed) == len(rows) and {r["digest"] for r in changed} == {"d"}


def test_index_counts():
    draw = np.random.default_rng(3)
    for words, size in ((1, 40), (2, 300), (9, 700), (900, 3000)):
        parts = [draw.integers(1, words + 1, draw.integers(0, 60)) for _ in range(size // 30)]
        text = np.concatenate([np.append(p, 0) for p in parts])
        index = fm_index.FmIndex(text)
        for _ in range(60):
            n = int(draw.integers(1, 7))
            part = parts[int(draw.integers(len(parts)))]
            at = int(draw.integers(max(1, len(part))))
            pattern = part[at : at + n] if draw.random() < 0.7 else draw.integers(1, words + 1, n)
            want = sum(
                list(p[i : i + len(pattern)]) == list(pattern)
                for p in parts for i in range(len(p) - len(pattern) + 1)
            ) if len(pattern) else len(text)
            assert index.count(pattern) == want
    # Less than a tenth of the suffix array and the words that it stands for.
    assert index.matrix.nbytes < len(text) * 16 / 2


def test_statistics():
    draw = random.Random(4)
    parts = [[draw.choice([1, 2, 3]) for _ in range(draw.randrange(1, 40))] for _ in range(30)]
    text = np.array([w for p in parts for w in [*p, 0]], np.int64)
    index = fm_index.FmIndex(text)
    ends, floors, want, at = [], [], [], 0
    for part in parts:
        for x in range(len(part)):
            best = 0
            while best <= x:
                piece = part[x - best : x + 1]
                seen = sum(p[i : i + len(piece)] == piece for p in parts for i in range(len(p) - len(piece) + 1))
                if seen < 2:
                    break
                best += 1
            ends.append(at + x)
            floors.append(at)
            want.append(best)
        at += len(part) + 1
    assert index.statistics(text, np.array(ends), np.array(floors), 100).tolist() == want
    assert index.statistics(text, np.array(ends), np.array(floors), 4).tolist() == [min(4, n) for n in want]


def test_anchor_places():
    draw = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 24):
        order = draw.integers(0, 6, 200).astype(np.uint64)
        got = substring_dedup.anchor_places(order, width)
        assert got.tolist() == [i + int(np.argmin(order[i : i + width])) for i in range(len(order) - width + 1)]


def test_sql_on_hard_rows(spark, tmp_path):
    rows = corpus(6, 120)
    documents(spark, rows, 2).write.parquet(f"{tmp_path}/documents.parquet")
    engine = duckdb.connect()
    engine.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    result = engine.execute(ORACLES["op11_substring_dedup"])
    columns = [c[0] for c in result.description]
    got = queries.QUERIES["op11_substring_dedup"](spark, str(tmp_path)).select(*columns).collect()
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in by_hand(rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, result.fetchall())) == sorted(map(repr, want))
