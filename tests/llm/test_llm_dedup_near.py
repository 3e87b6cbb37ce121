"""Exact and near duplicates against plain-Python versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import digest_index as exact
from gridmill.llm import near_join as near
from gridmill.sources.scratch import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], SCHEMA)


# --- exact ---------------------------------------------------------------------------------


def by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return groups


def test_exact_duplicates(spark):
    draw = random.Random(1)
    texts = ["", None, "a", "a ", "A", "ä" * 50_000, "same"]
    rows = [(i, "same" if i % 3 == 0 else draw.choice(texts)) for i in range(300)]
    got = exact.exact_duplicates(documents(spark, rows)).collect()
    groups = by_hand(rows)
    assert len(got) == 300
    for r in got:
        ids = groups[dict(rows)[r["doc_id"]] or ""]
        text = (dict(rows)[r["doc_id"]] or "").encode()
        assert r["keep_id"] == max(ids) and r["group_size"] == len(ids)
        assert r["kept"] == (r["doc_id"] == max(ids))
        assert r["text_sha256"] == hashlib.sha256(text).hexdigest()


def test_exact_repeats_and_null_ids(spark):
    rows = [(5, "x")] * 4 + [(None, "x"), (None, "y"), (None, "y")]
    got = exact.exact_duplicates(documents(spark, rows)).collect()
    kept = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]]
    assert sorted(kept, key=repr) == sorted([(5, 5, 5), (None, None, 2)], key=repr)


def test_exact_empty(spark):
    assert exact.exact_duplicates(documents(spark, [])).collect() == []
    assert exact.drop_exact_duplicates(documents(spark, [])).collect() == []


def test_the_same_batch_again(spark):
    """A job that appended and died, then runs once more with other row numbers."""
    index = exact.DigestIndex(spark, scratch_path(spark, "index"), 4)
    first = [(i, f"text {i % 7}") for i in range(30)]
    exact.exact_duplicates(documents(spark, first), index, "one").collect()
    again = exact.exact_duplicates(documents(spark, first[::-1]).repartition(5), index, "one")
    kept = sorted(r["doc_id"] for r in again.collect() if r["kept"])
    assert kept == list(range(23, 30)) and index.table().count() == 7
    assert {r["group_size"] for r in again.collect()} == {4, 5}
    other = exact.exact_duplicates(documents(spark, first + [(99, "new")]), index, "two").collect()
    assert [r["doc_id"] for r in other if r["kept"]] == [99]
    # A try that had appended only a part of its texts.
    exact.exact_duplicates(documents(spark, [(200, "half a"), (201, "text 1")]), index, "three").collect()
    whole = exact.exact_duplicates(documents(spark, [(200, "half a"), (201, "text 1"), (202, "half b")]), index, "three")
    assert sorted(r["doc_id"] for r in whole.collect() if r["kept"]) == [200, 202]
    assert index.table().count() == 10


def test_two_batches_give_the_table(spark):
    """Higher ids first: the later batch is dropped where the earlier has its text."""
    rows = [(i, f"t{(i * i) % 23}") for i in range(120)]
    index = exact.DigestIndex(spark, scratch_path(spark, "index"), 3)
    kept = []
    for part in (rows[60:], rows[:60]):
        kept += [r["doc_id"] for r in exact.exact_duplicates(documents(spark, part), index).collect() if r["kept"]]
    assert sorted(kept) == sorted(max(ids) for ids in by_hand(rows).values())


def test_no_table_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    result = exact.exact_duplicates(documents(spark, [(1, "a"), (2, "a")]))
    dropped = exact.drop_exact_duplicates(documents(spark, [(1, "a"), (2, "a")]))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert [r["doc_id"] for r in result.collect() if r["kept"]] == [2]
    assert [r["doc_id"] for r in dropped.collect()] == [2]


def test_index_persists_over_batches(spark):
    path = scratch_path(spark, "index")
    first = exact.DigestIndex(spark, path, 4)
    exact.exact_duplicates(documents(spark, [(1, "a"), (2, "b")]), first).collect()
    spark.sql(f"drop table {first.name}")  # another session knows the path only
    again = exact.DigestIndex(spark, path, 4)
    got = exact.exact_duplicates(documents(spark, [(8, "a"), (9, "c"), (7, "c")]), again)
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()}
    assert rows == {8: (1, 2, False), 9: (9, 2, True), 7: (9, 2, False)}
    assert again.table().count() == 3


def test_index_is_not_shuffled(spark):
    index = exact.DigestIndex(spark, scratch_path(spark, "index"), 4)
    exact.exact_duplicates(documents(spark, [(i, str(i)) for i in range(50)]), index).collect()
    rows = exact.digest_rows(documents(spark, [(1, "1")]))
    joined = rows.join(index.table().hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_drop_keeps_all_columns(spark):
    docs = documents(spark, [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, "")]).withColumn(
        "_row", F.lit("mine")
    )
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["_row"]) for r in kept.collect()) == [(2, "mine"), (4, "mine")]


# --- near ----------------------------------------------------------------------------------


def grams(text, n=5):
    words = (text or "").lower().encode().split()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def near_by_hand(rows, threshold=0.8):
    """Links between distinct texts, and the smallest id of each component."""
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets = [grams(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    smallest = {}
    for doc_id, text in rows:
        k = root(texts.index(text or ""))
        smallest[k] = min(smallest.get(k, doc_id), doc_id)
    return {d: (smallest[root(texts.index(t or ""))], links[texts.index(t or "")]) for d, t in rows}


def corpus(seed, groups=6, size=40):
    """Groups of near copies around one text each, with similarities on both sides of 0.8."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(groups):
        base = [draw.choice(words) for _ in range(draw.randint(60, 200))]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(" ".join(copy))
    rows += [" ".join(draw.choice(words) for _ in range(80)) for _ in range(60)]
    rows += ["", None, "one two", "One  Two", "one two three", "  "]
    rows += rows[:50]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [7, 256])
def test_near_duplicates(spark, block):
    """Small blocks make many cells; nothing changes."""
    rows = corpus(3)
    got = near.near_duplicates(documents(spark, rows), block=block).collect()
    expected = near_by_hand(rows)
    wrong = {
        r["doc_id"]: ((r["class_id"], r["n_links"]), expected[r["doc_id"]])
        for r in got
        if (r["class_id"], r["n_links"]) != expected[r["doc_id"]]
    }
    assert len(got) == len(rows) and not wrong
    assert max(r["n_links"] for r in got) > 10


def test_near_drop_keeps_one_of_each_group(spark):
    rows = corpus(4, groups=3, size=10)
    docs = documents(spark, rows).withColumn("_own", F.lit(1)).withColumn("_digest", F.lit(2))
    kept = near.drop_near_duplicates(docs)
    expected = near_by_hand(rows)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in expected.values()})


def test_near_null_ids_and_empty(spark):
    same = "a b c d e f g"
    got = near.near_duplicates(documents(spark, [(None, same), (None, same), (3, same), (None, "x y z")]))
    assert sorted((r["class_id"] or -1, r["copies"]) for r in got.collect()) == [(-1, 1), (3, 3), (3, 3), (3, 3)]
    assert near.near_duplicates(documents(spark, [])).collect() == []
    kept = near.drop_near_duplicates(documents(spark, [(None, same), (None, same), (None, "")]))
    assert sorted(r["text"] for r in kept.collect()) == ["", same]


def test_bands_reach_the_recall():
    bands = near.choose_bands(0.8, 0.9998, 192)
    assert bands.recall(0.8) >= 0.9998 and bands.bands * bands.rows <= 192
    with pytest.raises(ValueError):
        near.choose_bands(0.8, 0.9998, 4)


def test_linked_is_exact():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 50))) for _ in range(40)]
    got = near._linked(sets, 0.5)
    for i in range(40):
        for j in range(40):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (i != j and len(a & b) >= 0.5 * len(a | b))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(399) if i % 100 != 99] + [(1000, 1001)] * 3
    labels = near.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert got == {**{i: i // 100 * 100 for i in range(400)}, 1000: 1000, 1001: 1000}
