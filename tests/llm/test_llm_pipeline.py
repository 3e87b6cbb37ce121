"""The pipeline against plain-Python versions of its stages, and the registered queries."""

import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from gridmill.llm import mixing, queries, toxicity
from test_llm_dedup_near import corpus, near_by_hand
from test_llm_mix_pack_shard import targets_by_hand
from test_llm_models import toxic_corpus
from test_llm_personal import HARD, random_texts, story

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DATA = os.environ.get("GRIDMILL_TEST_DATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic, copied and nearly copied documents of three sources, and odd rows."""
    path = str(tmp_path_factory.mktemp("corpus"))
    draw = random.Random(4)
    rows, labels, _ = toxic_corpus(500)
    texts = [t for _, t, _, _ in rows]
    for i in range(60):
        words = draw.choice([t for t in texts if len(t.split()) > 60]).split()
        if i % 2:
            words[draw.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, "short", "short", "nasty vileword nasty vileword"]
    docs = [(i, t, "en", draw.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def stage(spark, folder, name, docs, tmp):
    """One stage on its own, written and read again."""
    done = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    done.write.parquet(tmp)
    return spark.read.parquet(tmp)


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    def pairs(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    clean = stage(spark, folder, "toxicity", docs, str(tmp_path / "1"))
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert clean.columns == columns
    assert sorted(pairs(clean), key=repr) == sorted([x for x in pairs(docs) if not scores[x[0]]], key=repr)
    left = [t or "" for _, t in pairs(clean)]
    assert not any("vileword nasty" in t for t in left) and len(left) > 400

    distinct = stage(spark, folder, "exact dedup", clean, str(tmp_path / "2"))
    last = {}
    for doc_id, text in pairs(clean):
        last[text or ""] = max(doc_id, last.get(text or "", -1))
    assert distinct.columns == columns and sorted(d for d, _ in pairs(distinct)) == sorted(last.values())

    single = stage(spark, folder, "n-gram Jaccard join", distinct, str(tmp_path / "3"))
    groups = near_by_hand(pairs(distinct))
    assert single.columns == columns
    assert sorted(d for d, _ in pairs(single)) == sorted({c for c, _ in groups.values()})
    assert single.count() < distinct.count()

    mixed = stage(spark, folder, "mixing sources to target weights", single, str(tmp_path / "4"))
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in single.collect():
        n = len((r["text"] or "").split())
        sizes[r["source"]] += n
        longest[r["source"]] = max(n, longest[r["source"]])
    for r in mixed.collect():
        taken[r["source"]] += len((r["text"] or "").split())
    for source, target in targets_by_hand(sizes).items():
        assert abs(taken[source] - target) <= longest[source] + 1e-6
    assert mixed.columns == columns and max(Counter(d for d, _ in pairs(mixed)).values()) <= 2

    packed = stage(spark, folder, "best-fit packing", mixed, str(tmp_path / "5")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text in pairs(mixed):
        want[doc_id] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    got, places = Counter(), defaultdict(list)
    for r in packed:
        got[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for filled in places.values():
        starts = [o for o, _ in sorted(filled)]
        ends = np.cumsum([n for _, n in sorted(filled)])
        assert starts == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert len(places) <= sum(want.values()) / 4096 * 1.1 + 2


def test_run_is_the_stages(spark, folder):
    first, second = (corpus_pipeline.run(spark, folder) for _ in range(2))

    def lengths(df):
        return sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())

    assert lengths(first) == lengths(second) != []


def test_pipeline_of_nothing(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert mixing.BLOCK > 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    engine = duckdb.connect()
    for table in ("documents", "labels"):
        engine.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    result = engine.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(repr, result.fetchall()))
    df = queries.QUERIES[name](spark, DATA).select(*columns)
    assert sorted(repr(tuple(r)) for r in df.collect()) == want and want


@pytest.mark.parametrize("name", ["op5_personal_data", "op8_near_join"])
def test_sql_agrees_on_hard_rows(spark, tmp_path, name):
    """Terms that disclose, hard patterns, near copies: what the given tables hold little of."""
    if name == "op5_personal_data":
        rows = [(r["doc_id"], r["text"]) for r in story(spark).collect()]
        rows += [(1000 + i, t) for i, t in enumerate([h for h in HARD if h is None or len(h) < 5000] + random_texts(300))]
    else:
        rows = corpus(8, groups=3, size=15)
    docs = [(i, t, None, None, len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    engine = duckdb.connect()
    engine.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    result = engine.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(repr, result.fetchall()))
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert any("term:" in w for w in want) or name != "op5_personal_data"
