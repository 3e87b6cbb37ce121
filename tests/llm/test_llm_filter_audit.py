"""The audit of filters against all orders applied one after the other, and against its SQL."""

import random
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from gridmill.llm import filter_audit, queries
from gridmill.llm.oracles import ORACLES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
HARD = [
    None, "", " \t ", "A" * 70_000, "word " * 60_000, "ä Ö " * 30, "\x0bone\x1ctwo\x0cthree", "x y" * 60,
    " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), "price $5 and 100% & more | * #",
    " ".join(f"w{i % 65}" for i in range(100)), " ".join(f"w{i % 64}" for i in range(100)),
    "ABCDE" + "x" * 95, "ABCDEF" + "x" * 94, "tail ", " head", "\U0001f600" * 19 + "Z", "\U0001f600" * 20 + "Z",
]


def by_hand(docs, labels):
    """Each order applied to the rows that are left."""
    smallest, good, toxic = {}, set(), set()
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    for doc_id, quality, bad in labels:
        if doc_id is not None:
            good |= {doc_id} if quality == 1 else set()
            toxic |= {doc_id} if bad == 1 else set()
    parts = defaultdict(list)
    for doc_id, text, _, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = ""
        failed += "A" if len(words) < 50 else ""
        failed += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        failed += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
        failed += "D" if re.search(r"[#$%&*|]", text) else ""
        failed += "E" if doc_id is not None and smallest[text] < doc_id else ""
        parts[source or ""].append((failed, doc_id in good, doc_id in toxic))
    rows, shapley = [], defaultdict(int)
    for part, members in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, name in enumerate(order, 1):
                gone = [m for m in left if name in m[0]]
                left = [m for m in left if name not in m[0]]
                shapley[part, name] += len(gone)
                failing = sum(name in m[0] for m in members)
                rows.append((
                    part, order, step, len(left), len(gone), failing - len(gone), sum(m[0] == name for m in members),
                    sum(m[1] for m in gone), sum(m[2] for m in gone),
                ))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def table(rows):
    draw = random.Random(7)
    docs = [(i, t, draw.choice(["en", None]), draw.choice(["a", "a", "b", None]), len(t or "")) for i, t in rows]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 0, 1, None])) for i, _ in rows if draw.random() < 0.7]
    return docs, labels


def hard_rows():
    draw = random.Random(11)
    rows = [(i, t) for i, t in enumerate(HARD * 3)]
    for i in range(400):
        words = [draw.choice(["alpha", "Beta", "GAMMA", "de$lta", "eps"]) + str(draw.randrange(40)) for _ in range(draw.randrange(90))]
        rows.append((100 + i, " ".join(words)))
    rows += [(900 + i, "the same text again and again") for i in range(60)]
    rows += [(900, "the same text again and again"), (None, ""), (None, "only here"), (None, None), (5, "of id 5"), (5, "of id 5")]
    draw.shuffle(rows)
    return rows


@pytest.fixture
def few_copies_a_task(monkeypatch):
    monkeypatch.setattr(filter_audit, "SALT_ROWS", 7)


def test_audit(spark, few_copies_a_task):
    docs, labels = table(hard_rows())
    labels += [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    # Columns of other meanings with names that the operator uses inside.
    frame = spark.createDataFrame(
        [(*d, 1, "x", 2, "y") for d in docs],
        SCHEMA + ", row int, part string, mask int, digest string",
    ).repartition(5)
    got = filter_audit.audit_filters(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == by_hand(docs, labels)


def test_audit_of_nothing(spark):
    nothing = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_filters(spark.createDataFrame([], SCHEMA), nothing).collect() == []
    one = filter_audit.audit_filters(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), nothing).collect()
    assert sorted(map(tuple, one)) == by_hand([(1, None, None, None, None)], [])
    assert len(one) == 600


def test_sql_on_hard_rows(spark, tmp_path):
    docs, labels = table(hard_rows())
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    engine = duckdb.connect()
    for name in ("documents", "labels"):
        engine.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    result = engine.execute(ORACLES["op13_filter_audit"])
    columns = [c[0] for c in result.description]
    got = queries.QUERIES["op13_filter_audit"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())
