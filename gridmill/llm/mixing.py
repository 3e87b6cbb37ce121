"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target of words; each of its documents gets the same fractional number of
copies, target over source size. The whole part is taken as it is. The fraction is rounded: two
documents are paired and words move at random from one to the other until one of them has a
whole number of copies; the other goes on. The source's expected words stay the same in every
step, and so does each document's chance. Blocks of documents are folded to one open document
each, those are folded in blocks again, and so on up to one per source. Long documents come
first: the short ones after them settle them, so the one left over at the end is short and the
words taken miss the target by little.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.names import free_name
from gridmill.operators.numbering import number_rows
from gridmill.sources.scratch import materialize

#: Documents that one step of the tree folds to one.
BLOCK = 64

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in the order of their code points, null last, take ``weights`` in turn. Together they
    get ``share`` of all words, but no source more than ``most`` times its own; what it can't
    take goes to the others by weight, again and again until none is above. One row per source
    passes through the driver's loop as sums; the numbering of sources is one small sort.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(
        sizes.select(
            "source",
            "source_size",
            F.get(weight, (turn % len(weights)).cast("int")).alias("weight"),
            (F.col("source_size") * float(most)).alias("cap"),
        ),
        "sources",
    )
    budget = table.agg(F.sum("source_size")).first()[0]
    budget = float(budget or 0) * share
    level, full = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        taken, weight_left, count = table.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
            F.sum(over.cast("long")),
        ).first()
        if not weight_left or count == full:
            break
        level, full = max(0.0, budget - taken) / weight_left, count
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def _let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is computed once."""
    return F.transform(F.array(value), use)[0]


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fold(items: Column, seed: int, number: int) -> Column:
    """Fold sorted ``struct<n, size, p>`` to ``struct<n, size, p, done: array<struct<n, take>>>``."""

    def state(n, size, p, done):
        return F.struct(n.alias("n"), size.alias("size"), p.alias("p"), done.alias("done"))

    def settled(done, n, take):
        return F.concat(done, F.array(F.struct(n.alias("n"), F.lit(take).alias("take"))))

    def near(p):
        return F.when(p < 1e-12, 0.0).when(p > 1 - 1e-12, 1.0).otherwise(p)

    def step(held, item):
        def move(w):
            up = w["u"] * (w["up"] + w["down"]) < w["down"]
            return (
                F.when(
                    up & (w["room"] <= w["mass"]),
                    state(
                        item["n"], item["size"], near(item["p"] - w["up"] / item["size"]),
                        settled(held["done"], held["n"], 1),
                    ),
                )
                .when(
                    up,
                    state(
                        held["n"], held["size"], near(held["p"] + w["up"] / held["size"]),
                        settled(held["done"], item["n"], 0),
                    ),
                )
                .when(
                    w["held"] <= w["space"],
                    state(
                        item["n"], item["size"], near(item["p"] + w["down"] / item["size"]),
                        settled(held["done"], held["n"], 0),
                    ),
                )
                .otherwise(
                    state(
                        held["n"], held["size"], near(held["p"] - w["down"] / held["size"]),
                        settled(held["done"], item["n"], 1),
                    )
                )
            )

        room, mass = held["size"] * (1 - held["p"]), item["size"] * item["p"]
        mine, space = held["size"] * held["p"], item["size"] * (1 - item["p"])
        pair = F.struct(
            room.alias("room"), mass.alias("mass"), mine.alias("held"), space.alias("space"),
            F.least(room, mass).alias("up"), F.least(mine, space).alias("down"),
            _uniform(F.lit(seed), F.lit(number), held["n"], item["n"]).alias("u"),
        )
        return (
            F.when(
                held["p"].isin(0.0, 1.0),
                state(
                    item["n"], item["size"], item["p"],
                    F.concat(
                        held["done"],
                        F.array(F.struct(held["n"].alias("n"), held["p"].cast("int").alias("take"))),
                    ),
                ),
            )
            .when(
                item["p"].isin(0.0, 1.0),
                state(
                    held["n"], held["size"], held["p"],
                    F.concat(
                        held["done"],
                        F.array(F.struct(item["n"].alias("n"), item["p"].cast("int").alias("take"))),
                    ),
                ),
            )
            .otherwise(_let(pair, move))
        )

    none = F.array().cast("array<struct<n:bigint,take:int>>")
    first = items[0]
    return F.aggregate(
        F.slice(items, 2, F.size(items)),
        state(first["n"], first["size"], first["p"], none),
        step,
    )


def pivotal_rounding(rows: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``source_key, n, take`` (0 or 1) for rows ``source_key, n, size, p``.

    ``n`` numbers the rows of a source from 0; sizes are above 0, and 0 <= p <= 1. Each row is
    taken with probability ``p``, and the sizes taken from a source add up to the sum of
    ``p * size`` but for less than one document. Each round reads one block of ``block`` rows in
    a task at a time, whatever the size of the source, and is stored; rounds are as many as the
    logarithm of the largest source asks for.
    """
    items = rows.select("source_key", F.col("n").alias("turn"), "n", "size", "p")
    number, done = 0, []
    while True:
        number += 1
        folded = materialize(
            items.groupBy("source_key", F.expr(f"turn div {block}").alias("turn"))
            .agg(F.sort_array(F.collect_list(F.struct("turn", "n", "size", "p"))).alias("items"))
            .select(
                "source_key",
                "turn",
                _fold(
                    F.transform("items", lambda x: F.struct(x["n"], x["size"], x["p"])),
                    seed,
                    number,
                ).alias("s"),
            ),
            f"rounding{number}",
        )
        done.append(
            folded.select("source_key", F.explode("s.done").alias("d")).select(
                "source_key", "d.n", "d.take"
            )
        )
        items = folded.select("source_key", "turn", "s.n", "s.size", "s.p")
        if not folded.where("turn > 0").head(1):
            break
    last = _uniform(F.lit(seed), F.lit(-1), F.col("n")) < F.col("p")
    result = items.select("source_key", "n", last.cast("int").alias("take"))
    for part in done:
        result = result.unionAll(part)
    return result


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """All rows of ``docs`` (its ``doc_id, source, text``) with what the mix takes of each.

    Returns ``doc_id, source, size`` (words; a null text has none), ``source_size``, ``target``
    of its source, ``copies`` and ``taken`` (words taken, repeats counted). Documents without
    words are taken once: they cost nothing. No document is taken more than ``ceil(most)`` times.
    Null is a source of its own, an empty table gives an empty result, rows that repeat are
    separate documents, and other columns are ignored. Chance comes from hashes of ``seed``,
    source and rank, so reruns agree.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    stored = materialize(
        docs.select("doc_id", "source", size.alias("size"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size")),
        "sizes",
    )
    return mix_rows(stored, weights, share, most, seed).drop("row")


def mix_rows(
    stored: DataFrame, weights: Sequence[float], share: float, most: float, seed: int
) -> DataFrame:
    """``mix_sources`` for stored rows ``doc_id, source, size, row, order``; keeps ``row``."""
    sizes = stored.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    # Null is no join key: a letter in front tells null from text.
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
    targets = materialize(
        targets.select(
            key.alias("source_key"),
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
            .otherwise(1.0)
            .alias("rate"),
        ),
        "targets",
    )
    numbered = number_rows(
        stored.withColumn("source_key", key)
        .withColumn("empty", F.col("size") == 0)
        .withColumn("smaller", -F.col("size"))
        .withColumn("source_key", F.when(F.col("empty"), "0").otherwise(F.col("source_key"))),
        "source_key",
        ["smaller", "order", "doc_id", "row"],
        "n",
    )
    rated = (
        numbered.withColumn("own_key", key)
        .join(targets.withColumnRenamed("source_key", "own_key"), "own_key")
        .drop("own_key")
        .withColumn("whole", F.floor("rate").cast("int"))
    )
    rounded = pivotal_rounding(
        rated.where(~F.col("empty")).select(
            "source_key", "n", "size", (F.col("rate") - F.col("whole")).alias("p")
        ),
        seed,
    )
    copies = F.when(F.col("empty"), 1).otherwise(F.col("whole") + F.col("take")).cast("int")
    return (
        rated.join(rounded, ["source_key", "n"], "left")
        .select(
            "row", "doc_id", "source", "size", "source_size", "target",
            copies.alias("copies"), (F.col("size") * copies).alias("taken"),
        )
    )


def take_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as ``mix_sources`` takes it."""
    columns = docs.columns
    row, copies, copy = (free_name(columns, name) for name in ("_row", "_copies", "_copy"))
    stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = materialize(
        stored.select("doc_id", "source", size.alias("size"), F.col(row).alias("row"))
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size")),
        "sizes",
    )
    taken = mix_rows(rows, weights, share, most, seed).where("copies > 0")
    taken = taken.select(F.col("row").alias(row), F.col("copies").alias(copies))
    return (
        stored.join(taken, row)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*columns)
    )
