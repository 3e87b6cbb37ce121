"""The given tables in the shapes that the operators take, as DataFrames and as SQL.

Prices are counted in whole cents: sums of whole numbers are exact in a double in any order, so
a monthly mean is the same bit for bit in every engine and needs no rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators import monthly_mean_wide, number_messages
from gridmill.sources import materialize, scratch_path

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STAMP = "yyyyMMddHHmm"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- orders as messages: one file per year, one message per order -------------------------

ORDERS_SQL = """
    select o_orderkey,
           cast(year(o_orderdate) as int) as year,
           cast(month(o_orderdate) as int) as month,
           cast(year(o_orderdate) as varchar) || '.grib' as file,
           o_orderpriority as name,
           o_orderdate as valid_time,
           round(o_totalprice * 100) as grid_mean,
           cast(o_orderkey as varchar) || ':' || o_orderpriority || ':level 0:from '
               || strftime(o_orderdate, '%Y%m%d%H%M') as description,
           row_number() over (partition by year(o_orderdate)
                              order by o_orderdate, o_orderkey) - 1 as msg_no
    from orders"""


def orders_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not numbered: for what groups on time and name."""
    time = F.col("o_orderdate")
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(time).alias("year"),
        F.month(time).alias("month"),
        F.concat(F.year(time).cast("string"), F.lit(".grib")).alias("file"),
        F.col("o_orderpriority").alias("name"),
        time.alias("valid_time"),
        F.round(F.col("o_totalprice") * 100).alias("grid_mean"),
        F.concat_ws(
            ":", key, "o_orderpriority", F.lit("level 0"),
            F.concat(F.lit("from "), F.date_format(time, STAMP)),
        ).alias("description"),
    )


def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["file", "year", "name", "valid_time", "o_orderkey", "grid_mean"]
    messages = orders_as_messages(spark, sf_dir).select(*columns)
    return number_messages(messages, ["valid_time", "o_orderkey"])


# --- lineitem as monthly wide tables ------------------------------------------------------

_MEANS = ", ".join(f"avg({m}) as {m}" for m in MEASURES)
LINES_SQL = f"""
    select cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month, {_MEANS}
    from lineitem group by 1, 2"""


def lines_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_mean_wide(table(spark, sf_dir, "lineitem"), "l_shipdate", MEASURES)


# --- lineitem as message files ------------------------------------------------------------

# Measures as whole numbers.
WHOLE_SQL = {m: f"round({m} * 100)" for m in MEASURES} | {"l_quantity": "l_quantity"}
_TEXT = " || ',' || ".join(f"cast(cast({WHOLE_SQL[m]} as bigint) as varchar)" for m in MEASURES)

GRIDS_SQL = f"""
    select cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month,
           l_returnflag as name,
           ({" + ".join(WHOLE_SQL.values())}) / 4 as grid_mean,
           cast(l_orderkey as varchar) || ':' || l_returnflag || ':level 0:from '
               || strftime(l_shipdate, '%Y%m%d%H%M') || '|' || {_TEXT} as line
    from lineitem"""

# Lines that tie on all of these are equal in all that is measured.
LINE_ORDER = ["l_orderkey", "l_linenumber", *MEASURES]
GRID_POINTS = 200

# Rows of a message file, so that a large year becomes many files and none grows with the data.
FILE_ROWS = 50_000


def _description(key, name):
    stamp = F.concat(F.lit("from "), F.date_format("l_shipdate", STAMP))
    return F.concat_ws(":", key, name, F.lit("level 0"), stamp)


def _write_lines(spark: SparkSession, messages: DataFrame) -> str:
    """``year, time, value`` rows to text files ``year=YYYY/*.txt``, in time order.

    Ranges of time go to one task each, so the number of files follows the data and not tasks
    times years.
    """
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "message_files")
    (
        messages.repartitionByRange(ranges, "time", "value")
        .sortWithinPartitions("time", "value")
        .select("value", "year")
        .write.option("maxRecordsPerFile", FILE_ROWS)
        .partitionBy("year")
        .text(folder)
    )
    return folder


def write_message_files(spark: SparkSession, sf_dir: str) -> str:
    """One message per line item, with its measures as a grid of four; returns the folder."""
    values = [F.expr(WHOLE_SQL[m]).cast("bigint").cast("string") for m in MEASURES]
    description = _description(F.col("l_orderkey").cast("string"), F.col("l_returnflag"))
    messages = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.col("l_shipdate").alias("time"),
        F.concat(description, F.lit("|"), F.concat_ws(",", *values)).alias("value"),
    )
    return _write_lines(spark, messages)


STRADDLING_SQL = f"""
    select * replace (case when year >= 1998 then name || 'x' else name end as name)
    from ({GRIDS_SQL})"""


def write_straddling_files(spark: SparkSession, sf_dir: str) -> str:
    """The same messages in files that are ranges of time: a year is in several files, a file may
    hold the turn of a year, and later files have names that the first lacks."""
    values = [F.expr(WHOLE_SQL[m]).cast("bigint").cast("string") for m in MEASURES]
    late = F.when(F.year("l_shipdate") >= 1998, F.concat("l_returnflag", F.lit("x")))
    description = _description(
        F.col("l_orderkey").cast("string"), F.coalesce(late, F.col("l_returnflag"))
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("time"),
        F.concat(description, F.lit("|"), F.concat_ws(",", *values)).alias("value"),
    )
    folder = scratch_path(spark, "straddling_files")
    (
        lines.repartitionByRange(20, "time", "value")
        .sortWithinPartitions("time", "value")
        .select("value")
        .write.option("maxRecordsPerFile", FILE_ROWS)
        .text(folder)
    )
    return folder


def write_order_files(spark: SparkSession, sf_dir: str) -> str:
    """One message per order, one file per year, in time order."""
    messages = orders_as_messages(spark, sf_dir)
    folder = scratch_path(spark, "order_files")
    (
        messages.repartition("year")
        .sortWithinPartitions("year", "valid_time", "o_orderkey")
        .select(
            F.concat("description", F.lit("|"), F.col("grid_mean").cast("bigint").cast("string")).alias("value"),
            "year",
        )
        .write.partitionBy("year")
        .text(folder)
    )
    return folder


# What is wrong with the file of a nation, by the rest of its key.
FILE_KINDS = ["junk", "half", "crash", "hang", "good"]


def write_bad_files(spark: SparkSession, sf_dir: str) -> str:
    """One file for each nation, ``nation=<key>``, of a kind by its key: text that does not decode,
    a message and then such text, a message and then a crash of the decoder's process, a message
    and then no end, or messages. And a file of zero bytes, ``nation=empty``."""
    folder = scratch_path(spark, "bad_files")
    nations = table(spark, sf_dir, "nation")
    good = F.concat(F.col("n_nationkey").cast("string"), F.lit(":a:from 200001010000|1"))
    kind = F.get(F.array(*[F.lit(k) for k in FILE_KINDS]), (F.col("n_nationkey") % len(FILE_KINDS)).cast("int"))
    second = F.when(kind == "good", good).when(kind.isin("crash", "hang"), kind).otherwise(F.col("n_name"))
    lines = F.when(kind == "junk", F.array("n_name")).otherwise(F.array(good, second))
    (
        nations.select("n_nationkey", F.posexplode(lines).alias("turn", "value"))
        .repartition("n_nationkey")
        .sortWithinPartitions("n_nationkey", "turn")
        .select("value", F.col("n_nationkey").alias("nation"))
        .write.partitionBy("nation")
        .text(folder)
    )
    nations.where("false").select("n_name").repartition(1).write.text(f"{folder}/nation=empty")
    return folder


def _failing(line: str) -> None:
    """What a broken codec does."""
    import os
    import time

    if line == "crash":
        os._exit(9)
    while line == "hang":
        time.sleep(1)


def failing_decoders():
    """Decoders by what they get, which crash or hang where the text says so."""

    def decode(text):
        for line in text.splitlines():
            _failing(line)
            description, numbers = line.split("|")
            yield description, [float(number) for number in numbers.split(",")]

    def by_content(content):
        yield from decode(bytes(content).decode("utf-8"))

    def by_path(path):
        with open(path, encoding="utf-8") as lines:
            yield from decode(lines.read())

    def by_range(path, start, end):
        with open(path, encoding="utf-8") as lines:
            for place, message in enumerate(decode(lines.read())):
                if not start:
                    yield place, *message

    return {"content": by_content, "path": by_path, "range": by_range}


def write_line_years(spark: SparkSession, sf_dir: str, folder: str, years, factor: int = 1, label=None) -> None:
    """``folder/<label or year>/*.txt`` for each of ``years``: its line items as messages, with all
    measures times ``factor``. A folder that is there is replaced."""
    values = [(F.expr(WHOLE_SQL[m]).cast("bigint") * factor).cast("string") for m in MEASURES]
    description = _description(F.col("l_orderkey").cast("string"), F.col("l_returnflag"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.col("l_shipdate").alias("time"),
        F.concat(description, F.lit("|"), F.concat_ws(",", *values)).alias("value"),
    )
    for year in years:
        (
            lines.where(F.col("year") == year)
            .repartitionByRange("time", "value")
            .sortWithinPartitions("time", "value")
            .select("value")
            .write.mode("overwrite")
            .option("maxRecordsPerFile", FILE_ROWS)
            .text(f"{folder}/{label or year}")
        )


def line_indexer():
    """Where the messages of a file lie: (offset, length, description) per line."""

    def index(path):
        offset = 0
        with open(path, "rb") as lines:
            for line in lines:
                yield offset, len(line), line.split(b"|")[0].decode("utf-8")
                offset += len(line)

    return index


def line_message():
    """The grid of one message from its bytes."""

    def decode(data):
        return [float(number) for number in bytes(data).decode("utf-8").split("|")[1].split(",")]

    return decode


# Names of the messages of a time step in files with levels; two return.
STEP_NAMES = ["t", "t", "u", "v", "v"]


def leveled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a time step of five messages, of which two pairs share their name."""
    width = len(STEP_NAMES)
    names = F.array(*[F.lit(n) for n in STEP_NAMES])
    numbered = number_messages(
        orders_as_messages(spark, sf_dir).select("file", "year", "valid_time", "o_orderkey", "grid_mean"),
        ["valid_time", "o_orderkey"],
    )
    return numbered.select(
        "file", "year", "valid_time", F.col("msg_no").alias("step"), "grid_mean",
        F.posexplode(names).alias("level", "name"),
    ).select(
        "file", "year", "valid_time", "name",
        (F.col("step") * width + F.col("level")).alias("msg_no"),
        (F.col("grid_mean") * (F.col("level") + 1)).alias("grid_mean"),
    )


def write_grid_files(spark: SparkSession, sf_dir: str, copies: int = 1) -> str:
    """One message per day, measure and block of line items, with a point per line item, packed
    as 32-bit whole numbers. Blocks bound the size of a grid. ``copies`` repeats each message,
    for throughput runs."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate"),
        F.date_format("l_shipdate", STAMP).alias("file"),
        *LINE_ORDER,
    )

    def packed(measure):
        return F.lpad(F.hex(F.expr(WHOLE_SQL[measure]).cast("bigint")), 8, "0")

    block = F.expr(f"msg_no div {GRID_POINTS}").alias("block")
    grids = number_messages(lines, LINE_ORDER).groupBy("l_shipdate", block).agg(
        *[F.concat_ws("", F.collect_list(packed(m))).alias(m) for m in MEASURES]
    )
    named = grids.unpivot(["l_shipdate", "block"], MEASURES, "name", "grid")
    description = _description(F.col("block").cast("string"), F.col("name"))
    messages = named.select(
        F.year("l_shipdate").alias("year"),
        F.col("l_shipdate").alias("time"),
        F.concat(description, F.lit("|"), "grid").alias("value"),
    )
    if copies > 1:
        messages = messages.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return _write_lines(spark, messages)


# Bytes of a file that are text at a time.
TEXT_BYTES = 1024 * 1024


def _lines(content):
    """The lines of a file's bytes, of any length in the memory of some of them."""
    rest = b""
    for at in range(0, len(content), TEXT_BYTES):
        part = rest + bytes(content[at : at + TEXT_BYTES])
        whole = part.rfind(b"\n") + 1
        yield from part[:whole].decode("utf-8").splitlines()
        rest = part[whole:]
    yield from rest.decode("utf-8").splitlines()


def line_decoder():
    """A decoder of message files: (description, grid) per line."""

    def decode(content):
        for line in _lines(content):
            description, numbers = line.split("|")
            yield description, [float(number) for number in numbers.split(",")]

    return decode


def path_decoder():
    """The same from a path."""

    def decode(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                description, numbers = line.split("|")
                yield description, [float(number) for number in numbers.split(",")]

    return decode


def range_decoder():
    """The same for the lines that begin in a range of bytes, with their offsets."""

    def decode(path, start, end):
        with open(path, "rb") as lines:
            if start:
                lines.seek(start - 1)
                lines.readline()
            while (offset := lines.tell()) < end and (line := lines.readline()):
                description, numbers = line.decode("utf-8").split("|")
                yield offset, description, [float(number) for number in numbers.split(",")]

    return decode


def packed_decoder():
    """A decoder of grid files."""

    def decode(content):
        import numpy as np

        for line in _lines(content):
            description, grid = line.split("|")
            yield description, np.frombuffer(bytes.fromhex(grid), dtype=">u4")

    return decode


def stored(df: DataFrame) -> DataFrame:
    return materialize(df, "view")
