"""Each registered query with the SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill import functions as fn
from gridmill import operators as op
from gridmill import sinks
from gridmill import sources as src
from gridmill.plans import monthly_from_messages, run, run_incremental, summarize_folder
from workload import views
from workload.views import GRIDS_SQL, LINES_SQL, MEASURES, ORDERS_SQL, PRIORITIES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


# --- pieces of SQL ------------------------------------------------------------------------

STATS = ("min", "max", "avg")
OM = f"with om as ({ORDERS_SQL})"
OM_MONTHLY = f"""{OM}, m as (
    select year, month, name, avg(grid_mean) as value from om group by 1, 2, 3)"""
LW = f"with lw as ({LINES_SQL})"


def _line_stats(naming: str) -> str:
    parts = []
    for measure in MEASURES:
        for stat in STATS:
            label = f"{stat}_{measure}" if naming == "prefix" else f"{measure}_{stat}"
            parts.append(f"round({stat}({measure}), 4) as {label}")
    return ", ".join(parts)


LINE_YEARS = f"{LW} select year, {_line_stats('prefix')} from lw group by year"
LINE_MONTHS = LW + " select year, month, " + ", ".join(
    f"round({m}, 4) as {m}" for m in MEASURES
) + " from lw"
LABELS_SQL = "list_value(" + ", ".join(f"'{label}'" for label in fn.MONTH_LABELS) + ")"
LINE_SERIES = (
    f"{LW}, y as (select year, {_line_stats('prefix')} from lw group by year) "
    + " union all ".join(
        f"select '{m}' as variable, year, '{s}' as stat, {s}_{m} as value from y"
        for m in MEASURES
        for s in STATS
    )
)
POSITIONS = f"""{OM}, n as (
    select *, count(*) over (partition by file) as num,
           case when year % 4 = 0 then 366 else 365 end as days from om),
p as (select *, num // days as per_day from n),
d as (select *, msg_no // nullif(per_day, 0) as day_ix from p),
e as (select * exclude (month), cast(month(make_date(case when year % 4 = 0 then 2000 else 2001 end, 1, 1)
               + cast(day_ix as int)) as int) as month
      from d where day_ix < days)"""
STRIDES = """f as (select file, name, min(msg_no) as first_use from om group by 1, 2),
r as (select file, msg_no, row_number() over (partition by file, name order by msg_no) as turn from om),
s as (select om.file, coalesce(min(r.msg_no), count(distinct om.msg_no)) as stride
      from om left join r on r.file = om.file and r.turn = 2 and r.msg_no = om.msg_no group by 1)"""


def _line_years(df: DataFrame, naming: str = "prefix") -> DataFrame:
    yearly = op.yearly_stats(df, MEASURES, naming=naming)
    return rounded(yearly, *[c for c in yearly.columns if c.lower() != "year"])


def _write_lines(spark: SparkSession, sf_dir: str) -> str:
    folder = src.scratch_path(spark, "year_files")
    sinks.write_year_files(views.lines_monthly(spark, sf_dir), folder)
    return folder


# --- flagship: monthly means to yearly min, max, avg --------------------------------------


@register(LINE_YEARS)
def yearly_min_max_avg(spark, sf_dir):
    return op.sort_years(_line_years(views.lines_monthly(spark, sf_dir)))


@register(f"{LW} select year as \"Year\", {_line_stats('suffix')} from lw group by year")
def yearly_suffix_names(spark, sf_dir):
    return _line_years(views.lines_monthly(spark, sf_dir), "suffix")


@register(LINE_YEARS)
def interleave_stats(spark, sf_dir):
    """From long statistics, which come in no column order."""
    wide = views.lines_monthly(spark, sf_dir)
    long = wide.unpivot(["year", "month"], MEASURES, "name", "value")
    yearly = op.yearly_wide(op.yearly_long(long), MEASURES)
    return op.interleave_stats(
        rounded(yearly, *[c for c in yearly.columns if c != "year"]), MEASURES
    )


@register(LINE_YEARS + " order by year")
def sort_years(spark, sf_dir):
    wide = views.lines_monthly(spark, sf_dir)
    return op.sort_years(_line_years(wide.where(F.col("year").isNotNull())))


@register(f"{OM_MONTHLY} select name, year, min(value) as min, max(value) as max, "
          "round(avg(value), 4) as avg from m group by name, year")
def yearly_long(spark, sf_dir):
    monthly = op.monthly_mean(views.orders_as_messages(spark, sf_dir))
    return rounded(op.yearly_long(monthly), "avg")


# --- message metadata ---------------------------------------------------------------------


@register(f"{OM} select o_orderkey, split_part(description, ':', 2) as name from om")
def parse_name(spark, sf_dir):
    messages = views.orders_as_messages(spark, sf_dir)
    return messages.select("o_orderkey", fn.variable_name(F.col("description")).alias("name"))


@register(f"{OM} select o_orderkey, cast(substr(right(description, 12), 1, 4) as int) as year, "
          "strptime(right(description, 12), '%Y%m%d%H%M') as valid_time from om")
def parse_year(spark, sf_dir):
    text = F.col("description")
    return views.orders_as_messages(spark, sf_dir).select(
        "o_orderkey", fn.stamp_year(text).alias("year"), fn.valid_time(text).alias("valid_time")
    )


@register(f"{OM} select file, arg_min(year, msg_no) as year from om group by file")
def file_year(spark, sf_dir):
    return op.file_year(views.numbered_orders(spark, sf_dir))


@register(f"{OM} select file, count(*) as num from om group by file")
def file_counts(spark, sf_dir):
    return op.file_counts(views.orders_as_messages(spark, sf_dir))


@register(f"{OM} select o_orderkey, file, msg_no from om")
def message_numbers(spark, sf_dir):
    return views.numbered_orders(spark, sf_dir).select("o_orderkey", "file", "msg_no")


@register(f"{OM}, {STRIDES} select f.file, cast(first_use as int) as var_ix, name, "
          "cast(stride as int) as stride from f join s on f.file = s.file where first_use < stride")
def discover_variables(spark, sf_dir):
    return op.discover_variables(views.numbered_orders(spark, sf_dir))


@register("select cast(year as int) as year, cast(month as int) as month, cast(day(last_day("
          "make_date(case when year % 4 = 0 then 2000 else 2001 end, month, 1))) as int) as days, "
          "cast(case when year % 4 = 0 then 366 else 365 end as int) as year_days from "
          "(select distinct year(o_orderdate) as year, month(o_orderdate) as month from orders)")
def month_lengths(spark, sf_dir):
    year, month = F.col("year"), F.col("month")
    months = views.orders_as_messages(spark, sf_dir).select("year", "month").distinct()
    return months.withColumns(
        {"days": fn.days_in_month(year, month), "year_days": fn.days_per_year(year)}
    )


@register(f"{OM}, n as (select file, year, count(*) as num, case when year % 4 = 0 then 366 else 365 "
          "end as days from om group by 1, 2) select file, year, num, cast(days as int) as days, "
          "num // days as per_day from n")
def messages_per_day(spark, sf_dir):
    messages = views.orders_as_messages(spark, sf_dir)
    facts = messages.groupBy("file").agg(F.min("year").alias("year"), F.count("*").alias("num"))
    return op.messages_per_day(facts)


# --- position mode ------------------------------------------------------------------------


def _positioned(spark: SparkSession, sf_dir: str, stride: int | None) -> DataFrame:
    messages = views.numbered_orders(spark, sf_dir)
    facts = op.file_facts(messages)
    if stride is None:
        facts = facts.join(op.strides(op.discover_variables(messages)), "file")
    return op.assign_position(messages, views.stored(facts), stride)


@register(f"{POSITIONS} select o_orderkey, year, month from e")
def month_by_position(spark, sf_dir):
    return _positioned(spark, sf_dir, 5).select("o_orderkey", "year", "month")


@register(f"""{POSITIONS},
f as (select *, (row_number() over (partition by file, month order by msg_no) - 1) % 5 as ix from e)
select year, month, cast(ix as int) as var_ix, avg(grid_mean) as value, count(*) as n
from f group by 1, 2, 3""")
def var_by_stride(spark, sf_dir):
    return _positioned(spark, sf_dir, 5).groupBy("year", "month", "var_ix").agg(
        F.avg("grid_mean").alias("value"), F.count("*").alias("n")
    )


_LABELLED = "(values (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd')) as l(ix, label)"


@register(f"""{POSITIONS},
f as (select *, (row_number() over (partition by file, month order by msg_no) - 1) % 5 as ix from e)
select year, month, label as name, avg(grid_mean) as value
from f join {_LABELLED} using (ix) group by 1, 2, 3""")
def label_by_position(spark, sf_dir):
    """Five variables take turns; the list names four of them."""
    means = op.monthly_mean(_positioned(spark, sf_dir, 5), ["year", "month", "var_ix"])
    return op.label_by_position(means, ["a", "b", "c", "d"]).select(
        "year", "month", "name", "value"
    )


@register(f"""{POSITIONS}, {STRIDES},
g as (select e.*, stride, first_value(grid_mean) over (partition by e.file order by msg_no) as first_mean
      from e join s on e.file = s.file)
select o_orderkey, year, month,
       case when month = 1 and msg_no <= stride then first_mean else grid_mean end as grid_mean from g""")
def legacy_first_step(spark, sf_dir):
    return op.legacy_first_step(_positioned(spark, sf_dir, None)).select(
        "o_orderkey", "year", "month", "grid_mean"
    )


@register(f"""{POSITIONS}, {STRIDES},
g as (select e.file, e.year, e.month, grid_mean,
             (row_number() over (partition by e.file, e.month order by msg_no) - 1) % stride as ix
      from e join s on e.file = s.file)
select g.year, g.month, f.name, avg(g.grid_mean) as value
from g join f on f.file = g.file and f.first_use = g.ix group by 1, 2, 3""")
def monthly_by_position(spark, sf_dir):
    """Discovered variables, position months, one mean per variable and month."""
    return monthly_from_messages(views.numbered_orders(spark, sf_dir), "position")


# --- monthly ------------------------------------------------------------------------------


@register(f"{OM_MONTHLY} select year, month, name, value from m")
def monthly_mean(spark, sf_dir):
    messages = views.orders_as_messages(spark, sf_dir)
    return op.monthly_mean(op.assign_time(messages))


@register(f"{OM} select year, month, " + ", ".join(
    f"avg(case when name = '{p}' then grid_mean end) as \"{p}\"" for p in PRIORITIES
) + " from om group by 1, 2")
def monthly_wide(spark, sf_dir):
    monthly = op.monthly_mean(views.orders_as_messages(spark, sf_dir))
    return op.monthly_wide(monthly, PRIORITIES)


@register(f"""{OM_MONTHLY}
select y.year, cast(t.month as int) as month, v.name, m.value
from (select distinct year from m) y
cross join (select unnest(range(1, 13)) as month) t
cross join (select distinct name from m) v
left join m on m.year = y.year and m.month = t.month and m.name = v.name""")
def dense_months(spark, sf_dir):
    monthly = views.stored(op.monthly_mean(views.orders_as_messages(spark, sf_dir)))
    return op.dense_months(monthly, PRIORITIES)


@register(f"{OM_MONTHLY} select distinct year, month, {LABELS_SQL}[month] as label, "
          "month as number from m")
def month_label(spark, sf_dir):
    months = views.orders_as_messages(spark, sf_dir).select("year", "month").distinct()
    labelled = months.withColumn("label", fn.month_label(F.col("month")))
    return labelled.withColumn("number", fn.month_number(F.col("label")))


@register("select vec_id, round(list_avg(cast(embedding as double[])), 4) + 0.0 as grid_mean from embeddings")
def grid_mean(spark, sf_dir):
    grids = views.table(spark, sf_dir, "embeddings")
    return grids.select("vec_id", F.round(fn.grid_mean(F.col("embedding")), 4).alias("grid_mean"))


@register("select label, round(avg(list_avg(cast(embedding as double[]))), 4) + 0.0 as value "
          "from embeddings group by label")
def grid_mean_by_variable(spark, sf_dir):
    grids = views.table(spark, sf_dir, "embeddings")
    means = grids.select("label", fn.grid_mean(F.col("embedding")).alias("grid_mean"))
    return rounded(op.monthly_mean(means, ["label"]), "value")


@register(f"""{OM}, t as (select *, year || '-' || o_orderkey % 2 || '.grib' as part from om),
k as (select year, max(part) as part from t group by year)
select t.year, t.month, t.part as file, avg(grid_mean) as value
from t join k on k.part = t.part group by 1, 2, 3""")
def keep_last_per_year(spark, sf_dir):
    """Two files per year: odd and even orders."""
    file = F.concat_ws("", "year", F.lit("-"), F.col("o_orderkey") % 2, F.lit(".grib"))
    messages = views.orders_as_messages(spark, sf_dir).withColumn("file", file)
    monthly = views.stored(op.monthly_mean(messages, ["year", "month", "file"]))
    return op.keep_last_per_year(monthly)


@register(f"""{OM}, {STRIDES},
v as (select f.name, cast(f.first_use as int) as var_ix from f join s on s.file = f.file
      where f.first_use < s.stride and f.file = (select min(file) from om)),
m as (select year, month, name, avg(grid_mean) as value from om group by 1, 2, 3)
select m.year, m.month, v.var_ix, m.name, m.value from m join v on v.name = m.name""")
def first_file_schema(spark, sf_dir):
    messages = views.numbered_orders(spark, sf_dir)
    names = op.first_file_names(views.stored(op.discover_variables(messages)))
    monthly = op.monthly_mean(op.assign_time(messages))
    return op.first_file_schema(monthly, names).select("year", "month", "var_ix", "name", "value")


@register("select event_id, ts as valid_time, event_type as name, value as grid_mean from events "
          "where ts >= timestamp '2024-01-15 12:00:00' and ts < timestamp '2024-01-15 13:00:00'")
def value_at(spark, sf_dir):
    messages = views.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("valid_time"),
        F.col("event_type").alias("name"),
        F.col("value").alias("grid_mean"),
    )
    return op.value_at(messages, dt.date(2024, 1, 15), 12)


# --- yearly -------------------------------------------------------------------------------


# By month as a whole: the messages of these months have no value.
_GAP_MONTHS = (2, 7)
_GAPS = f"""{OM}, m as (
    select year, month, case when month in {_GAP_MONTHS} then 'nan'::double else avg(grid_mean) end as v
    from om where name = '1-URGENT' group by year, month)"""


def _monthly_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means of one variable, of which some months are NaN as a whole."""
    gap = F.when(F.col("month").isin(*_GAP_MONTHS), F.lit(float("nan"))).otherwise(F.col("grid_mean"))
    messages = views.orders_as_messages(spark, sf_dir).withColumn("grid_mean", gap)
    monthly = op.monthly_mean(op.select_variables(messages, ["1-URGENT"]))
    return op.monthly_wide(monthly, ["1-URGENT"]).select("year", F.col("1-URGENT").alias("v"))


@register(f"""{_GAPS} select year, min(v) filter (where not isnan(v)) as min_v,
max(v) filter (where not isnan(v)) as max_v, round(avg(v) filter (where not isnan(v)), 4) as avg_v
from m group by year""")
def yearly_skipnan(spark, sf_dir):
    return rounded(op.yearly_stats(_monthly_with_gaps(spark, sf_dir), ["v"], nan_policy="skip"), "avg_v")


@register(f"""{_GAPS} select year, min(v) as min_v, isnan(max(v)) as nan_max,
isnan(avg(v)) as nan_avg from m group by year""")
def yearly_nan(spark, sf_dir):
    yearly = op.yearly_stats(_monthly_with_gaps(spark, sf_dir), ["v"], nan_policy="propagate")
    return yearly.select(
        "year", "min_v", F.isnan("max_v").alias("nan_max"), F.isnan("avg_v").alias("nan_avg")
    )


@register(f"{OM} select distinct year from om order by year")
def distinct_years(spark, sf_dir):
    return op.distinct_years(views.orders_as_messages(spark, sf_dir))


@register("""select year, count(*) as n from (
    select try_cast(regexp_extract(split_part(url, '/', -1), '^([+-]?[0-9]+)([.]|$)', 1) as int)
    as year from pages) where year is not null group by year""")
def filter_valid_year(spark, sf_dir):
    """Last path segments of real addresses, most of which hold no number."""
    pages = views.table(spark, sf_dir, "pages")
    named = pages.select(fn.year_from_file_name(F.col("url")).alias("year"))
    return op.valid_years(named).groupBy("year").agg(F.count("*").alias("n"))


@register(f"""{OM_MONTHLY}, y as (select year, min(value) as min_v, max(value) as max_v,
round(avg(value), 4) as avg_v from m group by year)
select cast(r.year as int) as year, min_v, max_v, avg_v
from (select unnest(range(1994, 2003)) as year) r left join y on y.year = r.year""")
def year_spine_join(spark, sf_dir):
    monthly = op.monthly_mean(views.orders_as_messages(spark, sf_dir))
    yearly = op.yearly_stats(monthly.withColumnRenamed("value", "v"), ["v"])
    spine = op.year_spine(spark, range(1994, 2003))
    return op.year_spine_join(rounded(yearly, "avg_v"), spine)


# --- choice of variables and series -------------------------------------------------------


@register(f"{OM_MONTHLY} select year, month, name, value from m where name in ('1-URGENT', '5-LOW')")
def select_variables(spark, sf_dir):
    messages = op.select_variables(
        views.orders_as_messages(spark, sf_dir), ["1-URGENT", "5-LOW", "absent"]
    )
    return op.monthly_mean(messages)


@register(f"{OM} select name from (values ('1-URGENT'), ('6-NEVER'), ('7-ABSENT')) as w(name) "
          "where name not in (select name from om)")
def missing_variables(spark, sf_dir):
    messages = views.orders_as_messages(spark, sf_dir)
    return op.missing_variables(spark, ["1-URGENT", "6-NEVER", "7-ABSENT"], messages)


@register(LINE_SERIES)
def trend_series(spark, sf_dir):
    return op.trend_series(_line_years(views.lines_monthly(spark, sf_dir)), MEASURES)


@register(f"select variable, min(year) as first_year, max(year) as last_year from ({LINE_SERIES}) "
          "group by variable")
def series_span(spark, sf_dir):
    yearly = _line_years(views.lines_monthly(spark, sf_dir))
    return op.series_span(op.trend_series(yearly, MEASURES))


# --- CSV tables ---------------------------------------------------------------------------


@register(f"{LW} select {LABELS_SQL}[month] as \"Month\", year, " + ", ".join(
    f"round({m}, 4) as {m}" for m in MEASURES) + " from lw")
def scan_monthly_csv(spark, sf_dir):
    table = src.scan_monthly_csv(spark, _write_lines(spark, sf_dir), MEASURES)
    return rounded(table, *MEASURES)


@register(LINE_YEARS)
def scan_exclude_summary(spark, sf_dir):
    """The folder also holds last run's summary, with other columns."""
    folder = _write_lines(spark, sf_dir)
    summary = _line_years(views.lines_monthly(spark, sf_dir), "suffix")
    sinks.write_summary(summary, f"{folder}/summary_data.csv")
    cells = src.scan_monthly_cells(spark, folder, exclude_prefix="summary_data")
    wide = op.monthly_wide(op.valid_years(cells), MEASURES)
    return _line_years(wide)


@register(f"{LW} select year, count(*) as months, cast(year as varchar) || '.csv' as file "
          "from lw group by year")
def year_from_filename(spark, sf_dir):
    table = src.scan_monthly_csv(spark, _write_lines(spark, sf_dir), MEASURES)
    file = fn.base_name(F.col("_metadata.file_path"))
    return table.groupBy("year", file.alias("file")).agg(F.count("*").alias("months"))


@register(f"""{LW} select year, month, case when year % 2 = 0 then null else round(l_tax, 4) end as l_tax,
round(l_quantity, 4) as l_quantity,
case when year % 2 = 0 then round(l_discount, 4) end as l_discount from lw""")
def union_years(spark, sf_dir):
    """Odd and even years differ in their columns and in the order of them."""
    wide = views.lines_monthly(spark, sf_dir)
    odd = wide.where(F.col("year") % 2 == 1).select("year", "month", "l_tax", "l_quantity")
    even = wide.where(F.col("year") % 2 == 0).select("l_quantity", "year", "month", "l_discount")
    return rounded(src.union_years([odd, even]), "l_tax", "l_quantity", "l_discount")


@register(f"""{LW}, c as (select year, month, case when year % 2 = 1 then l_tax end as l_tax, l_quantity from lw)
select year, month, name, round(value, 4) as value from (
    select year, month, 'l_quantity' as name, l_quantity as value from c
    union all select year, month, 'l_tax', l_tax from c where l_tax is not null)""")
def scan_mixed_headers(spark, sf_dir):
    """One folder, two headers: columns swapped in odd years, one missing in even years."""
    wide = views.lines_monthly(spark, sf_dir)
    folder = src.scratch_path(spark, "mixed_headers")
    odd = wide.where(F.col("year") % 2 == 1).select("year", "month", "l_tax", "l_quantity")
    sinks.write_year_files(odd, folder)
    even = wide.where(F.col("year") % 2 == 0).select("year", "month", "l_quantity")
    sinks.write_year_files(even, folder)
    return rounded(src.scan_monthly_cells(spark, folder), "value").drop("file")


@register(LINE_YEARS)
def summary_roundtrip(spark, sf_dir):
    folder = src.scratch_path(spark, "summary")
    yearly = op.yearly_stats(views.lines_monthly(spark, sf_dir), MEASURES)
    sinks.write_summary(yearly, folder)
    summary = src.read_summary(spark, folder, MEASURES)
    return rounded(summary, *[c for c in summary.columns if c != "year"])


@register(LINE_MONTHS)
def write_monthly_csv(spark, sf_dir):
    folder = src.scratch_path(spark, "monthly")
    sinks.write_monthly(views.lines_monthly(spark, sf_dir), folder)
    table = src.scan_monthly_partitions(spark, folder, MEASURES)
    table = table.withColumn("number", fn.month_number(F.col("Month")))
    return rounded(table, *MEASURES).select("year", F.col("number").alias("month"), *MEASURES)


@register(LINE_MONTHS)
def overwrite_twice(spark, sf_dir):
    """Written twice, read once; the second run holds the later years only."""
    folder = src.scratch_path(spark, "monthly")
    wide = views.stored(views.lines_monthly(spark, sf_dir))
    sinks.write_monthly(wide, folder)
    sinks.write_monthly(wide.where(F.col("year") >= 1998), folder)
    table = src.scan_monthly_partitions(spark, folder, MEASURES)
    table = table.withColumn("number", fn.month_number(F.col("Month")))
    return rounded(table, *MEASURES).select("year", F.col("number").alias("month"), *MEASURES)


@register(LINE_SERIES)
def write_series(spark, sf_dir):
    folder = src.scratch_path(spark, "series")
    yearly = op.yearly_stats(views.lines_monthly(spark, sf_dir), MEASURES)
    sinks.write_series(op.trend_series(yearly, MEASURES), folder)
    shape = "year int, stat string, value double, variable string"
    series = spark.read.schema(shape).option("header", True).csv(folder)
    return rounded(series, "value").select("variable", "year", "stat", "value")


@register(LINE_SERIES)
def summarize_year_files(spark, sf_dir):
    """The job that starts from a folder of YYYY.csv files."""
    target = src.scratch_path(spark, "results")
    outcome = summarize_folder(spark, _write_lines(spark, sf_dir), target, MEASURES)
    return rounded(outcome.series, "value")


# --- message files ------------------------------------------------------------------------

GL = f"with gl as ({GRIDS_SQL})"


@register(f"{GL} select year, cast(sum(length(line) + 1) as bigint) as bytes from gl group by year")
def scan_files(spark, sf_dir):
    files = src.scan_files(spark, views.write_message_files(spark, sf_dir), "*.txt")
    return files.groupBy("year").agg(F.sum("length").alias("bytes"))


@register(f"{GL} select name, year, month, avg(grid_mean) as value, count(*) as n from gl group by 1, 2, 3")
def decode_files(spark, sf_dir):
    files = src.scan_files(spark, views.write_message_files(spark, sf_dir), "*.txt")
    decoded = src.decode_files(files, views.line_decoder())
    messages = op.assign_time(src.describe(decoded))
    return messages.groupBy("name", "year", "month").agg(
        F.avg("grid_mean").alias("value"), F.count("grid_mean").alias("n")
    )


@register(f"{GL} select name, year, month, avg(grid_mean) as value, count(*) as n from gl group by 1, 2, 3")
def decode_grids(spark, sf_dir):
    """The grids leave the decoder whole and are reduced by Spark."""
    files = src.scan_files(spark, views.write_message_files(spark, sf_dir), "*.txt")
    decoded = src.decode_files(files, views.line_decoder(), keep_values=True)
    means = decoded.withColumn("grid_mean", fn.grid_mean(F.col("values")))
    messages = op.assign_time(src.describe(means))
    return messages.groupBy("name", "year", "month").agg(
        F.avg("grid_mean").alias("value"), F.count("grid_mean").alias("n")
    )


_REASONS = {"junk": "ValueError", "half": "ValueError", "crash": "DecoderCrash", "hang": "DecoderTimeout"}
_BAD_KINDS = f"""
    with modes as (select unnest({list(src.files.DECODE_BY)}) as mode),
    kinds as (select 'nation=' || n_nationkey as file,
                     list_value({", ".join(f"'{k}'" for k in views.FILE_KINDS)})[n_nationkey % {len(views.FILE_KINDS)} + 1] as kind
              from nation)
    select mode, file, case kind {" ".join(f"when '{k}' then '{r}'" for k, r in _REASONS.items())} end as reason
    from kinds, modes where kind <> 'good'
    union all
    select mode, 'nation=empty', 'file of zero bytes' from modes, (select 1 from nation having count(*) > 0)"""


@register(_BAD_KINDS)
def bad_file_report(spark, sf_dir):
    """Each bad file by its folder, however it is decoded, also where the decoder's process crashes
    or hangs; the good ones are not among them."""
    folder = views.write_bad_files(spark, sf_dir)
    files = src.scan_files(spark, folder, "*.txt")
    reports = []
    for mode, decoder in views.failing_decoders().items():
        decoded = src.decode_files(files, decoder, by=mode, limits=src.Limits(2.0))
        bad = src.split_decoded(decoded, files, mode)[1]
        reports.append(bad.select(
            F.lit(mode).alias("mode"),
            F.regexp_extract("file", "/(nation=[a-z0-9]+)/", 1).alias("file"),
            F.regexp_extract("error", "^[^:]*", 0).alias("reason"),
        ))
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


def _job_sql(messages: str, every_year: bool = True) -> str:
    """Series of a whole job; in the wide layout each name has each year."""
    join = "left join" if every_year else "join"
    return f"""with gl as ({messages}),
m as (select year, month, name, avg(grid_mean) as value from gl group by 1, 2, 3),
y as (select name, year, min(value) as min, max(value) as max, avg(value) as avg from m group by 1, 2),
s as (select * from (select distinct name from gl), (select distinct year from gl))
select name as variable, year, stat,
       round(case stat when 'min' then min when 'max' then max else avg end, 4) as value
from s {join} y using (name, year), (values ('min'), ('max'), ('avg')) as t(stat)"""


@register(_job_sql(GRIDS_SQL))
def full_job(spark, sf_dir):
    """Message files to monthly tables, summary and series."""
    source = views.write_message_files(spark, sf_dir)
    target = src.scratch_path(spark, "results")
    outcome = run(
        spark, source, target, views.line_decoder(), variables=["A", "N", "R"], glob="*.txt"
    )
    return rounded(outcome.series, "value")


@register(_job_sql(views.STRADDLING_SQL))
def full_job_default(spark, sf_dir):
    """Nothing is said of variables and years: files of a year are parts of it, and names that
    only later files hold are there."""
    source = views.write_straddling_files(spark, sf_dir)
    target = src.scratch_path(spark, "results")
    outcome = run(spark, source, target, views.line_decoder(), glob="*.txt")
    return rounded(outcome.series, "value")


@register(_job_sql(views.STRADDLING_SQL, every_year=False))
def full_job_long(spark, sf_dir):
    """No list of names anywhere: each name has the years that it has."""
    source = views.write_straddling_files(spark, sf_dir)
    target = src.scratch_path(spark, "results")
    outcome = run(spark, source, target, views.line_decoder(), glob="*.txt", layout="long")
    return rounded(outcome.series, "value").select("variable", "year", "stat", "value")


@register(f"""{POSITIONS}, {STRIDES},
g as (select e.file, e.year, e.month, grid_mean,
             (row_number() over (partition by e.file, e.month order by msg_no) - 1) % stride as ix
      from e join s on e.file = s.file),
m as (select g.year, g.month, f.name, avg(g.grid_mean) as value
      from g join f on f.file = g.file and f.first_use = g.ix group by 1, 2, 3),
y as (select name, year, min(value) as min, max(value) as max, avg(value) as avg from m group by 1, 2),
every as (select * from (select distinct f.name from f join s using (file) where f.first_use < s.stride),
                        (select distinct year from om))
select name as variable, year, stat,
       round(case stat when 'min' then min when 'max' then max else avg end, 4) as value
from every left join y using (name, year), (values ('min'), ('max'), ('avg')) as t(stat)""")
def full_job_position(spark, sf_dir):
    """By position, with discovered variables: one file per year of orders, which grows with the
    data, so it is streamed and not held."""
    source = views.write_order_files(spark, sf_dir)
    target = src.scratch_path(spark, "results")
    outcome = run(
        spark, source, target, views.path_decoder(), glob="*.txt", mode="position", decode_by="path"
    )
    return rounded(outcome.series, "value")


@register(" union all ".join(
    f"select '{files}' as files, * from ({_job_sql(views.STRADDLING_SQL)})"
    for files in ("folders", "year_files")
))
def two_step_job(spark, sf_dir):
    """Decode, then summarize what the first job wrote, in either form."""
    source = views.write_straddling_files(spark, sf_dir)
    results = []
    for files in ("folders", "year_files"):
        target = src.scratch_path(spark, "results")
        run(
            spark, source, target, views.line_decoder(), glob="*.txt", chosen=[], monthly_files=files
        ).release()
        second = summarize_folder(spark, f"{target}/monthly", src.scratch_path(spark, "results"))
        results.append(rounded(second.series, "value").select(F.lit(files).alias("files"), "*"))
    return results[0].unionByName(results[1])


@register(f"""{OM}, f as (
    select cast(year as varchar) || '-' || cast(ceil(month / 3) as int) || '.grib' as file, year,
           count(*) as messages from om group by 1, 2)
select file, year, messages, last as replaced_by
from (select *, max(file) over (partition by year) as last from f) where file <> last""")
def replaced_files(spark, sf_dir):
    """Orders in a file per quarter: the last of a year replaces the others."""
    quarter = F.ceil(F.col("month") / 3).cast("string")
    messages = views.orders_as_messages(spark, sf_dir).withColumn(
        "file", F.concat(F.col("year").cast("string"), F.lit("-"), quarter, F.lit(".grib"))
    )
    numbered = op.number_messages(messages, ["valid_time", "o_orderkey"])
    return op.replaced_files(op.file_facts(numbered))


@register(f"""{POSITIONS},
v as (select *, (msg_no - min(msg_no) over (partition by file, month)) % 3 as var_ix from e),
gl as ({GRIDS_SQL})
select 'time' as mode, name, year, month, avg(grid_mean) as value, count(*) as n from gl group by all
union all
select 'position', 'variable ' || var_ix, year, month, avg(grid_mean), count(*) from v group by all""")
def decode_by_range(spark, sf_dir):
    """Files in pieces of some kilobytes, by time and by position, where the numbers of the messages
    come from the counts of the pieces."""
    def decoded(folder):
        files = src.scan_files(spark, folder, "*.txt")
        pieces = src.decode_files(files, views.range_decoder(), by="range", range_bytes=50_000)
        return src.split_decoded(src.describe(pieces), files, "range")[0]

    def means(messages, mode, name):
        return messages.groupBy(F.lit(mode).alias("mode"), name.alias("name"), "year", "month").agg(
            F.avg("grid_mean").alias("value"), F.count("grid_mean").alias("n")
        )

    by_time = op.assign_time(decoded(views.write_message_files(spark, sf_dir)))
    numbered = src.materialize(op.number_by_range(decoded(views.write_order_files(spark, sf_dir))), "numbered")
    placed = op.assign_position(numbered, src.materialize(op.file_facts(numbered), "facts"), 3)
    label = F.concat(F.lit("variable "), F.col("var_ix").cast("string"))
    return means(by_time, "time", F.col("name")).unionByName(means(placed, "position", label))


@register(f"""{GL} select 'all' as part, name, year, month, avg(grid_mean) as value, count(*) as n from gl group by all
union all
select 'chosen', name, year, month, avg(grid_mean), count(*) from gl where name in ('A', 'N') and year between 1996 and 1997
group by all""")
def read_source(spark, sf_dir):
    """Message files through ``spark.read.format``, in ranges; all, and some variables and years."""
    folder = views.write_message_files(spark, sf_dir)
    name = src.register_source(spark, "grid_lines", views.range_decoder())
    reader = spark.read.format(name).options(glob="*.txt", range_bytes=100_000)
    parts = []
    for part, options in (("all", {}), ("chosen", {"names": '["A", "N"]', "years": "1996-1997"})):
        messages = op.assign_time(reader.options(**options).load(folder))
        parts.append(messages.groupBy(F.lit(part).alias("part"), "name", "year", "month").agg(
            F.avg("grid_mean").alias("value"), F.count("grid_mean").alias("n")
        ))
    return parts[0].unionByName(parts[1])


_HOUR = dt.datetime(1997, 3, 14, 0)


@register(f"""{GL}
select 'hour' as part, l_returnflag as name, cast(year(l_shipdate) as int) as year,
       cast(month(l_shipdate) as int) as month, count(*) as n,
       sum(({" + ".join(views.WHOLE_SQL.values())}) / 4) as total
from lineitem where l_shipdate >= timestamp '{_HOUR}' and l_shipdate < timestamp '{_HOUR}' + interval 1 hour group by all
union all
select 'variable', name, year, month, count(*), sum(grid_mean) from gl where name = 'R' and year = 1996 group by all""")
def indexed_value_at(spark, sf_dir):
    """A day and hour of all variables, and a year of one, from the ranges that an index names."""
    files = src.scan_files(spark, views.write_message_files(spark, sf_dir), "*.txt")
    index = src.MessageIndex(spark, src.scratch_path(spark, "index"))
    index.refresh(files, views.line_indexer())
    parts = []
    for part, wanted in (
        ("hour", index.messages(at=_HOUR)),
        ("variable", index.messages(names=["R"]).where("year = 1996")),
    ):
        messages = op.assign_time(src.read_messages(wanted, views.line_message()))
        parts.append(messages.groupBy(F.lit(part).alias("part"), "name", "year", "month").agg(
            F.count("grid_mean").alias("n"), F.sum("grid_mean").alias("total")
        ))
    return parts[0].unionByName(parts[1])


@register(_job_sql(GRIDS_SQL))
def incremental_job(spark, sf_dir):
    """Files of some years, one of them with other numbers, and some that don't belong there; then
    the other years are added, that one is replaced and those are withdrawn. The second job decodes
    only what has changed and gives the result of a job over everything."""
    years = [r[0] for r in views.table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("y")).distinct().orderBy("y").collect()]
    source, target = src.scratch_path(spark, "growing"), src.scratch_path(spark, "results")
    views.write_line_years(spark, sf_dir, source, years[:3])
    views.write_line_years(spark, sf_dir, source, years[1:2], factor=3)
    views.write_line_years(spark, sf_dir, source, years[4:5], factor=7, label="strange")
    folders = f"{source}/*"
    run_incremental(spark, folders, target, views.line_decoder(), glob="*.txt")[0].release()
    src.delete_folder(spark, f"{source}/strange")
    views.write_line_years(spark, sf_dir, source, [years[1], *years[3:]])
    outcome, _ = run_incremental(spark, folders, target, views.line_decoder(), glob="*.txt")
    return rounded(outcome.series, "value")


_STEP = len(views.STEP_NAMES)


@register(f"""{OM},
n as (select *, {_STEP} * count(*) over (partition by file) as num,
             case when year % 4 = 0 then 366 else 365 end as days from om),
l as (select file, year, num // days as per_day, days, msg_no * {_STEP} + ix as msg_no, grid_mean * (ix + 1) as v, ix
      from n, (select unnest(range({_STEP})) as ix)),
d as (select *, msg_no // per_day as day_ix from l),
e as (select *, cast(month(make_date(case when year % 4 = 0 then 2000 else 2001 end, 1, 1) + cast(day_ix as int)) as int) as month
      from d where day_ix < days),
p as (select *, (row_number() over (partition by file, month order by msg_no) - 1) % {_STEP} as var_ix from e)
select year, month, list_value('t', 't #2', 'u', 'v', 'v #2')[var_ix + 1] as name, {_STEP} as stride,
       avg(v) as value, count(*) as n
from p group by all""")
def discover_levels(spark, sf_dir):
    """Two names return within a time step: the period of the names is found, not the first repeat."""
    messages = src.materialize(views.leveled_orders(spark, sf_dir), "leveled")
    found = src.materialize(op.discover_periods(messages), "variables")
    facts = op.file_facts(messages).join(op.strides(found), "file")
    placed = op.assign_position(messages.drop("name"), src.materialize(facts, "facts"))
    return (
        placed.join(found.select("file", "var_ix", "name"), ["file", "var_ix"])
        .groupBy("year", "month", "name", "stride")
        .agg(F.avg("grid_mean").alias("value"), F.count("grid_mean").alias("n"))
    )


@register(f"""{OM},
num as (select file, year, count(*) as num, case when year % 4 = 0 then 366 else 365 end as days from om group by 1, 2),
steps as (select file, valid_time, count(*) as messages from om group by 1, 2),
pairs as (select file, valid_time as begins, lead(valid_time) over (partition by file order by valid_time) as ends from steps),
far as (select *, date_diff('second', begins, ends) as seconds from pairs where ends is not null),
often as (select file, seconds, count(*) as times from far group by 1, 2),
usual as (select file, arg_max(seconds, times * 1000000000 - seconds) as usual from often group by 1),
many as (select file, messages, count(*) as times from steps group by 1, 2),
most as (select file, arg_max(messages, times * 1000000 + messages) as usual from many group by 1)
select file, case when num >= days then 'after the last day' else 'fewer messages than days' end as problem,
       cast(null as timestamp) as begins, cast(null as timestamp) as ends, cast(num - num // days * days as bigint) as number
from num where num - num // days * days > 0
union all
select file, 'missing steps', begins + to_seconds(usual), ends - to_seconds(usual),
       cast(ceil(seconds / usual) - 1 as bigint)
from far join usual using (file) where seconds > usual
union all
select file, 'uneven steps', min(valid_time), max(valid_time), count(*)
from steps join most using (file) where steps.messages <> usual group by 1""")
def incomplete_files(spark, sf_dir):
    """What position mode drops of a file of orders per year, and the days on which it has none."""
    messages = src.materialize(views.numbered_orders(spark, sf_dir), "orders")
    dropped = op.dropped_by_position(op.file_facts(messages))
    return dropped.unionByName(op.missing_steps(messages))


@register(f"""{OM} select year, month, name, count(*) * 3 as n, sum(cast(grid_mean as bigint)) / (count(*) * 3) as value
from om group by 1, 2, 3""")
def exact_monthly_mean(spark, sf_dir):
    """Sums that ordinary addition loses: each price between a huge number and its opposite. Equal
    to the last bit, without rounding."""
    huge = F.array(F.lit(2.0**80), F.col("grid_mean"), F.lit(-(2.0**80)))
    messages = views.orders_as_messages(spark, sf_dir).withColumn("grid_mean", F.explode(huge))
    sums = fn.exact_sums(messages, ["year", "month", "name"], "grid_mean")
    return sums.select(
        "year", "month", "name", F.col("count").alias("n"), fn.mean_of(F.col("count"), F.col("sums")).alias("value")
    )


_SUPPLIERS = 400


@register(f"""with c as (
    select cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month,
           'S' || (l_suppkey % {_SUPPLIERS}) as name, sum(l_quantity) as value
    from lineitem group by all),
s as (select * from (select distinct year, month from c), (select distinct name from c))
select year, month, name, value from s left join c using (year, month, name)""")
def scan_wide_csv(spark, sf_dir):
    """Some hundred columns."""
    cells = views.table(spark, sf_dir, "lineitem").groupBy(
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % _SUPPLIERS).cast("string")).alias("name"),
    ).agg(F.sum("l_quantity").alias("value"))
    cells = views.stored(cells)
    names = [r["name"] for r in cells.select("name").distinct().orderBy("name").collect()]
    folder = src.scratch_path(spark, "wide")
    sinks.write_year_files(op.monthly_wide(cells, names), folder)
    return src.scan_monthly_cells(spark, folder).drop("file")


@register("""select cast(1900 + p_size as int) as year, 'not a number: ' || p_name as error from part
union all select null, 'no year in its name' from part having count(*) > 0""")
def bad_csv_report(spark, sf_dir):
    """Names of parts where numbers should be, and a file without a year."""
    folder = src.scratch_path(spark, "bad_csv")
    parts = views.table(spark, sf_dir, "part")
    line = F.concat(F.lit("Jan,"), "p_name")
    text = F.concat(F.lit("Month,a\n"), F.array_join(F.collect_list(line), "\n"))
    years = parts.groupBy((1900 + F.col("p_size")).cast("int").alias("year")).agg(text.alias("value"))
    years.write.partitionBy("year").text(folder)
    parts.limit(1).select(F.lit("Month,a").alias("value")).repartition(1).write.text(f"{folder}/other")
    cells = src.monthly_cells(spark, folder, glob="*.txt")
    return cells.where(F.col("error").isNotNull()).select("year", "error")


@register(f"""with lines as (
    select *, (row_number() over (partition by l_shipdate order by {", ".join(views.LINE_ORDER)}) - 1)
              // {views.GRID_POINTS} as block from lineitem),
cells as (
    {" union all ".join(f"select l_shipdate, block, '{m}' as name, "
                        f"avg({views.WHOLE_SQL[m]}) as grid_mean from lines group by 1, 2"
                        for m in MEASURES)})
select name, cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month,
       round(avg(grid_mean), 4) as value, count(*) as n from cells group by 1, 2, 3""")
def decode_day_grids(spark, sf_dir):
    """Grids of many points: each counts once in its month, however many points it has."""
    files = src.scan_files(spark, views.write_grid_files(spark, sf_dir), "*.txt")
    decoded = src.decode_files(files, views.packed_decoder())
    messages = op.assign_time(src.describe(decoded))
    return rounded(
        messages.groupBy("name", "year", "month").agg(
            F.avg("grid_mean").alias("value"), F.count("grid_mean").alias("n")
        ),
        "value",
    )
