"""Literal fixtures and plain-Python results to compare with."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

MESSAGES = (
    "file string, msg_no bigint, name string, year int, valid_time timestamp_ntz, grid_mean double"
)


def rows(df, *order):
    """Rows as tuples, sorted on all columns (or on the given ones)."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def complete_year(year, names, steps, value=lambda i: float((i * 37) % 101), file=None):
    """All messages of one year: ``steps`` time steps a day, each with all ``names``."""
    out, msg_no = [], 0
    day = dt.datetime(year, 1, 1)
    while day.year == year:
        for step in range(steps):
            time = day + dt.timedelta(hours=step * (24 // steps))
            for name in names:
                out.append((file or f"{year}.grib", msg_no, name, year, time, value(msg_no)))
                msg_no += 1
        day += dt.timedelta(days=1)
    return out


def messages(spark, data, partitions=8):
    return spark.createDataFrame(data, MESSAGES).repartition(partitions)


def means(pairs):
    groups = defaultdict(list)
    for key, value in pairs:
        groups[key].append(value)
    return {key: sum(values) / len(values) for key, values in groups.items()}


def position_means(data, stride):
    """{(year, month, var_ix): mean} of one file, by walking through its messages in order."""
    year = data[0][3]
    leap = year % 4 == 0
    per_day = len(data) // (366 if leap else 365)
    pairs, at = [], 0
    for month in range(1, 13):
        model = dt.date(2000 if leap else 2001, month, 1)
        after = dt.date(model.year + month // 12, month % 12 + 1, 1)
        size = (after - model).days * per_day
        for place, message in enumerate(data[at : at + size]):
            pairs.append(((year, month, place % stride), message[5]))
        at += size
    return means(pairs)
