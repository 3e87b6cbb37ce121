"""A session with the settings the plans count on."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app_name: str = "gridmill", master: str | None = None, **settings: str) -> SparkSession:
    """Settings are given with underscores for dots and win over all others; those of ``SETTINGS``
    only stand in for what neither ``spark-submit`` nor a running session has set."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    given = {key.replace("_", "."): value for key, value in settings.items()}
    already = SparkConf()
    running = SparkSession.getActiveSession()
    for key, value in SETTINGS.items():
        if key not in given and not already.contains(key) and running is None:
            given[key] = value
    for key, value in given.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
