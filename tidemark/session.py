"""Spark sessions with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def create(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution; `conf` keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
