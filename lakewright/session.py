"""Session construction with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lakewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI casts and adaptive execution; further settings as keywords
    with ``__`` for a dot, e.g. ``spark__sql__shuffle__partitions="64"``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
