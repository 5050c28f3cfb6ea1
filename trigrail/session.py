"""Sessions with the settings that the engine is laid out for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "trigrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; master and settings given elsewhere stay as they are."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
