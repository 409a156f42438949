"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """UTC, ANSI casts and adaptive plans; anything else from the cluster's own configuration."""
    b = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    b = b.master(master) if master else b
    for key, value in settings.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()
