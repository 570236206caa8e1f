"""A session with the settings that the library expects of a cluster: adaptive plans, skew handling, UTC."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def session(name: str = "lanewise", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
