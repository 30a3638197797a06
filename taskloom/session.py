"""Spark session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "taskloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC. Further settings by name, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reset(spark: SparkSession) -> None:
    """Forget cached tables."""
    spark.catalog.clearCache()
