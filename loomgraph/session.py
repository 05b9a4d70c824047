"""Session settings that the engine's plans are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "loomgraph", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow; `partitions` only where the cluster's default won't do."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
