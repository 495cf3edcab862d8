"""The driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Any path that Spark can read; schema inference reads one footer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
