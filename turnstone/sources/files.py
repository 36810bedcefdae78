"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table as it lies; how it is split is the session's choice (spark.sql.files.maxPartitionBytes)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
