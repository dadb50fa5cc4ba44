"""Table access by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named Parquet table, pruned to ``columns`` when any are given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
