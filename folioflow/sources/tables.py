"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a directory that holds one Parquet file or folder per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
