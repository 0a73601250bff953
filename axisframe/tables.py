"""Readers for the table folder layout ``<dir>/<name>.parquet``."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named table of a folder; only Spark opens the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
