"""Reads of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodica.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name: one file, or a folder of part files."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")
