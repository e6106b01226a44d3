"""Loading the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")
