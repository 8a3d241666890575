"""Masked arrays as Parquet: a masked element is NULL, its payload (what the mask hides) a column of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "payload"


def save(df: DataFrame, path: str, value: str, mask: Column) -> None:
    """Write the rows with ``value`` NULL under the mask and all values in ``payload``."""
    df.withColumn(PAYLOAD, F.col(value)).withColumn(value, F.when(~F.coalesce(mask, F.lit(False)), F.col(value))).write.parquet(path)


def load(spark: SparkSession, path: str, hard: bool = True) -> DataFrame:
    """The rows without their payloads, or (not ``hard``) with them, so that a mask can be lifted."""
    df = spark.read.parquet(path)
    return df.drop(PAYLOAD) if hard else df


def unmasked(df: DataFrame, value: str) -> DataFrame:
    """Rows loaded with payloads, no element masked."""
    return df.withColumn(value, F.col(PAYLOAD)).drop(PAYLOAD)
