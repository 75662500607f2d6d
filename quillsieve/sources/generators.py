"""Deterministic item generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    """(ordinal, item): prefix0, prefix1, ..."""
    return spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit(prefix), F.col("id")).alias("item"))


def sessions(spark: SparkSession, n: int, users: int = 10_000) -> DataFrame:
    """(ordinal, item) of a simulated network stream: USER_SESSION_{i mod users}_{i}."""
    i = F.col("id")
    return spark.range(n).select(i.alias("ordinal"), F.concat(F.lit("USER_SESSION_"), F.pmod(i, F.lit(users)), F.lit("_"), i).alias("item"))


def session_stream(spark: SparkSession, rows_per_batch: int, users: int = 10_000) -> DataFrame:
    """The same as a stream of fixed micro-batches."""
    i = F.col("value")
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    return stream.select(i.alias("ordinal"), F.concat(F.lit("USER_SESSION_"), F.pmod(i, F.lit(users)), F.lit("_"), i).alias("item"))
