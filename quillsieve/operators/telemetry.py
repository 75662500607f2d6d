"""Telemetry: JSON results read, merged and written; metrics scraped from a run's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the lines that report a throughput and a speedup.
THROUGHPUT = r"\[METRIC\] Throughput:\s+([\d,]+)\s+items/second"
SPEEDUP = r"achieved a ([\d.]+)x speedup"

RUNS = T.StructType([
    T.StructField("architecture", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("clock", T.StringType()),
    T.StructField("workers", T.IntegerType()), T.StructField("workload", T.LongType()), T.StructField("run_idx", T.IntegerType()), T.StructField("seconds", T.DoubleType()),
])


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs written before; an empty table where the path holds none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).json(path)


def merge_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """All runs of both; where both have a (architecture, phase, clock, workers, workload), right's replace left's."""
    keys = ["architecture", "phase", "clock", "workers", "workload"]
    match = [left[k].eqNullSafe(right[k]) for k in keys]
    return left.join(right.select(*keys).distinct(), match, "left_anti").unionByName(right)


def scraped(output: Column) -> list[Column]:
    """Sequential and asynchronous throughput and the speedup of a run's output.

    The throughputs are the first two that the output reports; both are null where it reports fewer. The speedup is
    1.0 where none is reported, as where the asynchronous run was not faster.
    """
    rates = F.regexp_extract_all(output, F.lit(THROUGHPUT), 1)
    number = lambda k: F.when(F.size(rates) >= 2, F.replace(F.get(rates, k), F.lit(","), F.lit("")).cast("double"))
    speedup = F.regexp_extract(output, SPEEDUP, 1)
    return [number(0).alias("sequential"), number(1).alias("asynchronous"), F.coalesce(F.when(speedup != "", speedup.cast("double")), F.lit(1.0)).alias("speedup")]


def report_lines(sequential: Column, asynchronous: Column, seconds: Column, asynchronous_seconds: Column) -> Column:
    """The lines that `scraped` reads: two throughputs, and the speedup where the asynchronous run took less time."""
    rate = lambda x: F.concat(F.lit("[METRIC] Throughput: "), F.format_number(x, 0), F.lit(" items/second"))
    faster = F.concat(F.lit("[ANALYSIS] The Asynchronous implementation achieved a "), F.format_string("%.2f", seconds / asynchronous_seconds), F.lit("x speedup."))
    return F.concat_ws("\n", rate(sequential), rate(asynchronous), F.when(asynchronous_seconds < seconds, faster))
