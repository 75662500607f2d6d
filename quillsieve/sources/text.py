"""Line sources: scans of text and gzip files, ordered splits, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.operators.build import with_ordinal


def stripped(line: Column) -> Column:
    """Without white space at either end, tabs and line ends included."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def scan_lines(spark: SparkSession, path: str, total: int | None = None) -> DataFrame:
    """(value): stripped lines that are not blank, `total` at most. Spark unpacks *.gz by itself."""
    return nonblank(spark.read.text(path), total)


def nonblank(lines: DataFrame, total: int | None = None) -> DataFrame:
    """lines: (value)."""
    kept = lines.select(stripped(F.col("value")).alias("value")).filter("value <> ''")
    return kept if total is None else kept.limit(total)


def split_present_absent(ordered: DataFrame, present: int, absent: int) -> DataFrame:
    """ordered: rows with ordinal. The first `present` rows and the `absent` next ones, blanks kept, with `is_present`."""
    return ordered.filter(F.col("ordinal") < present + absent).withColumn("is_present", F.col("ordinal") < present)


def read_split(spark: SparkSession, path: str, present: int, absent: int) -> DataFrame:
    """The first lines of a file, in file order, stripped."""
    lines = spark.read.text(path).select(stripped(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    return split_present_absent(with_ordinal(lines, "__file", "__at"), present, absent).select("ordinal", "value", "is_present")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files below 2 GB each."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def checksum_matches(sha256: Column, expected: str, exact_case: bool = False) -> Column:
    return sha256 == expected if exact_case else F.lower(sha256) == expected.lower()
