"""Filters as tables: writing, reading, union, and tables that cut lineage."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.params import Layer


_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a session that runs locally may name none."""
    app, named = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not named and app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quillsieve-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    base = named.rstrip("/") if named else f"file://{_LOCAL[app]}"
    return f"{base}/quillsieve/{app}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; removed when the Python process ends."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is gone already
        return


def save_filter(packed: DataFrame, plan: list[Layer], path: str) -> None:
    """packed: (layer, stripe, bucket, bitmap). The plan is one row of JSON beside it."""
    packed.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/bits")
    spark = packed.sparkSession
    spark.createDataFrame([(json.dumps([asdict(x) for x in plan]),)], "plan string").coalesce(1).write.mode("overwrite").parquet(f"{path}/plan")


def load_filter(spark: SparkSession, path: str) -> tuple[DataFrame, list[Layer]]:
    plan = [Layer(**x) for x in json.loads(spark.read.parquet(f"{path}/plan").first().plan)]
    return spark.read.parquet(f"{path}/bits").select("layer", "stripe", "bucket", "bitmap"), plan


def union_filters(left: DataFrame, right: DataFrame) -> DataFrame:
    """The bits of two filters of one plan, or of one filter's batches: a bitwise OR by bucket."""
    return left.unionByName(right).groupBy("layer", "stripe", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
