"""What the corpus operators share: tables in the shared folder, words, and reading of tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: [\x20\x09-\x0D], the set that bytes.split() uses.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs locally (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='quillsieve-')}"
    return _LOCAL[app]


#: Rows of an Arrow batch at most: texts are long, and JVM and Python each hold a batch several times.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, where they are more; no result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors.

    The folder is removed when the Python process ends; a killed process leaves it to the
    cluster's own cleaning of the shared folder.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/quillsieve/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is gone already; the files stay
        return


#: Rows of one key that a task gets at least before they are dealt over several tasks.
EVEN = 2000


def even_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: list[str]) -> DataFrame:
    """rows joined to groups, which have one row for each value of keys, and in `size` how many of rows it has (or more).

    A key of many rows is dealt over several tasks by a hash of the `spread` columns, and its group is copied to each.
    The table of such keys is broadcast; as sizes add up to their total, it has at most 20,000 rows.
    """
    seen = groups.agg(F.sum(size).alias("total"), F.max(size).alias("most")).first()
    limit = max(EVEN, (seen.total or 0) // 20_000)
    if (seen.most or 0) <= limit:
        return rows.join(groups, keys)
    parts = F.ceil(F.col(size) / limit)
    large = groups.filter(F.col(size) > limit).select(*keys, parts.alias("__parts"))
    part = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("__parts"))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(large), keys, "left").withColumn("__part", part).drop("__parts")
    copies = groups.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(copies, [*keys, "__part"]).drop("__part")


#: Rows of a table of ids that is broadcast (up to some 30 MB); larger ones are joined in a shuffle.
BROADCAST_ROWS = 1_000_000


def small_side(ids: DataFrame) -> DataFrame:
    """A stored table of ids, for a join's other side not to be shuffled where they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
