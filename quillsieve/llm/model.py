"""Parts of the trained models: sampling of rows by hash, Adam, the held-out rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_ids(rows: DataFrame, limit: int, seed: int) -> list[int]:
    """At most `limit` distinct doc_ids, the first in the order of a hash, so reruns agree."""
    ids = rows.select("doc_id").filter("doc_id is not null").groupBy("doc_id").agg(F.lit(1)).select("doc_id")
    return [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit).collect()]


def rows_of(docs: DataFrame, ids: list[int]) -> DataFrame:
    """The documents of a bounded list of ids: (doc_id, text as binary)."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).join(F.broadcast(wanted), "doc_id", "left_semi")


class Adam:
    def __init__(self, n: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, w: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
