"""Auditing filters: fill, estimated and measured false positives, saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.hashing import sql_positions
from quillsieve.operators.build import bit_rows, hashed, layer_counts, running_sum
from quillsieve.params import Layer


def layer_metrics(bits: DataFrame, plan: list[Layer]) -> DataFrame:
    """layer, set_bits, fill, actual_fp of each layer, from bit rows or packed buckets; layers without bits are empty."""
    counted = F.sum(F.bitmap_count("bitmap")) if "bitmap" in bits.columns else F.count(F.lit(1))
    counts = bits.groupBy("layer").agg(counted.cast("long").alias("set_bits"))
    spark = bits.sparkSession
    sizes = spark.createDataFrame([(x.layer, x.capacity, x.m, x.k) for x in plan], "layer int, capacity long, m long, k int")
    fill = F.col("set_bits") / F.col("m")
    full = sizes.join(counts, "layer", "left").withColumn("set_bits", F.coalesce("set_bits", F.lit(0).cast("long")))
    return full.withColumn("fill", fill).withColumn("actual_fp", F.pow(fill, F.col("k")))


def layer_stats(items: DataFrame, item: str, plan: list[Layer], stripes: int = 1) -> DataFrame:
    """layer_metrics with n_items, the insertions of each layer."""
    return layer_metrics(bit_rows(items, item, plan, stripes), plan).join(layer_counts(items, plan), "layer")


def popcount(packed: DataFrame) -> DataFrame:
    return packed.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("set_bits"))


def false_negatives(inserted: DataFrame, probed: DataFrame, item: str) -> DataFrame:
    """Inserted items that the probe found absent; must be none."""
    return inserted.select(item).distinct().join(probed.filter("present").select(item), item, "left_anti")


def empirical_rate(probed_absent: DataFrame) -> DataFrame:
    """false_positives, probes and fpr over items known to be absent; fpr is 0 without probes."""
    hits = F.coalesce(F.sum(F.col("present").cast("long")), F.lit(0).cast("long"))
    n = F.count("present")
    return probed_absent.agg(hits.alias("false_positives"), n.alias("probes"), F.when(n > 0, hits / n).otherwise(0.0).alias("fpr"))


def verdict(fpr: Column, target: float, scalable: bool) -> Column:
    """Fixed filters may stray 0.02 from the target, scalable ones lie below it or within 0.005."""
    if scalable:
        return (fpr <= target) | (F.abs(fpr - target) < 0.005)
    return F.abs(fpr - target) < 0.02


def saturation(items: DataFrame, item: str, plan: list[Layer]) -> DataFrame:
    """Every 100th insertion beyond a fixed filter's capacity at which its estimated rate exceeds the target.

    items: item and ordinal. A bit is set by the first ordinal that maps to it; a running count of such
    first settings gives the bits set after each insertion, as replaying them in order would. The sum runs
    over one row for each 100 insertions, in parts.
    """
    layer = plan[0]
    known = hashed(items.filter(F.col(item).isNotNull()).select(item, "ordinal"), item)
    first = known.select("ordinal", F.explode(sql_positions(F.col("h1"), F.col("h2"), layer.k, layer.m)).alias("bit")).groupBy("bit").agg(F.min("ordinal").alias("ordinal"))
    step = F.floor(F.col("ordinal") / 100)
    news = first.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("new_bits"))
    counts = items.groupBy(step.alias("step")).agg((F.max("ordinal") + 1).alias("inserted"))
    steps = counts.join(news, "step", "left").withColumn("new_bits", F.coalesce("new_bits", F.lit(0).cast("long")))
    rows = running_sum(steps, "step", "new_bits").withColumnRenamed("total", "set_bits")
    rate = F.pow(F.col("set_bits") / F.lit(layer.m), F.lit(layer.k))
    saturated = (F.col("inserted") > layer.capacity) & (F.col("inserted") % 100 == 0) & (rate > layer.fp_rate)
    return rows.select("inserted", F.col("set_bits").cast("long").alias("set_bits"), rate.alias("actual_fp"), saturated.alias("saturated"))


def require_unsaturated(found: DataFrame) -> None:
    row = found.filter("saturated").orderBy("inserted").first()
    if row:
        raise ValueError(f"saturated at {row.inserted} insertions: estimated rate {row.actual_fp:.6f}")

