"""Building filters: ordinals, layers, bit positions, packed bitmaps."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsieve.functions.hashing import compat_positions, sql_pair, sql_positions, with_compat_pair
from quillsieve.functions.items import item_bytes
from quillsieve.operators.store import stored
from quillsieve.params import FilterConfig, Layer

#: Bits of one packed bucket.
BUCKET_BITS = 32_768


def ordered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """(df with `ordinal`, 0 for the first row in the order; the number of rows).

    A range sort, and offsets from its partitions' counts. The sorted rows are stored, so that counts and rows come
    from one sort. One count for each partition goes to the driver, and their offsets back in a broadcast join.
    """
    spark = df.sparkSession
    ranged = stored(df.sort(*order).withColumn("__id", F.monotonically_increasing_id()))
    place, inside = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in ranged.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    begins = F.broadcast(spark.createDataFrame(offsets, "__place long, __begin long"))
    return ranged.withColumn("__place", place).join(begins, "__place").withColumn("ordinal", F.col("__begin") + inside).drop("__id", "__place", "__begin"), total


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    return ordered(df, *order)[0]


def running_sum(rows: DataFrame, at: str, value: str, fan: int = 1000) -> DataFrame:
    """rows with `total`, the sum of value up to each row in the order of the distinct numbers `at`.

    Sums of `fan` numbers are summed in their turn, twice, so that no task gets more than `fan` rows, but for the last,
    which gets one row for each fan * fan numbers.
    """
    before = lambda by, order: F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__low", F.floor(F.col(at) / fan)).withColumn("__high", F.floor(F.col("__low") / fan))
    low = rows.groupBy("__high", "__low").agg(F.sum(value).alias("__n"))
    high = low.groupBy("__high").agg(F.sum("__n").alias("__n")).select("__high", before([], "__high").alias("__before_high"))
    low = low.select("__high", "__low", before(["__high"], "__low").alias("__before_low"))
    inside = F.sum(value).over(Window.partitionBy("__low").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("__inside", inside).join(low, ["__high", "__low"]).join(high, "__high")
    return found.withColumn("total", F.col("__before_high") + F.col("__before_low") + F.col("__inside")).drop("__low", "__high", "__inside", "__before_low", "__before_high")


def layer_of(ordinal: Column, plan: list[Layer]) -> Column:
    """The layer that an ordinal lands in: comparisons with the plan's few bounds, no join."""
    inner = reduce(lambda rest, x: F.when(ordinal < x.hi, x.layer).otherwise(rest), reversed(plan[:-1]), F.lit(plan[-1].layer))
    return inner.cast("int")


def by_layer(plan: list[Layer], value) -> Column:
    """A literal of each layer, chosen by the column `layer`."""
    return reduce(lambda rest, x: F.when(F.col("layer") == x.layer, value(x)).otherwise(rest), plan[1:], value(plan[0]))


def stripe_of(h1: Column, stripes: int) -> Column:
    """Stripe routing of the sql family: the first hash, folded to 31 bits, modulo the stripes."""
    return F.pmod(F.pmod(h1, F.lit(2**31 - 1)), F.lit(stripes)).cast("int")


def hashed(df: DataFrame, item: str, stripes: int = 1) -> DataFrame:
    """df with h1, h2 and stripe of the sql family."""
    h1, h2 = sql_pair(item_bytes(df, item))
    pair = df.withColumn("h1", h1).withColumn("h2", h2)
    return pair.withColumn("stripe", stripe_of(F.col("h1"), stripes) if stripes > 1 else F.lit(0))


def bit_rows(items: DataFrame, item: str, plan: list[Layer], stripes: int = 1) -> DataFrame:
    """items: the item column and `ordinal` (or `layer`). Distinct (layer, stripe, bit) that the items set."""
    rows = items.filter(F.col(item).isNotNull())
    if "layer" not in rows.columns:
        rows = rows.withColumn("layer", layer_of(F.col("ordinal"), plan) if "ordinal" in rows.columns else F.lit(0))
    rows = hashed(rows.select(item, "layer"), item, stripes)
    positions = by_layer(plan, lambda x: sql_positions(F.col("h1"), F.col("h2"), x.k, x.m))
    return rows.select("layer", "stripe", F.explode(positions).alias("bit")).distinct()


def packed_bits(items: DataFrame, item: str, plan: list[Layer], stripes: int = 1) -> DataFrame:
    """(layer, stripe, bucket, bitmap): buckets of 32,768 bits, partly aggregated before the one shuffle."""
    rows = items.filter(F.col(item).isNotNull())
    if "layer" not in rows.columns:
        rows = rows.withColumn("layer", layer_of(F.col("ordinal"), plan) if "ordinal" in rows.columns else F.lit(0))
    rows = hashed(rows.select(item, "layer"), item, stripes)
    positions = by_layer(plan, lambda x: sql_positions(F.col("h1"), F.col("h2"), x.k, x.m))
    bits = rows.select("layer", "stripe", F.explode(positions).alias("bit"))
    return pack(bits)


def pack(bits: DataFrame) -> DataFrame:
    at = F.col("bit") + 1  # the functions count bits from 1
    return bits.groupBy("layer", "stripe", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def layer_counts(items: DataFrame, plan: list[Layer]) -> DataFrame:
    """(layer, n_items): insertions, repeats counted; layers without items are 0."""
    spark = items.sparkSession
    layers = spark.createDataFrame([(x.layer,) for x in plan], "layer int")
    counts = items.select(layer_of(F.col("ordinal"), plan).alias("layer")).groupBy("layer").agg(F.count(F.lit(1)).alias("n_items"))
    return layers.join(counts, "layer", "left").select("layer", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def scalable_plan(items: DataFrame, config: FilterConfig) -> list[Layer]:
    return config.plan(items.count())


def compat_bits(items: DataFrame, item: str, plan: list[Layer], config: FilterConfig | None = None, scheme: str = "h1") -> DataFrame:
    """Distinct (layer, stripe, bit) by the compat family.

    scheme: how stripes are chosen, "h1" (first hash modulo 2**31 - 1) or "hash32" (the 32-bit hash, floor
    modulus). Positions are computed in Arrow batches and reduced to distinct ones in each.
    """
    stripes, wrap = (config.stripes, config.wrap64) if config else (1, False)
    rows = items.filter(F.col(item).isNotNull())
    rows = rows.withColumn("layer", layer_of(F.col("ordinal"), plan) if "ordinal" in rows.columns else F.lit(0))
    rows = with_compat_pair(rows.select("layer", item), item_bytes(rows, item), route=scheme == "hash32").drop(item)
    sizes = {x.layer: (x.k, x.m) for x in plan}

    def run(batches):
        for batch in batches:
            layer = batch.column(0).to_numpy()
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in (1, 2))
            stripe = _stripes(h1, batch.column(3).to_numpy() if scheme == "hash32" else None, stripes)
            for d in np.unique(layer).tolist():
                at = layer == d
                k, m = sizes[d]
                bits = compat_positions(h1[at], h2[at], k, m, wrap).astype(np.int64)
                keys = np.unique(np.repeat(stripe[at], k) * m + bits.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), d, dtype=np.int32)), pa.array((keys // m).astype(np.int32)), pa.array(keys % m)], names=["layer", "stripe", "bit"])

    return rows.mapInArrow(run, "layer int, stripe int, bit long").distinct()


def _stripes(h1: np.ndarray, route: np.ndarray | None, stripes: int) -> np.ndarray:
    if route is not None:
        return np.mod(route.astype(np.int64), stripes)
    return (h1 % np.uint64(2**31 - 1) % np.uint64(stripes)).astype(np.int64)
