"""Probing filters: a relational form for filters of any size, and broadcast bitmaps for those of checked size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.hashing import compat_positions, sql_positions, with_compat_pair
from quillsieve.functions.items import item_bytes
from quillsieve.operators.build import BUCKET_BITS, _stripes, hashed, pack
from quillsieve.params import FilterConfig, Layer

#: Packed bytes of a filter up to which it is broadcast; larger filters are joined bucket by bucket.
BROADCAST_BYTES = 64 << 20


def packed_size(plan: list[Layer], stripes: int = 1) -> int:
    return sum(-(-x.m // BUCKET_BITS) * (BUCKET_BITS // 8) * stripes for x in plan)


def _compat_asked(known: DataFrame, item: str, plan: list[Layer], config: FilterConfig | None, scheme: str) -> DataFrame:
    """(item, stripe, layer, wanted, bit): each layer's distinct positions of distinct items, by the compat family."""
    stripes, wrap = (config.stripes, config.wrap64) if config else (1, False)
    pairs = with_compat_pair(known, item_bytes(known, item), route=scheme == "hash32")
    schema = known.schema
    for name, kind in (("stripe", "integer"), ("layer", "integer"), ("wanted", "integer"), ("bit", "long")):
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in (1, 2))
            stripe = _stripes(h1, batch.column(3).to_numpy() if scheme == "hash32" else None, stripes).astype(np.int32)
            for x in plan:
                bits = np.sort(compat_positions(h1, h2, x.k, x.m, wrap).astype(np.int64), axis=1)
                new = np.concatenate([np.ones((len(bits), 1), dtype=bool), bits[:, 1:] != bits[:, :-1]], axis=1)
                row, place = np.nonzero(new)
                columns = [batch.column(0).take(pa.array(row)), stripe[row], np.full(len(row), x.layer, dtype=np.int32), new.sum(axis=1).astype(np.int32)[row], bits[row, place]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return pairs.mapInArrow(run, schema)


def probe(items: DataFrame, item: str, bits: DataFrame, plan: list[Layer], stripes: int = 1, family: str = "sql", config: FilterConfig | None = None, scheme: str = "h1") -> DataFrame:
    """items with `present`: some layer has all bits of the item set; null for a null item.

    bits: (layer, stripe, bit) rows or packed buckets. Distinct items are hashed once; each layer's distinct
    positions are looked up by (layer, stripe, bucket), and counts of hits decide.
    """
    packed = bits if "bitmap" in bits.columns else pack(bits)
    if packed_size(plan, stripes) <= BROADCAST_BYTES:
        packed = F.broadcast(packed)
    known = items.select(item).filter(F.col(item).isNotNull()).distinct()
    if family == "compat":
        asked = _compat_asked(known, item, plan, config, scheme)
    else:
        layers = F.array(*(F.struct(F.lit(x.layer).alias("layer"), F.array_distinct(sql_positions(F.col("h1"), F.col("h2"), x.k, x.m)).alias("bits")) for x in plan))
        asked = hashed(known, item, stripes).select(item, "stripe", F.explode(layers).alias("l"))
        asked = asked.select(item, "stripe", F.col("l.layer").alias("layer"), F.size("l.bits").alias("wanted"), F.explode("l.bits").alias("bit"))
    asked = asked.withColumn("bucket", F.bitmap_bucket_number(F.col("bit") + 1)).withColumn("at", F.bitmap_bit_position(F.col("bit") + 1))
    byte = F.conv(F.hex(F.substring("bitmap", 1 + F.shiftright("at", 3), F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("at", F.lit(8)))), F.lit(2)) == 1
    found = asked.join(packed, ["layer", "stripe", "bucket"]).filter(hit)
    found = found.groupBy(item, "layer").agg(F.count(F.lit(1)).alias("hits"), F.max("wanted").alias("wanted")).filter("hits = wanted").select(item).distinct()
    marked = items.join(found.withColumn("__hit", F.lit(True)), item, "left")
    return marked.withColumn("present", F.when(F.col(item).isNotNull(), F.coalesce("__hit", F.lit(False)))).drop("__hit")


def probe_local(items: DataFrame, item: str, packed: DataFrame, plan: list[Layer], config: FilterConfig | None = None, family: str = "sql", scheme: str = "h1") -> DataFrame:
    """The same answer from bitmaps sent to every executor: layers newest first, an item leaves at its first hit.

    Only for filters whose packed size is below BROADCAST_BYTES; the check is on the plan, before any job.
    """
    stripes, wrap = (config.stripes, config.wrap64) if config else (1, False)
    if packed_size(plan, stripes) > BROADCAST_BYTES:
        raise ValueError("the filter is too large to broadcast; use probe")
    flat = {(x.layer, s): np.zeros(-(-x.m // BUCKET_BITS) * BUCKET_BITS // 8, dtype=np.uint8) for x in plan for s in range(stripes)}
    for r in packed.collect():  # bounded by BROADCAST_BYTES
        at = (r.bucket - 1) * BUCKET_BITS // 8
        flat[r.layer, r.stripe][at : at + len(r.bitmap)] |= np.frombuffer(bytes(r.bitmap), dtype=np.uint8)
    sent = items.sparkSession.sparkContext.broadcast(flat)
    if family == "compat":
        pairs = with_compat_pair(items, item_bytes(items, item), route=scheme == "hash32")
    else:
        pairs = hashed(items, item, stripes).drop("stripe")
    width = len(items.columns)
    names = items.columns

    def run(batches):
        bitmaps = sent.value
        for batch in batches:
            known = np.array(batch.column(width).is_valid())
            h1, h2 = (batch.column(width + c).fill_null(0).to_numpy().view(np.uint64) for c in (0, 1))
            route = batch.column(width + 2).fill_null(0).to_numpy() if scheme == "hash32" and family == "compat" else None
            stripe = _stripes(h1, route, stripes)
            present = np.zeros(len(h1), dtype=bool)
            for x in sorted(plan, key=lambda x: -x.layer):
                for s in range(stripes):
                    at = np.flatnonzero(known & ~present & (stripe == s))
                    for i in range(x.k):  # the items still possible shrink with every hash
                        if not len(at):
                            break
                        bit = _position(h1[at], h2[at], i, x.m, wrap)
                        at = at[(bitmaps[x.layer, s][bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                    present[at] = True
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(present, mask=~known)], names=[*names, "present"])

    return pairs.mapInArrow(run, items.schema.add("present", "boolean"))


def probe_by_size(items: DataFrame, item: str, packed: DataFrame, plan: list[Layer], config: FilterConfig | None, family: str = "sql", scheme: str = "h1") -> DataFrame:
    """probe_local where the plan's packed size allows it, probe elsewhere; the answers are the same."""
    stripes = config.stripes if config else 1
    if packed_size(plan, stripes) <= BROADCAST_BYTES:
        return probe_local(items, item, packed, plan, config, family, scheme)
    return probe(items, item, packed, plan, stripes, family, config, scheme)


def _position(h1: np.ndarray, h2: np.ndarray, i: int, m: int, wrap: bool) -> np.ndarray:
    if wrap:
        return ((h1 + np.uint64(i) * h2) % np.uint64(m)).astype(np.int64)
    return ((h1 % np.uint64(m) + np.uint64(i) * (h2 % np.uint64(m))) % np.uint64(m)).astype(np.int64)


def prefiltered_join(left: DataFrame, right: DataFrame, key: str, packed: DataFrame, plan: list[Layer]) -> DataFrame:
    """left joined to right on key after a filter over right's keys drops most rows of left without a partner."""
    return probe_local(left, key, packed, plan).filter("present").drop("present").join(right, key)
