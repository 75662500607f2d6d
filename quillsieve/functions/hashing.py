"""Two hash families.

`sql`: two 48-bit slices of the MD5 of an item's bytes; whole-stage expressions that other SQL engines
can repeat. `compat`: MurmurHash3 x64-128, seed 42, for filters that must agree bit by bit with ones
built elsewhere; vectorised in Arrow batches, since no built-in function computes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPAT_SEED = 42


def sql_pair(data: Column) -> tuple[Column, Column]:
    """(h1, h2) below 2**48, so that h1 + i * h2 never leaves 63 bits for up to 2**14 hash functions."""
    digest = F.md5(data)
    return tuple(F.conv(F.substring(digest, at, 12), 16, 10).cast("long") for at in (1, 13))


def sql_positions(h1: Column, h2: Column, k: int, m: int) -> Column:
    """The k positions below m, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h1 + i.cast("long") * h2) % F.lit(m).cast("long"))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _avalanche(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def murmur3_128(items: list[bytes], seed: int = COMPAT_SEED) -> tuple[np.ndarray, np.ndarray]:
    """MurmurHash3 x64-128 of each item: two arrays of uint64. Items of one length are hashed together."""
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    out1, out2 = np.zeros(len(items), dtype=np.uint64), np.zeros(len(items), dtype=np.uint64)
    lengths = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        raw = np.frombuffer(b"".join(items[i] for i in at), dtype=np.uint8).reshape(len(at), n)
        padded = np.zeros((len(at), (n // 16 + 1) * 16), dtype=np.uint8)
        padded[:, :n] = raw
        words = padded.view("<u8")
        h1 = np.full(len(at), seed, dtype=np.uint64)
        h2 = h1.copy()
        full = n // 16
        for b in range(full):
            h1 ^= _rotl(words[:, 2 * b] * c1, 31) * c2
            h1 = (_rotl(h1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
            h2 ^= _rotl(words[:, 2 * b + 1] * c2, 33) * c1
            h2 = (_rotl(h2, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
        if n % 16 > 8:
            h2 ^= _rotl(words[:, 2 * full + 1] * c2, 33) * c1
        if n % 16:
            h1 ^= _rotl(words[:, 2 * full] * c1, 31) * c2
        h1 ^= np.uint64(n)
        h2 ^= np.uint64(n)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _avalanche(h1), _avalanche(h2)
        h1 = h1 + h2
        out1[at], out2[at] = h1, h2 + h1
    return out1, out2


def murmur3_32(items: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86-32 of each item, signed: the stripe routing hash."""

    def rotl(x, r):
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    out = np.zeros(len(items), dtype=np.uint32)
    lengths = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        padded = np.zeros((len(at), (n // 4 + 1) * 4), dtype=np.uint8)
        padded[:, :n] = np.frombuffer(b"".join(items[i] for i in at), dtype=np.uint8).reshape(len(at), n)
        words = padded.view("<u4")
        h = np.full(len(at), seed, dtype=np.uint32)
        for b in range(n // 4):
            h = rotl(h ^ (rotl(words[:, b] * c1, 15) * c2), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if n % 4:
            h ^= rotl(words[:, n // 4] * c1, 15) * c2
        h ^= np.uint32(n)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[at] = h ^ (h >> np.uint32(16))
    return out.view(np.int32)


def compat_positions(h1: np.ndarray, h2: np.ndarray, k: int, m: int, wrap64: bool = False) -> np.ndarray:
    """(items, k) positions (h1 + i * h2) mod m, in unbounded integers, or wrapped at 64 bits first."""
    i = np.arange(k, dtype=np.uint64)[None, :]
    if wrap64:
        return (h1[:, None] + i * h2[:, None]) % np.uint64(m)
    small = (h1 % np.uint64(m))[:, None] + i * (h2 % np.uint64(m))[:, None]  # below 2**64 for m * k below 2**63
    return small % np.uint64(m)


def with_compat_pair(df: DataFrame, data: Column, route: bool = False) -> DataFrame:
    """df with h1 and h2 as signed longs (null for a null item); with route, also the 32-bit routing hash."""
    names = ["h1", "h2"] + ["route"] * route
    plain = df.withColumn("__data", data)
    schema = plain.drop("__data").schema
    for name in names:
        schema = schema.add(name, "integer" if name == "route" else "long")

    def run(batches):
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            known = np.array(values.is_valid())
            items = [v or b"" for v in values.to_pylist()]
            h1, h2 = murmur3_128(items)
            columns = [pa.array(h1.view(np.int64), mask=~known), pa.array(h2.view(np.int64), mask=~known)]
            if route:
                columns.append(pa.array(murmur3_32(items), mask=~known))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema=None, names=[*batch.schema.names[:-1], *names])

    return plain.mapInArrow(run, schema)
