"""Embedding near-dedup by random-hyperplane sign hashing in several tables.

Equal vectors are one class. In each table a class's bucket is the signs of its products with random
hyperplanes. Buckets first meet with all signs of their classes and no vectors: classes whose signs differ
in too many places for the threshold are no candidates, and a pair is one in the first of its common
buckets only. Classes with a candidate meet again with their vectors, and are compared exactly by cosine in double
precision, in blocks where a bucket is large. Components of the links come from star contraction over
tables in the shared folder.

Missed links: two vectors at cosine c share a table's bucket with probability (1 - acos(c) / pi) ** bits;
with 24 tables of 10 bits a pair at exactly 0.9 is missed with 0.4 %, at 0.95 with 1 in 100,000. The number of
signs that may differ lies 6 standard deviations above the mean at the threshold (1 pair in 10 million has more).

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing and
are components of their own; vectors of different lengths never meet; repeated rows are vectors each;
rows without vec_id link with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.components import components
from quillsieve.llm.pairs import compare_groups
from quillsieve.llm.shared import even_join, materialize

TABLES, BITS = 24, 10


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, vec (float64 bytes; null where the vector takes no part) and digest of the vector."""

    def run(batches):
        for batch in batches:
            out, digests = [], []
            for x in batch.column(1):
                values = x.as_py()
                vec = None
                if values and None not in values:
                    v = np.array(values, dtype="<f8") + 0.0
                    if np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and v @ v > 0:
                        vec = v.tobytes()
                out.append(vec)
                digests.append(hashlib.blake2b(vec, digest_size=16).digest() if vec else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary()), pa.array(digests, type=pa.binary())], names=["vec_id", "vec", "digest"])

    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, vec binary, digest binary")


def signatures(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """(rows, tables) of bucket numbers."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int64)


def packed(sigs: np.ndarray, bits: int) -> list[bytes]:
    """The signs of all tables, one row's after another's."""
    signs = (sigs[:, :, None] >> np.arange(bits, dtype=sigs.dtype)) & 1
    return [x.tobytes() for x in np.packbits(signs.reshape(len(sigs), -1).astype(np.uint8), axis=1)]


def unpacked(rows: pa.Array, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs as 64-bit words, bucket numbers) of packed rows."""
    raw = np.frombuffer(b"".join(rows.to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
    words = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), dtype=np.uint8)
    words[:, : raw.shape[1]] = raw
    signs = np.unpackbits(raw, axis=1, count=tables * bits).reshape(len(raw), tables, bits)
    return words.view(np.uint64), (signs * (1 << np.arange(bits))).sum(axis=2)


def _groups(group: np.ndarray):
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    return [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a > 1]


def _table_of(keys: np.ndarray, tables: int) -> np.ndarray:
    return (keys >> 20) % tables


def most_signs(threshold: float, tables: int, bits: int) -> int:
    """Signs that may differ between vectors at the threshold."""
    p, n = np.arccos(min(1.0, max(-1.0, threshold))) / np.pi, tables * bits
    return int(np.ceil(p * n + 6 * np.sqrt(p * (1 - p) * n)))


def _candidates(threshold: float, tables: int, bits: int):
    """Counts each row's candidates whose first common bucket this is."""
    most = most_signs(threshold, tables, bits)

    def solve(table: pa.Table, group: np.ndarray, side: np.ndarray):
        none, links = np.zeros(0, dtype=np.int64), np.zeros(table.num_rows, dtype=np.int64)
        words, buckets = unpacked(table.column("sig"), tables, bits)
        at_table = _table_of(table.column("key").to_numpy(), tables)
        for a, b in _groups(group):
            t = int(at_table[a])
            for lo in range(a, b, 512):
                hi = min(b, lo + 512)
                apart = np.zeros((hi - lo, b - a), dtype=np.int16)
                for w in range(words.shape[1]):
                    apart += np.bitwise_count(words[lo:hi, None, w] ^ words[None, a:b, w])
                close = (apart <= most) & (np.arange(lo, hi)[:, None] < np.arange(a, b)[None, :])
                if side[a:b].any():
                    close &= side[lo:hi, None] != side[None, a:b]
                i, j = np.nonzero(close)
                i, j = i + lo, j + a
                for begin in range(0, len(i), 100_000):
                    u, v = i[begin : begin + 100_000], j[begin : begin + 100_000]
                    fresh = ~(buckets[u, :t] == buckets[v, :t]).any(axis=1)
                    links[u[fresh]] = links[v[fresh]] = 1
        return none, none, links

    return solve


def _solver(threshold: float, tables: int, bits: int):
    def solve(table: pa.Table, group: np.ndarray, side: np.ndarray):
        left, right, links = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], np.zeros(table.num_rows, dtype=np.int64)
        vecs, sizes = table.column("vec").to_pylist(), table.column("members").to_numpy()
        _, buckets = unpacked(table.column("sig"), tables, bits)
        at_table = _table_of(table.column("key").to_numpy(), tables)
        for a, b in _groups(group):
            x = np.frombuffer(b"".join(vecs[a:b])).reshape(b - a, -1)
            norm, t = np.sqrt(np.einsum("ij,ij->i", x, x)), int(at_table[a])
            for lo in range(a, b, 512):
                hi = min(b, lo + 512)
                close = (x[lo - a : hi - a] @ x.T) / (norm[lo - a : hi - a, None] * norm[None, :]) >= threshold
                close &= np.arange(lo, hi)[:, None] < np.arange(a, b)[None, :]
                if side[a:b].any():
                    close &= side[lo:hi, None] != side[None, a:b]
                i, j = np.nonzero(close)
                i, j = i + lo, j + a
                left.append(i)
                right.append(j)
                for begin in range(0, len(i), 100_000):
                    u, v = i[begin : begin + 100_000], j[begin : begin + 100_000]
                    fresh = ~(buckets[u, :t] == buckets[v, :t]).any(axis=1)
                    np.add.at(links, u[fresh], sizes[v[fresh]])
                    np.add.at(links, v[fresh], sizes[u[fresh]])
        return np.concatenate(left), np.concatenate(right), links

    return solve


def near_vectors(rows: DataFrame, threshold: float = 0.9, tables: int = TABLES, bits: int = BITS, seed: int = 23) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    found = materialize(vectors(rows))
    valid = found.filter("vec is not null and vec_id is not null")
    classes = materialize(valid.groupBy("digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("members"), F.first("vec").alias("vec")))

    def sign(batches):
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            sigs: list[bytes] = [b""] * len(vecs)
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(vecs):
                by_size.setdefault(len(v), []).append(k)
            for all_places in by_size.values():
                for begin in range(0, len(all_places), 1000):
                    places = all_places[begin : begin + 1000]
                    x = np.frombuffer(b"".join(vecs[k] for k in places)).reshape(len(places), -1)
                    for k, sig in zip(places, packed(signatures(x, tables, bits, seed), bits), strict=True):
                        sigs[k] = sig
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs, type=pa.binary())], names=["node", "vec", "members", "sig"])

    def spread(batches):
        """A row for each table: its bucket, in which vectors of other lengths never are."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                _, buckets = unpacked(part.column(2), tables, bits)
                size = part.column(1).to_numpy() // 8 % (1 << 20)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array((buckets[:, t] * tables + t) * (1 << 20) + size), part.column(0), part.column(2)], names=["key", "node", "sig"])

    signed = materialize(classes.select("node", "vec", "members").mapInArrow(sign, "node long, vec binary, members long, sig binary"))
    keys = signed.select("node", F.length("vec").cast("long").alias("size"), "sig").mapInArrow(spread, "key long, node long, sig binary")
    some = compare_groups(keys, _candidates(threshold, tables, bits), ["sig"]).filter("v is null").select("key", F.col("u").alias("node")).distinct()
    out = materialize(compare_groups(some.join(signed, "node"), _solver(threshold, tables, bits), ["vec", "sig", "members"]))
    counts = out.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("linked"))
    roots = components(out.filter("v is not null").select("u", "v"))
    known = classes.select("digest", "node", "members").join(counts, "node", "left").join(roots, "node", "left")
    known = materialize(known.select("digest", "members", (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id")))
    linked = even_join(valid.select("vec_id", "digest"), known, ["digest"], "members", ["vec_id"]).select("vec_id", "n_links", "component_id")
    # What links with nothing has no key to be dealt by.
    alone = found.filter("vec is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
