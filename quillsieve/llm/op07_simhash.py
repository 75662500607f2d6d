"""SimHash near-dedup by segment-popcount embedding.

A fingerprint is cut into pieces, and each piece mapped to the bit counts of its 2-bit segments:
numbers from 0 to 2. The Manhattan distance of two pieces' points is a lower bound of their Hamming
distance. The range join finds points at most 2 apart: both then lie within distance 1 of a common
grid point, so each fingerprint goes to its own cell and those next to it, for each piece, and every
pair that meets in a cell is verified on all bits. Equal fingerprints are one point, and large cells
are compared in blocks on tasks of their own.

Fingerprints that differ in fewer than 3 bits per piece on average agree to 2 bits in some piece, so
with p pieces every link of up to 3p - 1 bits is found: all of them for 64 bits in two halves and
links of up to 5 bits. Links of more bits, as for 128 bits in five pieces of 24, are found in the
share of cases in which some piece agrees so far.

Defined results: null and empty texts have fingerprint zero, linked like any other; rows without doc_id
get a fingerprint and no component; rows that share a doc_id are one document, which links what they
link; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.components import components
from quillsieve.llm.pairs import compare_groups
from quillsieve.llm.phrases import mix
from quillsieve.llm.shared import even_join, materialize, small_batches, small_side
from quillsieve.llm.textstats import buffer_of

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SEED = 42


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; a text of fewer words is one shingle."""
    import xxhash

    found = text.translate(_LOWER).split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(sizes)
    begins = (ends - sizes)[: len(found) - shingle + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray, words: int = 1) -> bytes:
    """Bit majority of the hashes of all shingles, repeats included; big-endian, 8 bytes for each of `words`.

    Words after the first take the majority of the same hashes mixed anew.
    """
    if not len(hashes):
        return bytes(8 * words)
    out = b""
    for k in range(words):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            part = mix(part + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else part
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > len(hashes)).tobytes()
    return out


def fingerprint(text: bytes | None, shingle: int, words: int = 1) -> bytes:
    return fingerprint_of(shingle_hashes(text, shingle), words)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """doc_id and fp (8 bytes for each word of the fingerprint) of every row."""

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                fps = [fingerprint(x.as_py(), shingle, words) for x in batch.column(1).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(fps, type=pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp binary")


def _numbers(fps: pa.Array) -> np.ndarray:
    """(rows, words) of the fingerprints."""
    data, offsets = buffer_of(fps)
    return data.reshape(len(offsets) - 1, -1).view(">u8").astype(np.uint64)


def cells(fps: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): for each fingerprint and piece of `piece` bits its own grid point and those at Manhattan distance 1."""
    ones, mask = np.uint64(0x5555555555555555), np.uint64((1 << piece) - 1)
    rows, found, all_rows = [], [], np.arange(len(fps))
    for number, at in enumerate(range(0, 64 * fps.shape[1] - piece + 1, piece)):
        word, shift = divmod(at, 64)
        bits = fps[:, word] >> np.uint64(shift)
        if shift + piece > 64:
            bits = bits | (fps[:, word + 1] << np.uint64(64 - shift))
        bits = bits & mask
        point = bits - ((bits >> np.uint64(1)) & ones)  # 2-bit fields, each the bit count of its segment
        tag = np.uint64(number << 48)
        rows.append(all_rows)
        found.append(point | tag)
        for k in range(0, piece, 2):
            step = np.uint64(1 << k)
            field = (point >> np.uint64(k)) & np.uint64(3)
            for ok, moved in ((field < 2, point + step), (field > 0, point - step)):
                rows.append(all_rows[ok])
                found.append(moved[ok] | tag)
    return np.concatenate(rows), np.concatenate(found)


#: Groups of more rows are compared in blocks of a matrix, smaller ones all together at growing distance.
_SMALL = 64


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _solver(max_bits: int):
    def solve(table: pa.Table, group: np.ndarray, side: np.ndarray):
        fps = _numbers(table.column("fp").chunk(0))
        n = len(fps)
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        sizes = np.bincount(group)
        begins = np.cumsum(sizes) - sizes
        after = np.where(sizes[group] <= _SMALL, begins[group] + sizes[group] - np.arange(n) - 1, 0)
        rows = np.flatnonzero(after > 0)
        lag = 1
        while len(rows):  # every row with the one `lag` places on, while its group reaches so far
            close = _differ(fps[rows], fps[rows + lag]) <= max_bits
            if side.any():
                close &= side[rows] != side[rows + lag]
            left.append(rows[close])
            right.append(rows[close] + lag)
            lag += 1
            rows = rows[after[rows] >= lag]
        for g in np.flatnonzero(sizes > _SMALL):
            a, b = int(begins[g]), int(begins[g] + sizes[g])
            for lo in range(a, b, 256):
                hi = min(b, lo + 256)
                close = _differ(fps[lo:hi, None], fps[None, lo:b]) <= max_bits
                close &= np.arange(lo, hi)[:, None] < np.arange(lo, b)[None, :]
                if side.any():
                    close &= side[lo:hi, None] != side[None, lo:b]
                i, j = np.nonzero(close)
                left.append(i + lo)
                right.append(j + lo)
        return np.concatenate(left), np.concatenate(right), np.zeros(n, dtype=np.int64)

    return solve


def link_fingerprints(points: DataFrame, max_bits: int = 4, piece: int = 32, blocks: DataFrame | None = None) -> DataFrame:
    """points: (fp, node), one row for each distinct fingerprint. Edges (u, v) that connect those within max_bits.

    blocks: a stored table (node, key) of groups that are compared whole in place of the grid's cells, for links of more
    bits than those find.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps, nodes = batch.column(0).slice(at, 4096), batch.column(1).slice(at, 4096)
                rows, cell = cells(_numbers(fps), piece)
                for k in range(0, len(rows), 50_000):
                    part = pa.array(rows[k : k + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[k : k + 50_000].view(np.int64)), nodes.take(part), fps.take(part)], names=["key", "node", "fp"])

    if blocks is not None:
        sizes = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        met = points.select("fp", "node").join(small_side(blocks), "node").select("key", "node", "fp")
        return compare_groups(met, _solver(max_bits), ["fp"], counts=sizes).filter("v is not null").select("u", "v")
    spread = points.select("fp", "node").mapInArrow(run, "key long, node long, fp binary")
    return compare_groups(spread, _solver(max_bits), ["fp"]).filter("v is not null").select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, words: int = 1, piece: int = 32) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of at most max_bits, for every row."""
    found = materialize(fingerprints(docs, shingle, words))
    known = found.filter("doc_id is not null")
    points = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    edges = link_fingerprints(points.filter("node is not null"), max_bits, piece)
    # A doc_id with several fingerprints links them: through the node of each.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id")
    tied = known.join(materialize(several), "doc_id").join(points, "fp").select(F.greatest("doc_id", "node").alias("u"), F.least("doc_id", "node").alias("v"))
    roots = components(edges.unionByName(tied))
    classes = materialize(points.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"), "n"))
    joined = even_join(found, classes, ["fp"], "n", ["doc_id"])
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
