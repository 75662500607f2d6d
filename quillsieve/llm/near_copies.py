"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Links are op7's: SimHash fingerprints of 256 bits, of each document's distinct shingles, that differ in at most 89. A pair at
0.8 differs in 15 % of the bits (39), and in 3/16 at worst (sets of 5 and 4 shingles), so that it exceeds 89 with a chance of
4e-10. The grid has no cells for links of so many bits; what it proposes are fingerprints whose first 64 bits differ in at most
4, and to these come documents that share a MinHash band. There are 32 bands of 4 hashes, so that a pair at 0.8 shares
none with a chance of 5e-8, and less above. What is proposed, directly or through others, is one block, whose
fingerprints are compared with one another. Documents that op7 links, directly or through others, are one group; in a
group all pairs are compared by their whole sets, and only those of 0.8 or more are followed. What no fingerprint
links is compared with nothing. Equal sets are one point, and large groups are compared in blocks on tasks of their own.

Defined results: shingles are of words as op7 has them, in ASCII lower case, and a text of fewer words is one
shingle; each counts once, by a 64-bit hash; null and empty texts are copies of one another; rows without
doc_id have no component; rows that share a doc_id are one document, which links what they link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.components import components
from quillsieve.llm.op07_simhash import fingerprint_of, link_fingerprints
from quillsieve.llm.pairs import compare_groups
from quillsieve.llm.phrases import mix, word_tokens
from quillsieve.llm.shared import even_join, materialize, small_side
from quillsieve.llm.textstats import blocks, buffer_of

BANDS, ROWS = 32, 4
#: 64-bit words of a fingerprint, and the bits in which linked ones differ at most.
WORDS, MAX_BITS = 4, 89
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], dtype=np.uint8)
#: Sets that one task compares with one another: they are larger than a fingerprint.
BLOCK = 1024

_XOR, _TIMES = (mix(np.arange(k, 2 * BANDS * ROWS + k, 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) for k in (1, 2))
_TIMES |= np.uint64(1)
_FOLD = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: equal where the least of each of its hashes is equal."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at : at + 1024, None] ^ _XOR) * _TIMES).min(axis=0))
    folded = (mix(least).reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return mix(folded + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """64-bit hashes of the word shingles of each binary text, repeats included."""
    for at, n in blocks(texts, 1 << 19):
        data, offsets = buffer_of(texts.slice(at, n))
        tokens = word_tokens(_LOWER[data], offsets)
        words, found = tokens.raw, tokens.raw
        for k in range(1, shingle):
            found = mix(found[: max(0, len(words) - k)] * np.uint64(0xD1342543DE82EF95) + words[k:])
        for a, b in zip(tokens.offsets[:-1].tolist(), tokens.offsets[1:].tolist(), strict=True):
            short = np.array([xxhash.xxh64_intdigest(words[a:b].tobytes())] if b > a else [], dtype=np.uint64)
            yield short if b - a < shingle else found[a : b - shingle + 1]


def _solve(table: pa.Table, group: np.ndarray, side: np.ndarray):
    """Pairs of a group of which 9 times the common shingles reach 4 times both sizes: a Jaccard similarity of 0.8."""
    data, offsets = buffer_of(table.column("shingles").chunk(0))
    hashes, offsets = data.view(np.uint64), offsets // 8
    sizes = np.diff(offsets)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    ends = np.cumsum(np.bincount(group))
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        n = hi - lo
        if n < 2:
            continue
        own = hashes[offsets[lo] : offsets[hi]]
        order = np.argsort(own)
        again = own[order]
        again = np.concatenate([[False], again[1:] == again[:-1]])
        shared = again | np.concatenate([again[1:], [False]])
        row = np.repeat(np.arange(n, dtype=np.int32), sizes[lo:hi])[order[shared]]
        del order
        column = np.cumsum(~again[shared], dtype=np.int32) - 1
        common = np.zeros((n, n), dtype=np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
            a, b = np.searchsorted(column, [first, first + 1024])
            has = np.zeros((n, int(column[b - 1]) - first + 1), dtype=np.float32)
            has[row[a:b], column[a:b] - first] = 1
            common += has @ has.T
        for at in range(0, n, 256):
            rows = np.arange(at, min(n, at + 256))
            close = 9 * common[rows].astype(np.int64) >= 4 * (sizes[lo + rows][:, None] + sizes[lo:hi][None, :])
            close &= rows[:, None] < np.arange(n)[None, :]
            if side.any():
                close &= side[lo + rows][:, None] != side[lo:hi][None, :]
            i, j = np.nonzero(close)
            left.append(i + at + lo)
            right.append(j + lo)
    return np.concatenate(left), np.concatenate(right), np.zeros(len(sizes), dtype=np.int64)


def _whole(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that edges link, the roots with them."""
    linked = components(edges)
    return materialize(linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()))


def near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links, for every row that has a doc_id."""

    def sketch(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, digests, fps, keys = batch.column(0).slice(at, 500), [], [], []
                for every in shingles(batch.column(1).slice(at, 500), shingle):
                    hashes = np.unique(every)
                    fps.append(fingerprint_of(hashes, WORDS))
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    keys.append(bands(hashes).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(digests, type=pa.binary()), pa.array(fps, type=pa.binary()), lists], names=["doc_id", "digest", "fp", "bands"])

    def sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = [np.unique(every).tobytes() for every in shingles(batch.column(2).slice(at, 500), shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), batch.column(1).slice(at, 500), pa.array(own, type=pa.binary())], names=["key", "node", "shingles"])

    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = materialize(known.mapInArrow(sketch, "doc_id long, digest binary, fp binary, bands array<long>"))
    points = materialize(found.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")))
    first = points.select("node", F.substring("fp", 1, 8).alias("fp"))
    alike = materialize(first.groupBy("fp").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("c")))
    close = link_fingerprints(alike.select("fp", F.col("v").alias("node")))
    same = even_join(first, alike, ["fp"], "c", ["node"]).select(F.col("node").alias("u"), "v")
    spread = points.select("node", F.explode("bands").alias("key"))
    met = materialize(spread.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("c")).filter("c > 1"))
    proposed = _whole(even_join(spread, met, ["key"], "c", ["node"]).select(F.col("node").alias("u"), "v").unionByName(same).unionByName(close))
    groups = _whole(link_fingerprints(points, MAX_BITS, blocks=proposed.withColumnRenamed("root", "key")))
    whole = known.join(small_side(groups), F.col("doc_id") == F.col("node")).select("root", "node", "text").mapInArrow(sets, "key long, node long, shingles binary")
    sizes = groups.groupBy(F.col("root").alias("key")).agg(F.count(F.lit(1)).alias("n"))  # or more: a doc_id with several sets
    links = compare_groups(whole, _solve, ["shingles"], BLOCK, sizes).filter("v is not null").select("u", "v")
    # A doc_id with several sets links them: through the node of each.
    several = found.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("doc_id")
    tied = found.join(materialize(several), "doc_id").join(points, "digest").select(F.greatest("doc_id", "node").alias("u"), F.least("doc_id", "node").alias("v"))
    roots = components(links.unionByName(tied))
    classes = materialize(points.select("digest", "node", "n").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"), "n"))
    return even_join(found.select("doc_id", "digest"), classes, ["digest"], "n", ["doc_id"]).select("doc_id", "component_id")
