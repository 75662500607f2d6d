"""Mixing sources to target weights.

Each source's words, in a fixed order of its documents, are packed into blocks of fixed length.
Output shards get multinomial counts of slots per source, drawn from what the sources still have
to give, so the totals meet the targets exactly. A slot's number maps through its source's
pseudorandom permutation (one for each epoch) to a block, and slots meet blocks in a join on
(source, block). The tail block of a source, shorter than the rest, is every epoch's last slot.

Defined results: a null text has size 0; documents of size 0 take part with taken 0; null sources
come last in the weight order; repeated rows count as often as they stand in the table; an empty
table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsieve.llm.shared import materialize, small_batches
from quillsieve.llm.textstats import blocks, buffer_of, per_text, word_starts

#: Documents in one bucket, in which offsets are a running sum.
BUCKET_DOCS = 2000
#: Output shards that one task draws.
SHARDS_A_TASK = 16
#: The table of sources is broadcast up to this many rows.
BROADCAST_SOURCES = 10_000


def word_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, `_mark`, a hash of the text, and `size`, the number of [^\\x20\\x09-\\x0D]+ in the whole text."""
    text = F.col("text").cast("binary")
    plain = docs.select(*keep, F.xxhash64(text).alias("_mark"), text.alias("_text"))
    schema = plain.drop("_text").schema.add("size", "long")

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep) + 1)
            sizes = np.zeros(len(texts), dtype=np.int64)
            for at, n in blocks(texts, 4 << 20):
                data, offsets = buffer_of(texts.slice(at, n))
                sizes[at : at + n] = per_text(word_starts(data, offsets), offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], names=[*keep, "_mark", "size"])

    return plain.mapInArrow(run, schema)


def targets(sizes: list[int], weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> list[float]:
    """Shares of all words by the repeating weights; none above max_repeat times its size, the excess reshared."""
    total, n = float(sum(sizes)), len(sizes)
    weight = [float(weights[i % len(weights)]) for i in range(n)]
    cap = [float(max_repeat * s) for s in sizes]
    out, open_ = [0.0] * n, set(range(n))
    left = total
    while open_:
        share = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if weight[i] * share > cap[i]]
        if not full:
            for i in open_:
                out[i] = weight[i] * share
            break
        for i in full:
            out[i] = cap[i]
            left -= cap[i]
            open_.discard(i)
    return out


def _drawn(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of `n` slots by what is left of the quotas, none above its quota."""
    take, need = np.zeros_like(quotas), n
    while need > 0:
        free = quotas - take
        drawn = np.minimum(rng.multinomial(need, free / free.sum()), free)
        take += drawn
        need -= int(drawn.sum())
    return take


def shard_counts(quotas: np.ndarray, slots: int, seed: int, first: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slots, slots) by source, of shards first..end-1 of `slots` slots each.

    A tree of multinomial draws: a stretch of shards splits what it has between its halves, from draws seeded by
    the stretch, so any shards can be drawn alone, in the time of a path, and all of them together meet the quotas.
    """
    shards = max(1, -(-int(quotas.sum()) // slots))
    stack = [(0, 1 << (shards - 1).bit_length(), quotas.astype(np.int64), np.zeros(len(quotas), dtype=np.int64))]
    while stack:
        a, b, left, done = stack.pop()
        if a >= end or b <= first or not left.sum():
            continue
        if b - a == 1:
            yield a, done, left
            continue
        mid = (a + b) // 2
        take = _drawn(left, min((mid - a) * slots, int(left.sum())), np.random.default_rng([seed, a, b]))
        stack.append((mid, b, left - take, done + take))
        stack.append((a, mid, take, done))


def _permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a Feistel network over 2^(2b) >= n, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), dtype=bool)
    while todo.any():
        left, right, m, k = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo], key[todo].astype(np.uint64)
        for r in range(4):
            x = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            left, right = right, left ^ (x & m)
        out[todo] = (left << half[todo]) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, block: int = 256, shard_slots: int = 4096, seed: int = 17, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, takes).

    documents: doc_id, source, the columns of keep, size, source_size, target, src (the source's place in order),
    start (the document's first word in its source's stream). takes: src, start, epoch, from_word, to_word, shard, slot: the words of the
    document that a slot takes. The table of sources is gathered to the driver: one row for each distinct source.
    """
    spark = docs.sparkSession
    keep = keep or []
    sized = word_counts(docs, "doc_id", "source", *keep)
    sized = materialize(sized)
    by_source = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
    found = sorted(by_source.collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r.n) for r in found]
    aims = targets(sizes, weights, max_repeat)
    table = spark.createDataFrame(
        [(k, r.source, sizes[k], float(aims[k]), max(1, -(-int(r.docs) // BUCKET_DOCS))) for k, r in enumerate(found)],
        "src int, source string, source_size long, target double, buckets long",
    )
    table = table.withColumnRenamed("source", "_source")
    placed = sized.join(F.broadcast(table) if len(found) <= BROADCAST_SOURCES else table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Rows of one doc_id, or of none, are dealt by their text too.
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_mark"), F.col("buckets")))
    sums = materialize(placed.groupBy("src", "bucket").agg(F.sum("size").alias("n")).withColumn("block", F.floor(F.col("bucket") / BUCKET_DOCS)))
    blocks_of = sums.groupBy("src", "block").agg(F.sum("n").alias("n"))
    before = lambda by, at: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks_of.select("src", "block", before(["src"], "block").alias("of_block"))
    sums = sums.withColumn("in_block", before(["src", "block"], "bucket")).join(offsets, ["src", "block"])
    sums = materialize(sums.select("src", "bucket", (F.col("of_block") + F.col("in_block")).alias("base")))
    inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "_mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, ["src", "bucket"]).select("doc_id", "source", *keep, "size", "source_size", "target", "src", (F.col("base") + F.col("inside")).alias("start"))
    placed = materialize(placed)

    # Slots: in each epoch the full blocks in permuted order, then the tail; the last epoch ends when the target is met.
    full = np.array(sizes, dtype=np.int64) // block
    per_epoch = np.maximum(1, -(-np.array(sizes, dtype=np.int64) // block))
    want = np.minimum(np.rint(aims).astype(np.int64), np.array(sizes, dtype=np.int64) * max_repeat)
    whole = np.array([w // s if s else 0 for w, s in zip(want, sizes, strict=True)], dtype=np.int64)
    rest = want - whole * np.array(sizes, dtype=np.int64)
    quotas = whole * per_epoch * (np.array(sizes) > 0) + -(-rest // block)
    groups = -(-max(1, -(-int(quotas.sum()) // shard_slots)) // SHARDS_A_TASK) if len(quotas) else 0

    def fill(batches):
        for batch in batches:
            for group in batch.column(0).to_pylist():
                for shard, firsts, counts in shard_counts(quotas, shard_slots, seed, group * SHARDS_A_TASK, (group + 1) * SHARDS_A_TASK):
                    for src in np.flatnonzero(counts).tolist():
                        slot = firsts[src] + np.arange(counts[src], dtype=np.int64)
                        epoch, index = slot // per_epoch[src], slot % per_epoch[src]
                        key = np.uint64(seed * 1_000_003 + src * 7919) + epoch.astype(np.uint64) * np.uint64(104_729)
                        to = index.copy()
                        inner = index < full[src]
                        if inner.any():
                            to[inner] = _permute(index[inner], np.full(int(inner.sum()), full[src]), key[inner])
                        room = want[src] - epoch * sizes[src] - index * block
                        words = np.minimum(np.minimum(block, sizes[src] - to * block), room)
                        one = np.ones(len(slot), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array((one * src).astype(np.int32)), pa.array(to), pa.array(epoch), pa.array(words), pa.array(one * shard), pa.array(slot)], names=["src", "block", "epoch", "words", "shard", "slot"])

    slots = spark.range(0, groups, 1, max(1, min(groups, 100_000))).mapInArrow(fill, "src int, block long, epoch long, words long, shard long, slot long")
    pieces = placed.filter("size > 0").select("src", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    # Statistics see the few rows that slots are made from, not the slots: the hint keeps them from being broadcast.
    takes = slots.hint("merge").join(pieces, ["src", "block"]).select(
        "src", "start", "epoch", "shard", "slot",
        F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("from_word"),
        F.least(F.col("size"), F.col("block") * block + F.col("words") - F.col("start")).alias("to_word"),
    ).filter("to_word > from_word")
    return placed, takes


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document that the mix takes, repeats counted."""
    placed, takes = mixture(docs, **options)
    taken = takes.groupBy("src", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    # A document without words shares its start with the next one, and takes nothing.
    full = placed.filter("size > 0").join(taken, ["src", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")
