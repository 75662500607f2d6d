"""Comparing all rows of a group, for groups of any size: large ones in blocks on tasks of their own."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.shared import materialize

#: Rows of a group that one task compares with one another.
BLOCK = 2048
#: Bytes of whole groups that a task holds before it compares them (about).
HELD_BYTES = 8 << 20


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it is connected to by the pairs."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        np.minimum.at(root, before, root)  # a root takes the smallest label its members found
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _large_counts(rows: DataFrame, block: int) -> DataFrame:
    """(key, n) of all groups above `block` rows: counted where a million buckets of keys leave it open."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    full = materialize(rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("bucket"))
    return rows.select("key", bucket.alias("bucket")).join(F.broadcast(full), "bucket", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def compare_groups(rows: DataFrame, solve: Callable[[pa.Table, np.ndarray, np.ndarray], tuple], payload: list[str], block: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(u, v, links, key) from groups of rows with the same `key` (long), each row a `node` (long) and payload columns.

    solve(table, group, side): many whole groups at once; group numbers the rows' groups in order; side is 0, or 0
    and 1 where only rows of different sides are to be compared. It gives (row, row, links of every row): pairs of
    rows that are linked, or enough of them to connect what is linked, and counts. Pairs give (u, v) that connect the
    same nodes, without key; counts other than 0 give (u, null, links, key).

    Groups above `block` rows (BLOCK by default) come back in parts; each two parts (and each part with itself) then
    meet in a task. The largest groups are dealt into parts before, so that none is read by one task as a whole.
    counts: (key, n), the rows of each group, where they are known; else rows are read twice more to count them.
    """
    block = block or BLOCK
    schema = "u long, v long, links long, key long, part long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*payload).schema)

    def results(table: pa.Table, group: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        left, right, links = solve(table, group, side)
        node = table.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        place = np.empty(len(node), dtype=np.int64)
        place[order] = np.arange(len(node))
        root = node[order[local_roots(len(node), place[left], place[right])[place]]]
        edge = np.unique(np.stack([node, root], axis=1)[node != root], axis=0)
        some = np.flatnonzero(links)
        u = np.concatenate([edge[:, 0], node[some]])
        v = pa.array(np.concatenate([edge[:, 1], node[some]]), mask=np.concatenate([np.zeros(len(edge), bool), np.ones(len(some), bool)]))
        counts = np.concatenate([np.zeros(len(edge), dtype=np.int64), links[some]])
        key = pa.concat_arrays([pa.nulls(len(edge), pa.int64()), pa.array(table.column("key").to_numpy()[some])])
        return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(counts), key, *(pa.nulls(len(u), t) for t in (pa.int64(), *(table.schema.field(p).type for p in payload)))], names=["u", "v", "links", "key", "part", *payload])

    def first(batches):
        """Whole groups at once; what exceeds `block` rows of a group is passed on in parts."""
        held: list[pa.Table] = []
        held_rows, large, seen = 0, None, 0

        def flush():
            nonlocal held, held_rows
            if held_rows:
                table = pa.concat_tables(held).combine_chunks()
                held, held_rows = [], 0
                keys = table.column("key").to_numpy()
                group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
                yield results(table, group, np.zeros(len(keys), dtype=np.int8))

        def passed(table: pa.Table, begin: int) -> pa.RecordBatch:
            n = table.num_rows
            part = (begin + np.arange(n)) // block
            columns = [table.column("node").combine_chunks(), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, dtype=np.int64)), table.column("key").combine_chunks(), pa.array(part), *(table.column(p).combine_chunks() for p in payload)]
            return pa.RecordBatch.from_arrays([c if not isinstance(c, pa.ChunkedArray) else c.chunk(0) for c in columns], names=["u", "v", "links", "key", "part", *payload])

        open_: pa.Table | None = None  # the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if open_ is not None:
                table = pa.concat_tables([open_, table])
                open_ = None
            keys = table.column("key").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            sizes = np.diff(edges)
            start = 0
            if large is not None:
                if keys[0] == large:
                    yield passed(table.slice(0, int(sizes[0])), seen)
                    seen += int(sizes[0])
                    start = 1
                if len(sizes) > start or keys[0] != large:
                    large = None
            for k in [*np.flatnonzero(sizes > block).tolist()]:
                if k < start:
                    continue
                if k > start:
                    held.append(table.slice(int(edges[start]), int(edges[k] - edges[start])))
                    held_rows += int(edges[k] - edges[start])
                yield passed(table.slice(int(edges[k]), int(sizes[k])), 0)
                if k == len(sizes) - 1:
                    large, seen = int(keys[-1]), int(sizes[k])
                start = k + 1
            if start < len(sizes):
                if len(sizes) - 1 > start:
                    held.append(table.slice(int(edges[start]), int(edges[-2] - edges[start])))
                    held_rows += int(edges[-2] - edges[start])
                open_ = table.slice(int(edges[-2]))
            if held_rows >= 4 * block or sum(t.nbytes for t in held) > HELD_BYTES:
                yield from flush()
        if open_ is not None:
            held.append(open_)
            held_rows += open_.num_rows
        yield from flush()

    def second(batches):
        """A part against itself, or two parts against each other."""
        got: list[pa.Table] = []
        last = None

        def flush():
            if got:
                table = pa.concat_tables(got).combine_chunks()
                got.clear()
                side = table.column("side").to_numpy().astype(np.int8)
                yield results(table, np.zeros(table.num_rows, dtype=np.int64), side)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = np.stack([table.column(c).to_numpy() for c in ("key", "a", "b")], axis=1) if table.num_rows else np.zeros((0, 3))
            edges = [0, *(1 + np.flatnonzero((group[1:] != group[:-1]).any(axis=1))).tolist(), table.num_rows]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if begin == end:
                    continue
                now = tuple(group[begin].tolist())
                if now != last:
                    yield from flush()
                    got, last = [], now
                got.append(table.slice(begin, end - begin))
        yield from flush()

    def paired(parts: DataFrame) -> DataFrame:
        """parts: key, part, parts (their number), node, payload. What part meets part gives."""
        spread = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        spread = spread.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"), "node", *payload)
        more = spread.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node").mapInArrow(second, schema)
        return materialize(more.select("u", "v", "links", "key"))

    rows = rows.select("key", "node", *payload)
    counts = _large_counts(rows, block) if counts is None else counts
    large = materialize(counts.filter(F.col("n") > block).select("key", "n"))
    seen = large.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    # Rows of larger groups than this are dealt at once; as they add up to the total, there are 20,000 such groups at most.
    limit = max(block, (seen.total or 0) // 20_000)
    found = []
    if (seen.most or 0) > limit:
        known = F.broadcast(large.filter(F.col("n") > limit).select("key", F.ceil(F.col("n") / block).alias("parts")))
        parts = rows.join(known, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        found.append(paired(parts))
        rows = rows.join(known, "key", "left_anti")
    out = materialize(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(first, schema))
    found.append(out.filter("part is null").select("u", "v", "links", "key"))
    if out.filter("part is not null").limit(1).count():
        parts = out.filter("part is not null").select("key", "part", F.col("u").alias("node"), *payload)
        numbers = materialize(parts.groupBy("key").agg((F.max("part") + 1).alias("parts")))
        found.append(paired(parts.join(numbers, "key")))
    return reduce(DataFrame.unionByName, found)
