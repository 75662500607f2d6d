"""Hierarchical best-fit packing of token pieces into sequences of bounded length.

Partitions pack their pieces best-fit in decreasing length; bins that are nearly full are emitted,
the others go up a tree as items, where fewer and larger partitions pack them again, until one
partition packs the rest. A partition passes on at most `carry` bins, the emptiest, so the last
task stays bounded when no bins fit together; it emits the others as they are.

Defined results: a null or empty text has no ids of its own and gives one piece, id 0; an empty
table gives an empty result; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.shared import materialize, small_batches

#: Words whose ids a worker keeps for all its tasks (the first it meets), and for a while.
KEPT_WORDS, RECENT_WORDS = 250_000, 50_000
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: ASCII letters before other ASCII marks without apostrophes are tokenized apart by the tokenizer itself.
_TAIL = re.compile(rb"([a-z]+)([^a-z0-9'\x80-\xff]+)")


class Ids:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and never joins across it.

    A text's ids are those of its white-space separated words, which are looked up; unknown words
    of a batch go to the tokenizer together. Words are split at ASCII white space; a word that
    holds other white space is one call's text as a whole, which gives the same ids. ASCII case is
    dropped first, but where the text may spell a special token.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.recent = Tokenizer.from_file(path), {}, []
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, words: list[bytes]) -> None:
        """Asks the tokenizer for unknown words: letters only by the hundred, each ends with the id that ends a word."""
        known = {w: w.decode("utf-8", "replace") for w in words}
        plain = [w for w, x in known.items() if x.isalpha() and x.lower().isalpha()]
        other = known.keys() - set(plain)
        groups = [plain[at : at + 100] for at in range(0, len(plain), 100)]
        for part, ids in zip(groups, self._encoded([" ".join(known[w] for w in g) for g in groups]), strict=True):
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(part):  # some word is no single one to the tokenizer
                other |= set(part)
                continue
            raw = ids.tobytes()
            for word, a, b in zip(part, [0, *ends], ends, strict=False):
                self._keep(word, raw[4 * a : 4 * b])
        rest = list(other)
        for word, ids in zip(rest, self._encoded([known[w] for w in rest]), strict=True):
            self._keep(word, ids.tobytes())

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 1000):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4")

    def _keep(self, word: bytes, ids: bytes) -> None:
        if len(self.words) >= KEPT_WORDS:
            self.recent.append(word)
        self.words[word] = ids

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers, id 0 at the end."""
        split = [(x if b"<|" in x else x.translate(_LOWER)).split() if x else [] for x in texts]
        if len(self.recent) > RECENT_WORDS:
            for word in self.recent:
                self.words.pop(word, None)
            self.recent.clear()
        new = set().union(*split).difference(self.words)
        tails = {w: (m[1], m[2]) for w in new if (m := _TAIL.fullmatch(w)) and b"<|" not in w}
        self._learn(list((new - tails.keys()).union(*tails.values()).difference(self.words)))
        for word, (a, b) in tails.items():
            self._keep(word, self.words[a] + self.words[b])
        of = self.words.__getitem__
        return [b"".join(map(of, words)) + b"\0\0\0\0" for words in split]


@lru_cache(maxsize=2)
def ids_by(path: str) -> Ids:
    return Ids(path)


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, cut into pieces of `length` where longer."""

    small_batches(docs.sparkSession)

    def run(batches):
        ids_of = ids_by(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, batch.num_rows, 500):
                rows = []
                for key, ids in zip(keys[at : at + 500], ids_of(texts.slice(at, 500).to_pylist()), strict=True):
                    n = len(ids) // 4
                    for piece, start in enumerate(range(0, n, length)):
                        rows.append((key, piece, start, min(length, n - start), zlib.crc32(ids[4 * start : 4 * (start + length)])))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: items in decreasing size, each to the fullest bin that holds it."""
    room: list[int] = []  # distinct free sizes in order
    bins_at: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        at = bisect_left(room, size)
        if at < len(room):
            free = room[at]
            target = bins_at[free].pop()
            if not bins_at[free]:
                room.pop(at)
            bins[target].append(item)
        else:
            free, target = capacity, len(bins)
            bins.append([item])
        free -= size
        if free:
            if not bins_at.get(free):
                bins_at[free] = []
                insort(room, free)
            bins_at[free].append(target)
    return bins


def best_fit_pack(pieces: DataFrame, capacity: int = 2048, full: float = 0.99, items_per_task: int = 40_000, carry: int = 10_000) -> DataFrame:
    """The pieces with sequence_id and offset. Full pieces are sequences of their own; the rest is packed in rounds."""
    spark = pieces.sparkSession
    pieces = materialize(pieces)
    columns = pieces.columns
    one = F.struct(*columns)
    key = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())  # deals repeated rows apart
    rest = pieces.filter(F.col("length") < capacity)
    parts = max(1, -(-rest.count() // items_per_task))
    items = rest.select(F.col("length").alias("size"), key.alias("key"), F.array(one).alias("members"))
    schema = items.schema.add("closed", "boolean")
    done, level = [], 0
    while True:
        last = parts == 1

        def pack(batches, last=last):
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            table = pa.Table.from_batches(got).combine_chunks()
            table = table.take(pa.compute.sort_indices(table, sort_keys=[("size", "descending"), ("key", "ascending")]))
            sizes, keys = table.column("size").to_pylist(), table.column("key").to_pylist()
            bins = best_fit(sizes, capacity)
            fill = [sum(sizes[i] for i in b) for b in bins]
            passed = set() if last else set(sorted((b for b in range(len(bins)) if fill[b] < full * capacity), key=fill.__getitem__)[:carry])
            members = table.column("members").chunk(0) if table.num_rows else None
            order = pa.array([i for b in bins for i in b])
            lists = members.take(order)
            flat, sizes_of = lists.flatten(), np.array(lists.value_lengths())
            ends = np.cumsum([len(b) for b in bins])
            offsets = np.concatenate([[0], np.cumsum(sizes_of)])[np.concatenate([[0], ends])]
            merged = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat)
            out = pa.RecordBatch.from_arrays(
                [pa.array(fill, type=pa.int64()), pa.array([keys[b[0]] for b in bins], type=pa.int64()), merged, pa.array([b not in passed for b in range(len(bins))])],
                names=["size", "key", "members", "closed"],
            )
            for at in range(0, out.num_rows, 5000):
                yield out.slice(at, 5000)

        dealt = items.repartition(parts, "key") if parts > 1 else items.coalesce(1)
        packed = materialize(dealt.mapInArrow(pack, schema))
        done.append(packed.filter("closed").drop("closed").withColumn("level", F.lit(level)))
        if last:
            break
        items = packed.filter("not closed").drop("closed")
        parts, level = -(-parts // 8), level + 1
    bins = done[0]
    for x in done[1:]:
        bins = bins.unionByName(x)
    # A bin's id: its first piece's place in the order of documents would need a sort; its hash, made distinct, does not.
    whole = pieces.filter(F.col("length") == capacity).select(F.col("length").alias("size"), key.alias("key"), F.array(one).alias("members"), F.lit(-1).alias("level"))
    bins = bins.unionByName(whole).withColumn("sequence_id", F.monotonically_increasing_id())
    spread = bins.select("sequence_id", F.posexplode("members").alias("at", "m"), "members")
    offset = F.aggregate(F.slice("members", 1, F.col("at")), F.lit(0).cast("long"), lambda total, m: total + m["length"])
    return spread.select("m.*", "sequence_id", offset.alias("offset"))
