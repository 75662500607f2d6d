"""Overlapping phrases of token sequences: every window of `width` tokens lies in exactly one phrase.

A rolling hash is taken over every `gram` tokens. The gram of least hash in a window is the
window's trigger; a phrase is a longest run of windows with the same trigger, so neighbouring
phrases overlap by width - 1 tokens. Equal windows have triggers of equal content at equal places,
so they lie in phrases of the same trigger, whatever surrounds them. A phrase occurrence is
(trigger, content, doc_id, pos, n): the trigger's rolling hash, XXH3 of all its tokens, the first
token, and the number of windows. The rolling hash, which some regular texts can clash in, only
brings phrases together; what is taken to be equal has equal XXH3, over bytes or over 64-bit hashes of words.

`repeats` finds, in aggregates and joins on these rows alone, the phrases that can hold repeated
windows: occurrences of one phrase repeat as a whole, and only distinct phrases of one trigger need
their tokens compared, in shards. Hashes of contents are compared among phrases of one trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.shared import even_join, materialize, small_batches
from quillsieve.llm.textstats import SPACE, blocks, buffer_of, word_starts

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Positions in a block are packed into this many low bits of a hash.
_PLACE_BITS = 23
#: Longest stretch of tokens handled at once; longer documents are cut into stretches that overlap by a window.
STRETCH = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 18)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Hashes of every `n` tokens of an array, from prefix sums."""

    def __init__(self, tokens: np.ndarray) -> None:
        up, self.down = _powers(len(tokens))
        self.sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m])


class Tokens:
    """The tokens of a block of documents: bytes, or 64-bit hashes of words; offsets[k] is where document k begins."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.offsets = raw, offsets

    def __len__(self) -> int:
        return len(self.raw)

    def hashes(self) -> np.ndarray:
        return self.raw if self.raw.dtype == np.uint64 else _BYTES[self.raw]

    def part(self, start: int, end: int) -> Tokens:
        """One stretch of a document, as a document."""
        own = self.raw[start:end]
        return Tokens(own, np.array([0, len(own)]))

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XXH3 of the tokens of each stretch: what is equal there is taken to be equal."""
        n, raw = self.raw.itemsize, memoryview(np.ascontiguousarray(self.raw)).cast("B") if len(self.raw) else memoryview(b"")
        return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((starts * n).tolist(), (ends * n).tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens are bytes."""
    return Tokens(data, offsets)


#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word: 8 bytes after the other are mixed in; XXH64 of long words."""
    size = ends - starts
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    found = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(rows):
        lane, left = lanes[starts[rows] + at], np.minimum(size[rows] - at, 8).astype(np.uint64)
        lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        found[rows] = mix(found[rows] ^ lane)
        at += 8
        rows = rows[size[rows] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        found[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    return found


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens are 64-bit hashes of the words [^\\x20\\x09-\\x0D]+."""
    starts, ends = word_bounds(data, offsets)
    if not len(starts):
        return Tokens(np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))
    return Tokens(word_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(word_starts(data, offsets))
    stop = np.zeros(len(data) + 1, dtype=bool)
    stop[:-1] = SPACE[data]
    stop[offsets[1:]] = True
    ends = np.flatnonzero(stop)
    return starts, ends[np.searchsorted(ends, starts, side="right")]


def cut(tokens: Tokens, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first token, windows, trigger) of each phrase of a block of documents."""
    n, offsets = len(tokens), tokens.offsets
    empty = np.zeros(0, dtype=np.int64)
    if n < width:
        return empty, empty, empty, empty.astype(np.uint64)
    grams = Rolling(tokens.hashes()).grams(gram)
    places = np.uint64((1 << _PLACE_BITS) - 1)
    least = (grams & ~places) | np.arange(len(grams), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: n - width + 1], least[span - have : span - have + n - width + 1])
    least &= places
    doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= offsets[1:][doc_of])
    if not len(at):
        return empty, empty, empty, empty.astype(np.uint64)
    trigger = least[at]
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)]))
    first = at[new]
    count = np.diff(np.concatenate([new, [len(at)]]))
    return doc_of[first], first - offsets[:-1][doc_of[first]], count, mix(grams[trigger[new].astype(np.int64)])


def stretches(texts: pa.Array, to_tokens: Callable, width: int, limit: int = STRETCH) -> Iterator[tuple[int, int, Tokens]]:
    """(first row, position of the first token, tokens): blocks of rows; a long document in parts."""
    for row, n in blocks(texts, limit):
        tokens = to_tokens(*buffer_of(texts.slice(row, n)))
        if len(tokens) <= STRETCH:
            yield row, 0, tokens
            continue
        for k, (begin, end) in enumerate(zip(tokens.offsets[:-1].tolist(), tokens.offsets[1:].tolist(), strict=True)):
            for start in range(0, max(1, end - begin - width + 1), STRETCH):
                yield row + k, start, tokens.part(begin + start, min(end, begin + start + STRETCH + width - 1))


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


OCCURRENCE = "trigger long, content long, doc_id long, pos long, n int"


def occurrences(docs: DataFrame, to_tokens: Callable, width: int, gram: int) -> DataFrame:
    """All phrase occurrences of all documents that have a doc_id."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, begin, tokens in stretches(batch.column(1), to_tokens, width):
                doc, first, count, trigger = cut(tokens, width, gram)
                if len(doc):
                    start = first + tokens.offsets[:-1][doc]
                    content = tokens.digests(start, start + count + width - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(trigger.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[row + doc]), pa.array(first + begin), pa.array(count.astype(np.int32))],
                        names=["trigger", "content", "doc_id", "pos", "n"],
                    )

    return _texts(docs).mapInArrow(run, OCCURRENCE)


def trigger_counts(docs: DataFrame, to_tokens: Callable, width: int, gram: int) -> DataFrame:
    """(trigger, hot): how many phrases each trigger begins in a block of documents."""

    def run(batches):
        for batch in batches:
            for _, _, tokens in stretches(batch.column(1), to_tokens, width):
                trigger, counts = np.unique(cut(tokens, width, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(trigger.view(np.int64)), pa.array(counts.astype(np.int64))], names=["trigger", "hot"])

    return _texts(docs).mapInArrow(run, "trigger long, hot long")


#: Triggers of more occurrences have their windows compared by fingerprint in an aggregate, not in one shard.
HOT = 256


@dataclass
class Repeats:
    """some: occurrences whose trigger occurs again. kinds: the distinct phrases among them with their number of
    occurrences and the first one. dictionary: those kinds whose trigger begins other phrases too, so that single
    windows of them may be repeated elsewhere."""

    some: DataFrame
    kinds: DataFrame
    dictionary: DataFrame

    def marked(self) -> DataFrame:
        """doc_id, pos, n, times, is_first of each occurrence in `some`."""
        some = self.some.select("trigger", "content", "doc_id", "pos", "n")
        found = even_join(some, self.kinds.select("trigger", "content", "times", "first_doc", "first_pos"), ["trigger", "content"], "times", ["doc_id", "pos"])
        return found.select("doc_id", "pos", "n", "times", ((F.col("doc_id") == F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))).alias("is_first"))


def repeats(docs: DataFrame, to_tokens: Callable, width: int, gram: int) -> Repeats:
    """Aggregates and joins on phrase occurrences; a key of many rows is dealt over several tasks in every join."""
    counts = trigger_counts(docs, to_tokens, width, gram)
    triggers = materialize(counts.groupBy("trigger").agg(F.sum("hot").alias("hot")).filter("hot > 1"))
    some = materialize(even_join(occurrences(docs, to_tokens, width, gram), triggers, ["trigger"], "hot", ["doc_id", "pos"]))
    kinds = materialize(
        some.groupBy("trigger", "content")
        .agg(F.count(F.lit(1)).alias("times"), F.max("hot").alias("hot"), F.max("n").alias("n"), F.min(F.struct("doc_id", "pos")).alias("least"))
        .select("trigger", "content", "times", "hot", "n", F.col("least.doc_id").alias("first_doc"), F.col("least.pos").alias("first_pos"))
    )
    several = materialize(kinds.groupBy("trigger").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1"))
    return Repeats(some, kinds, materialize(even_join(kinds, several, ["trigger"], "forms", ["content"]).drop("forms")))


def by_document(docs: DataFrame, rows: DataFrame, fields: list[str], kind: str = "inner") -> DataFrame:
    """docs with the rows of their doc_id as the list __rows (as many as a document has places); null where it has none."""
    lists = rows.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct(*fields)).alias("__rows"))
    known = docs.filter("doc_id is not null").join(lists, F.col("doc_id") == F.col("__doc"), kind).drop("__doc")
    if kind == "inner":
        return known
    # Rows without doc_id have no key to be dealt by.
    return known.unionByName(docs.filter("doc_id is null").withColumn("__rows", F.lit(None).cast(lists.schema["__rows"].dataType)))


SHARD_ROW = "hot boolean, trigger long, content long, doc_id long, pos long, n int, times long, payload binary"


def shard_rows(docs: DataFrame, dictionary: DataFrame, to_tokens: Callable, width: int) -> DataFrame:
    """The dictionary's phrases with their tokens; phrases of hot triggers as one row for each window, without tokens."""

    def phrases_of(ids: np.ndarray, tokens: Tokens, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
        """Of a block of documents, with each one's phrases in lists."""
        first, n, trigger, content, hot, times = (c.to_numpy() for c in lists.flatten().flatten())
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        begin = tokens.offsets[:-1][doc] + first
        end = begin + n + width - 1
        own = np.flatnonzero(end <= tokens.offsets[1:][doc])
        own = own[tokens.digests(begin[own], end[own]).view(np.int64) == content[own]]  # else another row of the doc_id holds the phrase
        some = own[hot[own] <= HOT]
        raw = [tokens.raw[x:y].tobytes() for x, y in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
        yield _batch(False, trigger[some], np.zeros(len(some), dtype=np.int64), ids[doc[some]], first[some], n[some], times[some], pa.array(raw, type=pa.binary()))
        many = own[hot[own] > HOT]
        each = np.repeat(many, n[many])
        place = np.arange(len(each)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
        window = tokens.digests(begin[each] + place, begin[each] + place + width).view(np.int64)
        yield _batch(True, trigger[each], window, ids[doc[each]], first[each] + place, np.ones(len(each), dtype=np.int32), times[each], pa.nulls(len(each), pa.binary()))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, n in blocks(batch.column(1), STRETCH):
                tokens = to_tokens(*buffer_of(batch.column(1).slice(row, n)))
                for found in phrases_of(ids[row : row + n], tokens, batch.column(2).slice(row, n)):
                    for at in range(0, found.num_rows, 5000):
                        yield found.slice(at, 5000)

    wanted = dictionary.withColumn("doc_id", F.col("first_doc"))
    return by_document(_texts(docs), wanted, ["first_pos", "n", "trigger", "content", "hot", "times"]).mapInArrow(run, SHARD_ROW)


def _batch(hot: bool, trigger, content, doc_id, pos, n, times, payload) -> pa.RecordBatch:
    columns = [np.full(len(trigger), hot), trigger, content, doc_id, pos, n.astype(np.int32), times]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), payload], names=[f.split()[0] for f in SHARD_ROW.split(", ")])


def in_shards(rows: DataFrame, solve: Callable, limit: int) -> DataFrame:
    """(doc_id, pos, n) of windows that solve finds in shards of whole triggers, each of about `limit` payload bytes.

    solve(shard): shard is a list of (trigger, doc_id, pos, n, times, payload) in this order; gives (doc_id, pos, n).
    """

    def run(batches):
        shard, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for row in zip(*columns, strict=True):
                if row[0] != last:
                    if size >= limit:
                        yield _spans(solve(shard))
                        shard, size = [], 0
                    last = row[0]
                shard.append(row)
                size += len(row[5])
        if shard:
            yield _spans(solve(shard))

    cold = rows.filter("not hot").select("trigger", "doc_id", "pos", "n", "times", "payload")
    return cold.repartition("trigger").sortWithinPartitions("trigger", "doc_id", "pos").mapInArrow(run, "doc_id long, pos long, n int")


def _spans(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=pa.int64()), pa.array(columns[2], type=pa.int32())], names=["doc_id", "pos", "n"])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def covered(rows: list[dict], width: int, size: int) -> np.ndarray:
    """Marks the tokens that windows pos..pos+n-1 of `width` tokens cover, in a document of `size` tokens."""
    marks = np.zeros(size + 1, dtype=np.int32)
    for r in rows:
        first, end = min(r["pos"], size), min(r["pos"] + r["n"] + width - 1, size)
        marks[first] += 1
        marks[end] -= 1
    return np.cumsum(marks[:-1]) > 0
