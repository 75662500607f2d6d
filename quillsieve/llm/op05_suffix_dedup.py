"""Suffix-array dedup by prefix-free parsing, over the UTF-8 bytes of whole texts.

A byte is removed where a string of `width` bytes that covers it also starts anywhere else. Rolling-hash
triggers cut every document into phrases that overlap by width - 1 bytes (see phrases), so every
string of `width` bytes lies in one phrase. The parse (phrase occurrences) gives each distinct phrase
its frequency; the dictionary (distinct phrases that share a trigger) gets a suffix array in shards,
to a depth of `width` bytes. Neighbours in its order that agree to that depth are one string, whose
occurrences in the corpus are the sum of their phrases' frequencies: more than one, and all go.

Defined results: null and empty texts have no bytes; rows without doc_id are returned with nothing
removed; repeated rows are occurrences each, and where rows share a doc_id a span found in one is
removed at the same place in all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.phrases import by_document, byte_tokens, covered, in_shards, repeats, runs, shard_rows, word_bounds, word_tokens
from quillsieve.llm.shared import even_join, materialize
from quillsieve.llm.textstats import buffer_of

#: Bytes, or words, of a trigger.
GRAM, WORD_GRAM = 160, 20
SHARD_BYTES = 400_000


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys among the distinct ones."""
    order = np.argsort(keys)
    in_order = keys[order]
    ranks = np.empty(len(keys), dtype=np.uint64)
    ranks[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])]).astype(np.uint64)
    return ranks


def suffix_order(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their `width` tokens, and for each whether it equals the one before it.

    Prefix doubling over all suffixes, from 8 bytes (or fewer; or one word's 64 bits) to the largest power that
    fits; two such ranks decide a start's place.
    """
    n, have = len(data), 1
    padded = np.concatenate([data, np.zeros(width + 8, dtype=data.dtype)]).astype(np.uint64)
    keys = padded.copy()
    while data.dtype == np.uint8 and have < 8 and 2 * have <= width:
        keys = np.concatenate([(keys[:-have] << np.uint64(8 * have)) | keys[have:], np.zeros(have, dtype=np.uint64)])
        have *= 2
    ranks = _dense(keys[:n])
    while 2 * have <= width:
        later = np.concatenate([ranks[have:], np.zeros(min(have, n), dtype=np.uint64)])[:n]
        ranks = _dense(ranks * np.uint64(n + 1) + later)
        have *= 2
    keys = ranks[starts] * np.uint64(n + 1) + ranks[starts + (width - have)]
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    return order, np.concatenate([[False], in_order[1:] == in_order[:-1]])


def solve(shard: list[tuple], width: int, token: type = np.uint8) -> list[tuple[int, int, int]]:
    """Windows of phrases that the parse holds once, but whose tokens occur elsewhere in the dictionary."""
    data = np.frombuffer(b"".join(row[5] for row in shard), dtype=token)
    begins = np.cumsum([0, *(len(row[5]) // data.itemsize for row in shard)])[:-1]
    counts = np.array([row[3] for row in shard], dtype=np.int64)
    phrase = np.repeat(np.arange(len(shard)), counts)
    ordinal = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
    order, same = suffix_order(data, begins[phrase] + ordinal, width)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(~same) - 1
    times = np.array([row[4] for row in shard], dtype=np.int64)
    total = np.bincount(group, weights=times[phrase])
    again = (total[group] > 1) & (times[phrase] == 1)
    # A stretch must not run on from one phrase to the next.
    gaps = np.insert(again, np.cumsum(counts)[:-1], False) if len(shard) > 1 else again
    first, end = runs(gaps)
    shift = np.searchsorted(np.cumsum(counts + 1), first, side="right")
    out = []
    for a, b, k in zip(first.tolist(), end.tolist(), shift.tolist(), strict=True):
        _, doc_id, pos, _, _, _ = shard[k]
        out.append((doc_id, pos + a - int(counts[:k].sum() + k), b - a))
    return out


def repeated_strings(docs: DataFrame, width: int = 400, words: bool = False) -> DataFrame:
    """(doc_id, pos, n): n consecutive strings of `width` bytes (or words) from pos that occur elsewhere too."""
    tokens, gram, token = (word_tokens, WORD_GRAM, np.uint64) if words else (byte_tokens, GRAM, np.uint8)
    found = repeats(docs, tokens, width, min(gram, max(1, width // 2)))
    whole = found.marked().filter("times > 1").select("doc_id", "pos", "n")
    rows = materialize(shard_rows(docs, found.dictionary, tokens, width))
    parts = in_shards(rows, lambda shard: solve(shard, width, token), SHARD_BYTES)
    windows = rows.filter("hot").select("trigger", "content", "doc_id", "pos", "times")
    several = materialize(windows.groupBy("trigger", "content").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("c")).filter("total > 1").select("trigger", "content", "c"))
    hot = even_join(windows.filter("times = 1"), several, ["trigger", "content"], "c", ["doc_id", "pos"]).select("doc_id", "pos", F.lit(1).alias("n"))
    return whole.unionByName(parts).unionByName(hot)


def _cut_text(text: bytes, found: list[dict], width: int, whole_characters: bool, words: bool) -> tuple[int, bytes]:
    """(spans removed, what is left of a text)."""
    if words:
        starts, ends = word_bounds(*buffer_of(pa.array([text], type=pa.binary())))
        first, end = runs(covered(found, width, len(starts)))
        first, end = starts[first], ends[end - 1]
    else:
        first, end = runs(covered(found, width, len(text)))
    if whole_characters and not words:
        inner = (np.frombuffer(text + b" ", dtype=np.uint8) & 0xC0) == 0x80
        for k in range(len(first)):
            while inner[first[k]]:
                first[k] += 1
            while inner[end[k]]:
                end[k] -= 1
    return len(first), b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(text)], strict=True))


def suffix_dedup(docs: DataFrame, width: int = 400, whole_characters: bool = False, keep: list[str] | None = None, words: bool = False, passages: int | None = None) -> DataFrame:
    """The kept columns (doc_id by default), n_bytes, n_removed, n_spans and kept: the bytes left.

    whole_characters: a span shrinks to the UTF-8 characters that lie in it whole, so that kept is valid text.
    words: strings of `width` words, whatever white space is between them; a span goes from its first word to its last.
    passages: adds n_passage_words, the words covered by strings of so many words that occur elsewhere too; they stay.
    """
    keep = keep or ["doc_id"]

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(len(keep)), batch.column(len(keep) + 1)
            for at in range(0, batch.num_rows, 500):
                rows = []
                for text, found in zip(texts.slice(at, 500).to_pylist(), lists.slice(at, 500).to_pylist(), strict=True):
                    text, by_kind = text or b"", ([], [])
                    for r in found or ():
                        by_kind[r["passage"]].append(r)
                    spans, kept = _cut_text(text, by_kind[0], width, whole_characters, words) if by_kind[0] else (0, text)
                    row = (len(text), len(text) - len(kept), spans, kept)
                    rows.append(row if passages is None else (*row, int(covered(by_kind[1], passages, len(text.split())).sum()) if by_kind[1] else 0))
                columns = list(zip(*rows, strict=True))
                own = [batch.column(k).slice(at, 500) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names=names)

    plain = docs.select(*keep, F.col("text").cast("binary").alias("__text"))
    spans = repeated_strings(docs, width, words).withColumn("passage", F.lit(0))
    if passages is not None:
        spans = spans.unionByName(repeated_strings(docs, passages, words=True).withColumn("passage", F.lit(1)))
    joined = by_document(plain, spans, ["pos", "n", "passage"], "left")
    added = [("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept", "binary", pa.binary())]
    added += [("n_passage_words", "long", pa.int64())] if passages is not None else []
    schema = plain.drop("__text").schema
    for name, kind, _ in added:
        schema = schema.add(name, kind)
    names, types = schema.names, [t for _, _, t in added]
    return joined.mapInArrow(run, schema)
