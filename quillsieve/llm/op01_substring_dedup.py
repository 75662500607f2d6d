"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

A word is removed where a window of `width` consecutive words that covers it also starts earlier
(in a smaller doc_id, or earlier in the same document). The corpus is cut into overlapping phrases
(see phrases): a phrase seen before is removed as a whole; the distinct phrases that share a trigger
form reference shards, each with a generalised suffix automaton whose states know their first
occurrence. Streaming a shard's phrases through it gives matching statistics; a position whose
match of `width` words has an earlier first occurrence ends a repeated window. Shards go to tasks
in a shuffle, not in a broadcast, since the repeated text grows with the corpus.

Defined results: null and empty texts have no words and keep the empty text; rows without doc_id are
returned with nothing removed; rows that share a doc_id count as one document, and a span found in one
is removed at the same place in all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.automaton import SuffixAutomaton
from quillsieve.llm.phrases import by_document, covered, in_shards, repeats, shard_rows, word_tokens
from quillsieve.llm.shared import even_join, materialize

GRAM = 5
#: Payload bytes of the phrases in a reference shard: about 20,000 words.
SHARD_BYTES = 160_000


def solve(shard: list[tuple], width: int) -> list[tuple[int, int, int]]:
    """Windows of the shard's phrases whose words start earlier in some phrase of the shard."""
    rank = {d: k for k, d in enumerate(sorted({row[1] for row in shard}))}
    names: dict[int, int] = {}
    automaton, streams = SuffixAutomaton(), []
    for _, doc_id, pos, n, _, payload in shard:
        tokens = [names.setdefault(t, len(names)) for t in np.frombuffer(payload, dtype=np.uint64).tolist()]
        base = (rank[doc_id] << 40) + pos
        automaton.add(tokens, range(base, base + len(tokens)))
        streams.append((doc_id, pos, base, tokens))
    automaton.finish()
    out, first = [], automaton.first
    for doc_id, pos, base, tokens in streams:
        begin = None
        for k, (state, size) in enumerate(automaton.matches(tokens)):
            if size >= width and first[automaton.at_least(state, width)] < base + k:
                begin = k if begin is None else begin
            elif begin is not None:
                out.append((doc_id, pos + begin - width + 1, k - begin))
                begin = None
        if begin is not None:
            out.append((doc_id, pos + begin - width + 1, len(tokens) - begin))
    return out


def repeated_windows(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, pos, n): n consecutive windows from word pos that all start earlier somewhere."""
    found = repeats(docs, word_tokens, width, min(GRAM, width))
    whole = found.marked().filter("not is_first").select("doc_id", "pos", "n")
    rows = materialize(shard_rows(docs, found.dictionary, word_tokens, width))
    parts = in_shards(rows, lambda shard: solve(shard, width), SHARD_BYTES)
    windows = rows.filter("hot").select("trigger", "content", "doc_id", "pos")
    least = windows.groupBy("trigger", "content").agg(F.min(F.struct("doc_id", "pos")).alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    least = materialize(least.select("trigger", "content", "c", F.col("least.doc_id").alias("d"), F.col("least.pos").alias("p")))
    hot = even_join(windows, least, ["trigger", "content"], "c", ["doc_id", "pos"]).filter("doc_id <> d or pos <> p").select("doc_id", "pos", F.lit(1).alias("n"))
    return whole.unionByName(parts).unionByName(hot)


def substring_dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word, words), kept: the words left, joined by one space (UTF-8 bytes)."""

    def run(batches):
        for batch in batches:
            ids, texts, lists = batch.column(0), batch.column(1), batch.column(2)
            for at in range(0, batch.num_rows, 500):
                rows = []
                for text, found in zip(texts.slice(at, 500).to_pylist(), lists.slice(at, 500).to_pylist(), strict=True):
                    words = text.split() if text else []
                    if not found:
                        rows.append((len(words), 0, [], b" ".join(words)))
                        continue
                    gone = covered(found, width, len(words))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    spans = [{"first_word": a, "n_words": b - a} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    kept = [w for a, b in zip([0, *edges[1::2]], [*edges[::2], len(words)], strict=True) for w in words[a:b]]
                    rows.append((len(words), int(gone.sum()), spans, b" ".join(kept)))
                columns = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, 500), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    joined = by_document(plain, repeated_windows(docs, width), ["pos", "n"], "left")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<first_word:long,n_words:long>>, kept binary")
