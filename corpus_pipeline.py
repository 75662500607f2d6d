"""A training-data pipeline over `documents`: toxicity, near copies, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in
the shared folder and reads it again as the next stage's docs. All stages but the last return the
columns of documents, and every one works on all rows that the stage before it kept.

Nulls and repeats: rows with null text pass every filter, with nothing to score, shingle or cut; rows
without doc_id have no near copies and nothing removed; rows that share a doc_id are one document to
the near-copy and passage stages and stay or go together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsieve.llm.near_copies import near_copies as near_copy_components
from quillsieve.llm.op02_mixture import mixture
from quillsieve.llm.op04_toxicity import drop_toxic, fit_toxicity
from quillsieve.llm.op05_suffix_dedup import suffix_dedup
from quillsieve.llm.op08_packing import best_fit_pack, token_pieces
from quillsieve.llm.queries import word_bpe
from quillsieve.llm.shared import materialize, small_side, table
from quillsieve.llm.textstats import buffer_of, word_starts


#: Repeated passages of over 50 words go.
PASSAGE_WORDS = 51


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents and the labels, rejects go."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their 5-word shingles or more the one of smallest doc_id stays."""
    found = near_copy_components(docs, shingle=5)
    copies = materialize(found.filter("component_id <> doc_id").select("doc_id").distinct())
    # Rows without doc_id have no key to be dealt by, and no copies.
    return docs.filter("doc_id is not null").join(small_side(copies), "doc_id", "left_anti").select(docs.columns).unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by strings of 51 words (more than 50) that occur elsewhere too go from every text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.col("text").isNull().alias("_no_text"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    cut = suffix_dedup(docs.select("doc_id", "text", row.alias("_row")), width=PASSAGE_WORDS, words=True, keep=["doc_id", "_row"])
    text = F.when(~F.col("_row._no_text"), F.col("kept").cast("string"))
    columns = {c: F.col(f"_row.c{k}") for k, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(columns["n_chars"])
    return cut.select(*(columns[c].alias(c) for c in docs.columns))


def _epochs(text: bytes, takes: list[dict]) -> list[bytes]:
    """What the mix takes of a text in each epoch: the text as it is, or its stretches of words, one to a line."""
    data, offsets = buffer_of(pa.array([text], type=pa.binary()))
    starts = np.flatnonzero(word_starts(data, offsets))
    by_epoch: dict[int, list[tuple[int, int]]] = {}
    for t in sorted(takes, key=lambda t: (t["epoch"], t["from_word"])):
        spans = by_epoch.setdefault(t["epoch"], [])
        if spans and spans[-1][1] == t["from_word"]:
            spans[-1] = (spans[-1][0], t["to_word"])
        else:
            spans.append((t["from_word"], t["to_word"]))
    out = []
    for spans in by_epoch.values():
        if spans == [(0, len(starts))]:
            out.append(text)
        else:
            ends = [*starts.tolist(), len(text)]
            out.append(b"\n".join(text[ends[a] : ends[min(b, len(starts))]].rstrip() for a, b in spans if a < len(starts)))
    return out


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch in which the mix takes words of it, with the words taken."""
    # Rows are known by doc_id, source and text; what is alike in all three is told apart by number and may change places.
    text = F.col("text").cast("binary")
    same = ["doc_id", "source", "_hash"]
    hashed = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    nth = Window.partitionBy(*same)
    placed, takes = mixture(docs.withColumn("_hash", hashed), keep=["_hash"])
    lists = takes.groupBy("src", "start").agg(F.collect_list(F.struct("epoch", "from_word", "to_word")).alias("_takes"))
    placed = placed.filter("size > 0").join(lists, ["src", "start"], "left").select(*(F.col(c).alias(f"_of_{c}") for c in same), F.row_number().over(nth.orderBy("start")).alias("_of_nth"), "_takes")
    schema = docs.schema
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("_row"), "doc_id", "source", hashed.alias("_hash"), text.alias("_text"))
    rows = rows.filter(F.length(F.trim(F.translate(F.col("_row")[f"c{docs.columns.index('text')}"], "\t\n\x0b\x0c\r", "     "))) > 0)
    rows = rows.withColumn("_nth", F.row_number().over(nth.orderBy(F.lit(0))))
    one = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in same]
    joined = rows.join(placed, [*one, F.col("_nth") == F.col("_of_nth")]).filter("_takes is not null").select("_row", "_text", "_takes")
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows, texts = [], []
                for k, (text, takes) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for x in _epochs(text, takes):
                        rows.append(k)
                        texts.append(x.decode("utf-8", "replace"))
                own = part.column(0).take(pa.array(rows, type=pa.int64())).flatten()
                own[at] = pa.array(texts, type=own[at].type)
                if chars is not None:
                    own[chars] = pa.array([len(x) for x in texts], type=pa.int64()).cast(own[chars].type)
                yield pa.RecordBatch.from_arrays(own, names=[f"c{k}" for k in range(len(own))])

    out = joined.mapInArrow(run, ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(schema)))
    return out.select(*(F.col(f"c{k}").alias(f.name) for k, f in enumerate(schema)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, packed into sequences of at most 2048 tokens."""
    return best_fit_pack(token_pieces(docs, word_bpe()))


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("source_mixture", source_mixture),
    ("packing", packing),
]

#: SQL expresses neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
