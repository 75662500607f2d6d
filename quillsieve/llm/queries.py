"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm import oracles
from quillsieve.llm.op01_substring_dedup import substring_dedup
from quillsieve.llm.op02_mixture import mix_sources
from quillsieve.llm.op03_neighbours import nearest
from quillsieve.llm.op04_toxicity import fit_toxicity, score_toxicity
from quillsieve.llm.op05_suffix_dedup import suffix_dedup
from quillsieve.llm.op06_embedding_dedup import near_vectors
from quillsieve.llm.op07_simhash import near_duplicates
from quillsieve.llm.op08_packing import best_fit_pack, token_pieces
from quillsieve.llm.op09_quality import fit_quality, score_quality, stored_features
from quillsieve.llm.op10_license_scan import scan_licenses
from quillsieve.llm.shared import table


#: Passages of over 50 words: op5 counts them, the pipeline removes them.
PASSAGE_WORDS = 51


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), width=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"), width=400, passages=PASSAGE_WORDS)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(token_pieces(table(spark, sf_dir, "documents"), word_bpe()))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stored_features(table(spark, sf_dir, "documents"))
    return score_quality(known, fit_quality(known, table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_source_mixture": op2_source_mixture,
    "op3_nearest_vectors": op3_nearest_vectors,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_near_vectors": op6_near_vectors,
    "op7_simhash": op7_simhash,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op1_substring_dedup": oracles.SUBSTRING_DEDUP, "op5_suffix_dedup": oracles.SUFFIX_DEDUP, "op6_near_vectors": oracles.NEAR_VECTORS, "op7_simhash": oracles.SIMHASH}
