import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsieve.llm import near_copies, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        assert docs.dtypes == columns, name
        assert docs.count() > 0
        if name in ("toxicity", "near_copies"):
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.fixture
def odd(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(1, text, "en", "a", 5), (2, text, "en", None, 5), (3, None, None, "a", None), (4, "", "en", "a", 0), (None, "some other text", None, None, None), (7, "unique words " * 3, "en", "b", 9), (7, "unique words " * 3, "en", "b", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_odd_rows(spark, odd, stage):
    got = stage[1](spark, odd, SF).collect()
    kept = sorted((r.doc_id or 0) for r in got)
    if stage[0] == "toxicity":
        assert len(got) == 7
    elif stage[0] == "near_copies":
        assert kept == [0, 1, 3, 7, 7]  # 2 copies 1; 4 is as empty as 3
    elif stage[0] == "repeated_passages":
        assert kept == [0, 1, 2, 3, 4, 7, 7]
        assert {r.doc_id: r.text for r in got}[1] == "" and {r.doc_id: r.text for r in got}[3] is None


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_tables(spark, odd, stage):
    assert stage[1](spark, odd.limit(0), SF).count() == 0


def test_mixture_takes_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.source_mixture(spark, docs, SF).toPandas()
    whole = docs.toPandas()
    total = whole.text.str.split().str.len().sum()
    assert abs(mixed.text.str.split().str.len().sum() - total) <= 0.02 * total
    assert (mixed.groupby("doc_id").size() <= 4).all()


def test_passages_go(spark):
    passage = " ".join(f"p{k}" for k in range(150))
    docs = spark.createDataFrame([(k, f"begin{k} {passage} end{k} ", "en", "s", 0) for k in range(5)] + [(9, "clean text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert got[9].text == "clean text" and got[9].n_chars == 10
    assert all("p75" not in got[k].text and f"begin{k}" in got[k].text and got[k].n_chars == len(got[k].text) for k in range(5))


def altered(seed, n, edits):
    """Two texts of n words, the second with `edits` words far apart replaced, and their Jaccard similarity."""
    first = [f"s{seed}w{k}" for k in range(n)]
    second = list(first)
    for k in range(edits):
        second[10 + 20 * k] = f"s{seed}x{k}"
    a, b = ({tuple(w[k : k + 5]) for k in range(n - 4)} for w in (first, second))
    return " ".join(first), " ".join(second), len(a & b) / len(a | b)


def test_near_copies_from_a_similarity_of_8_in_10(spark):
    pairs = [altered(k, 304 + 20 * (k % 3), 6) for k in range(200)]
    assert all(0.8 <= s < 0.84 for _, _, s in pairs)
    rows = [(2 * k + at, p[at], "en", "s", 0) for k, p in enumerate(pairs) for at in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == list(range(0, 400, 2))


def test_near_copies_are_linked_by_fingerprints(spark, monkeypatch):
    """The bands only propose: what op7's operator does not link stays, save equal sets."""
    pairs = [altered(k, 304, 3) for k in range(20)]
    rows = [(3 * k + at, p[min(at, 1)], "en", "s", 0) for k, p in enumerate(pairs) for at in (0, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect())
    assert kept() == list(range(0, 60, 3))
    monkeypatch.setattr(near_copies, "link_fingerprints", lambda points, *_, **__: points.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0))
    assert kept() == [k for k in range(60) if k % 3 < 2]


def test_near_copies_whatever_is_repeated_and_however_short(spark):
    """Fingerprints are of distinct shingles; sets of 5 and 4 shingles are the ones whose bits differ most at 0.8."""
    line = " ".join(f"l{k}" for k in range(14))
    pairs = [(a + f"\n{line}" * 30, f"{b}\n{line}\n{line}") for a, b, _ in (altered(k, 304, 4) for k in range(50))]
    pairs += [(" ".join(f"d{k}w{j}" for j in range(9)), " ".join(f"d{k}w{j}" for j in range(8))) for k in range(500)]
    rows = [(2 * k + at, p[at], "en", "s", 0) for k, p in enumerate(pairs) for at in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == list(range(0, 1100, 2))


def test_clean_documents_with_a_repeated_line_stay(spark):
    line = " ".join(f"l{k}" for k in range(14))
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(304)) + f"\n{line}" * 30, "en", "s", 0) for k in range(40)]
    # Half and three quarters of the shingles in common: no copies either.
    rows += [(100 + 2 * k + at, altered(1000 + k, 304, edits)[at], "en", "s", 0) for k, edits in enumerate([9, 10, 12, 14] * 5) for at in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_copies(spark, docs, SF).count() == 80


@pytest.mark.parametrize("size, gone", [(51, True), (50, False)])
def test_passages_of_more_than_50_words_go(spark, size, gone):
    passage = [chr(97 + k % 26) * (1 + k // 26) for k in range(size)]  # short words: 51 of them are 126 bytes
    docs = spark.createDataFrame([(k, f"begin{k} é{k}\t{sep.join(passage)}\nend{k}", "en", "s", 0) for k, sep in enumerate([" ", " ", "\n"])], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert got == ({k: f"begin{k} é{k}\t\nend{k}" for k in range(3)} if gone else before)


def test_rows_get_their_own_takes(spark):
    """Of one doc_id, or of none: longer in bytes but not in words, and in several sources."""
    texts = [" ".join(f"{'x' * (40 if size < 15 else 1)}{s}{d}w{k}" for k in range(size)) for s in "abc" for d, size in enumerate([10, 20, 12, 20])]
    rows = [(None if k % 4 > 1 else 7, t, "en", "abc"[k // 4], 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed, takes = corpus_pipeline.mixture(docs)
    aims = {r.source: round(r.target) for r in placed.select("source", "target").distinct().collect()}
    got = corpus_pipeline.source_mixture(spark, docs, SF).collect()
    words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in "abc"}
    assert words == aims
    assert all(any(r.text in t for t in texts) for r in got)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_other_columns_may_clash(spark, odd, stage):
    """Columns named like ones used inside are carried along."""
    names = ["_copy", "_row", "_hash", "_nth", "_takes", "component_id", "src", "start", "size", "__rows", "node"]
    docs = odd
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    got = stage[1](spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[name] == k for r in rows for k, name in enumerate(names))


def test_many_rows_without_id(spark, odd):
    """Rows without doc_id have no key: they pass the stages that drop and cut by it."""
    docs = spark.createDataFrame([(None, f"text number {k % 3}", "en", "s", 5) for k in range(40)], odd.schema)
    assert corpus_pipeline.near_copies(spark, docs, SF).count() == 40
    assert sorted(r.text for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()) == sorted(r.text for r in docs.collect())
    assert sum(len(r.text.split()) for r in corpus_pipeline.source_mixture(spark, docs, SF).collect()) == 120


# Stages against plain versions, on all documents of a table --------------------------------------------------------

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, {r.doc_id: r for r in docs.collect()}


def test_toxicity_against_scores(spark, small):
    docs, rows = small
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, SMALL).collect()}
    predicted = {r.doc_id: r.predicted for r in queries.op4_toxicity(spark, SMALL).collect()}
    assert kept == {d for d in rows if not predicted[d]}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert sum(d not in kept for d, toxic in labels.items() if not toxic) <= 0.05 * len(labels)


def test_near_copies_against_brute_force(spark, small):
    docs, rows = small
    sets = {}
    for d, r in rows.items():
        w = brute.words(brute.lower(r.text))
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    holders, common = {}, {}
    for d in sorted(sets):
        for s in sets[d]:
            for other in holders.setdefault(s, []):
                common[other, d] = common.get((other, d), 0) + 1
            holders[s].append(d)
    links = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = [d for d in sets if not sets[d]]
    roots = brute.roots(list(sets), links + list(zip(empty, empty[1:], strict=False)))
    got = {r.doc_id: r for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()}
    assert set(got) == {d for d, root in roots.items() if d == root}
    assert all(got[d] == rows[d] for d in got)


def test_repeated_passages_against_brute_force(spark, small):
    docs, rows = small
    split = {d: brute.words(r.text) for d, r in rows.items()}
    counts = Counter(tuple(w[k : k + 51]) for w in split.values() for k in range(len(w) - 50))
    expected = {}
    for d, w in split.items():
        gone = {j for k in range(len(w) - 50) if counts[tuple(w[k : k + 51])] > 1 for j in range(k, k + 51)}
        expected[d] = [x for j, x in enumerate(w) if j not in gone]
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, SMALL).collect()}
    assert {d: brute.words(r.text) for d, r in got.items()} == expected
    assert all(got[d] == rows[d] for d in rows if len(expected[d]) == len(split[d]))


def test_mixture_against_plain_targets(spark, small):
    docs, rows = small
    sizes = Counter()
    for r in rows.values():
        sizes[r.source] += len(brute.words(r.text))
    names = sorted(sizes)
    weights = [1 + k % 3 for k in range(len(names))]
    aims = {s: sum(sizes.values()) * w / sum(weights) for s, w in zip(names, weights, strict=True)}
    assert all(aims[s] <= 3 * sizes[s] for s in names)  # no excess to share again in this table
    taken, by_doc = Counter(), Counter()
    for r in corpus_pipeline.source_mixture(spark, docs, SMALL).collect():
        w = brute.words(r.text)
        taken[r.source] += len(w)
        by_doc[r.doc_id] += len(w)
        assert r.source == rows[r.doc_id].source and not Counter(w) - Counter(brute.words(rows[r.doc_id].text))
    assert all(abs(taken[s] - aims[s]) <= 1 for s in names)
    assert all(n <= 3 * len(brute.words(rows[d].text)) for d, n in by_doc.items())


def test_packing_against_the_tokenizer(spark, small):
    from tokenizers import Tokenizer

    docs, rows = small
    t = Tokenizer.from_file(queries.word_bpe())
    expected = set()
    for d, r in rows.items():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected |= {(d, p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], dtype="<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))}
    got = corpus_pipeline.packing(spark, docs, SMALL).toPandas()
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == expected
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= 1.01 * got.length.sum() / 2048 + 1
