import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsieve.llm import op02_mixture, op04_toxicity, op08_packing, op09_quality, op10_license_scan, queries
from quillsieve.llm.textstats import buffer_of, per_text, word_starts

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", "  \t\n", "one", "Two words", "x y z", "a" * 5000, "mit " * 3000]


def frame(spark, texts=TEXTS, sources=("b", None, "a")):
    rows = [(k, t, sources[k % len(sources)], 9, "clash", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string, start long")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\né", max_size=12), max_size=5))
def test_words_are_counted(texts):
    data, offsets = buffer_of(pa.array([t.encode() for t in texts], type=pa.binary()))
    assert per_text(word_starts(data, offsets), offsets).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_targets():
    assert op02_mixture.targets([100, 100, 100]) == pytest.approx([50, 100, 150])
    assert op02_mixture.targets([1, 1000, 1]) == pytest.approx([3.0, 996.0, 3.0])
    assert sum(op02_mixture.targets([7, 0, 9, 400])) == pytest.approx(416)
    assert op02_mixture.targets([]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 1000))
def test_permutations(n, key):
    to = op02_mixture._permute(np.arange(n), np.full(n, n), np.full(n, key, dtype=np.uint64))
    assert sorted(to.tolist()) == list(range(n))


def test_shards_meet_the_quotas():
    quotas = np.array([10, 0, 333, 57])
    rows = list(op02_mixture.shard_counts(quotas, 50, 1, 0, 8))
    assert [shard for shard, _, _ in rows] == list(range(8))
    assert sum(n for _, _, n in rows).tolist() == quotas.tolist()
    assert all(n.sum() == 50 for _, _, n in rows)
    done = np.zeros(4, dtype=np.int64)
    for _, first, n in rows:  # each shard begins where the one before it ended
        assert first.tolist() == done.tolist()
        done += n
    # Any shards can be drawn alone.
    some = list(op02_mixture.shard_counts(quotas, 50, 1, 3, 5))
    assert [(s, f.tolist(), n.tolist()) for s, f, n in some] == [(s, f.tolist(), n.tolist()) for s, f, n in rows[3:5]]


def targets_brute(sizes, weights=(1, 2, 3)):
    """Shares by weight, then the excess over three times a source's size goes to the others, again and again."""
    from fractions import Fraction

    at, total = {}, Fraction(sum(sizes))
    while True:
        open_ = [k for k in range(len(sizes)) if k not in at]
        left, weight = total - sum(at.values()), sum(weights[k % 3] for k in open_)
        share = {k: left * weights[k % 3] / weight for k in open_}
        over = [k for k in open_ if share[k] > 3 * sizes[k]]
        if not over:
            return [float((at | share)[k]) for k in range(len(sizes))]
        at |= {k: Fraction(3 * sizes[k]) for k in over}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9).filter(lambda x: sum(x) > 0))
def test_targets_against_brute_force(sizes):
    assert op02_mixture.targets(sizes) == pytest.approx(targets_brute(sizes))


def test_mixture_of_rows_that_share_an_id(spark):
    texts = [" ".join(["x"] * n) for n in (3, 5, 5, 900, 17, 40)]
    rows = [(None if k % 2 else 7, t, "a") for k, t in enumerate(texts * 30)]
    got = op02_mixture.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    assert sum(r.taken for r in got) == sum(r["size"] for r in got) == 30 * sum(len(t.split()) for t in texts)


def test_mixture(spark):
    texts = [" ".join(["w"] * (k * 37 % 190)) for k in range(90)] + TEXTS
    got = op02_mixture.mix_sources(frame(spark, texts), block=16, shard_slots=8).collect()
    assert len(got) == len(texts)
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    assert all(r["size"] == sizes[r.doc_id] and r.taken <= 3 * r["size"] for r in got)
    sources = ["a", "b", None]
    by = {s: [k for k in sizes if ("b", None, "a")[k % 3] == s] for s in sources}
    aims = op02_mixture.targets([sum(sizes[k] for k in by[s]) for s in sources])
    for s, aim in zip(sources, aims, strict=True):
        rows = [r for r in got if r.doc_id in set(by[s])]
        assert {r.target for r in rows} == {aim}
        assert abs(sum(r.taken for r in rows) - aim) <= 1
    again = op02_mixture.mix_sources(frame(spark, texts), block=16, shard_slots=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixture_of_nothing(spark):
    assert op02_mixture.mix_sources(frame(spark, [])).count() == 0
    assert [r.taken for r in op02_mixture.mix_sources(frame(spark, ["", None])).collect()] == [0, 0]


ODD = ["It's <|endoftext|> a!!!b <|ENDOFTEXT|>x Áb don't!'s …!foo 12ab..cd …. q<|startoftext|>.", " a　b .. \x00 \x85", "...!?a.'s ,'re word,'ll İ İstanbul", "!'s <| x|> a<|b"]


def test_ids_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe())
    got = op08_packing.Ids(queries.word_bpe())([x.encode() for x in ODD])
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in ODD]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit(sizes):
    bins = op08_packing.best_fit(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    fill = [sum(sizes[i] for i in b) for b in bins]
    assert all(f <= 20 for f in fill)
    assert len(bins) <= max(1, -(-sum(sizes) * 11 // 9 // 20) + 1)


def test_packing(spark):
    texts = [*TEXTS, *ODD, *(" ".join(["token"] * (k * 53 % 2100)) for k in range(120)), "long " * 5000]
    pieces = op08_packing.token_pieces(frame(spark, texts), queries.word_bpe())
    for tasks, slack in ((40_000, 1.1), (20, 1.2)):  # one round, and a tree of rounds
        rows = op08_packing.best_fit_pack(pieces, items_per_task=tasks).toPandas()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(queries.word_bpe())
        expected = set()
        for k, x in enumerate(texts):
            ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
            expected |= {(k, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))}
        assert set(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == expected
        rows = rows.sort_values(["sequence_id", "offset"])
        assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all()
        assert rows.groupby("sequence_id").length.sum().max() <= 2048
        assert rows.sequence_id.nunique() <= slack * rows.length.sum() / 2048 + 1


def test_packing_of_nothing(spark):
    assert op08_packing.best_fit_pack(op08_packing.token_pieces(frame(spark, []), queries.word_bpe())).count() == 0


def licence_brute(text):
    y = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", y)
    hits = [(k, label) for phrase, label in op10_license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


LICENCES = ["Under the MIT License under the mit license", "CC-BY-NC cc by nc by nc cc by", "Apache License, Version 2.0! Apache License, Version 2", "é under the mıt license", "apache license version 20", "the mit license"]


def test_base_matches(spark):
    docs = frame(spark, [*TEXTS, *LICENCES])
    for r in op10_license_scan.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence_brute([*TEXTS, *LICENCES][r.doc_id])
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def labels_of(text):
    return op10_license_scan.scanner(4, 0.5, 12).digest(text.encode())[5]


def test_notices_are_found():
    text = op10_license_scan.TEMPLATES["isc"][0][0].replace("fee is", "fees is")
    assert labels_of("permission is hereby not granted to use this") == ""
    assert labels_of("some words before " + text + " and after") == ""  # not with all that tells it
    assert labels_of("some words before " + op10_license_scan.TEMPLATES["isc"][0][0].replace("any purpose", "some purpose") + " and after") == "isc"
    assert op10_license_scan.scanner(4, 0.5, 12).digest(b"") == (0, 0, None, None, "", "", 0.0, [])


def labels_brute(text):
    """Of whole notices only: those whose words stand in the text one after another, and the phrases."""
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())
    w = " " + " ".join(split(text)) + " "
    found = {label for label, texts in op10_license_scan.TEMPLATES.items() for x, _ in texts if " " + " ".join(split(x)) + " " in w}
    return ",".join(sorted(found | {label for x, label in op10_license_scan.PHRASES.items() if f" {x} " in w}))


@pytest.mark.parametrize("label, text", [(label, x) for label, texts in op10_license_scan.TEMPLATES.items() for x, _ in texts])
def test_every_notice_gives_its_labels_only(label, text):
    assert labels_of("Some words. " + text + " More words.") == labels_brute(text)
    assert label in labels_of(text).split(",")


@pytest.mark.parametrize("text, label", [
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under the Apache License, Version 1.1", ""),
    ("Licensed under the Apache License, Version 1.1 (the License); you may not use this file except in compliance with the License.", ""),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License, not a Creative Commons Attribution-NonCommercial one.", "cc-by"),
    ("either version 2 of the License, or (at your option) any later version", ""),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ""),
])
def test_siblings_are_told_apart(text, label):
    assert labels_of(text) == label


@pytest.mark.parametrize("scores", ["toxic", "quality"])
def test_models_without_labels(spark, scores):
    docs, labels = frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    if scores == "toxic":
        got = op04_toxicity.score_toxicity(docs, op04_toxicity.fit_toxicity(docs, labels)).collect()
        assert {r.score for r in got} == {0.0}
    else:
        got = op09_quality.score_quality(docs, op09_quality.fit_quality(docs, labels)).collect()
        assert {r.score for r in got} == {0.5}
    assert len(got) == len(TEXTS)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def auc(label, score):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    pos = np.asarray(label) == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_nnpu_separates():
    rng = np.random.default_rng(0)
    row = lambda toxic: np.unique(np.concatenate([rng.integers(100, 3000, 40), rng.integers(0, 20, 4) if toxic else []]).astype(np.int32))
    pos, unl = [row(True) for _ in range(300)], [row(k % 10 == 0) for k in range(1500)]
    weights, bias = op04_toxicity.nnpu(pos, unl, 0.1)
    score = lambda x: bias + sum(weights.get(int(f), 0.0) for f in x)
    test = [(k % 2, score(row(k % 2))) for k in range(400)]
    assert auc(*zip(*test, strict=True)) > 0.98
    assert np.mean([s > 0 for y, s in test if not y]) < 0.02


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op9_quality(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(got.quality, got.score) > 0.95


def test_quality_decisions_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op9_quality(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    assert (got.predicted == got.quality).mean() >= 0.9


def test_toxicity_on_held_out_rows(spark):
    """Few labels: 45 toxic rows to learn from. Clean documents are left alone."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op4_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    assert got[got.toxic == 0].predicted.mean() <= 0.05 and auc(got.toxic, got.score) > 0.8


@pytest.mark.parametrize("scores", ["toxic", "quality"])
def test_odd_rows_are_scored(spark, scores):
    words = ["good text here with words", "bad!!! b@d $$$ ###", "idiot words here"]
    rows = [(k, words[k % 3], k) for k in range(60)] + [(5, words[2], 0), (5, words[2], 0), (None, "x", 1), (None, None, 1), (99, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 == 2)) for k in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    f = (lambda d: op04_toxicity.score_toxicity(d, op04_toxicity.fit_toxicity(docs, labels))) if scores == "toxic" else (lambda d: op09_quality.score_quality(d, op09_quality.fit_quality(docs, labels)))
    got = f(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert len({r.score for r in got if r.doc_id == 5}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert f(docs.limit(0)).count() == 0


def test_packing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "the same words " * 20)] * 50 + [(None, "no id")] * 7, "doc_id long, text string")
    rows = op08_packing.best_fit_pack(op08_packing.token_pieces(docs, queries.word_bpe()), items_per_task=10).toPandas()
    assert len(rows) == 57 and rows.doc_id.isna().sum() == 7
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all()


def test_scores_do_not_depend_on_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op04_toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    moved = docs.withColumn("doc_id", F.col("doc_id") + 10**6)
    one = {r.doc_id: r.score for r in op04_toxicity.score_toxicity(docs, model).collect()}
    two = {r.doc_id - 10**6: r.score for r in op04_toxicity.score_toxicity(moved, model).collect()}
    assert one == two


def test_quality_learns_from_all_labelled_rows(spark):
    """More rows of each class than the 4,000 that a sample held."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["ab", "cd", "Ef", "g"], 8)) + ("" if k % 2 else " !!") for k in range(12_000)]
    labels = [(k, k % 2, 0) for k in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    real = op09_quality.bradley_terry
    op09_quality.bradley_terry = lambda table, *a: seen.append(table.count()) or real(table, *a)
    try:
        model = op09_quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    finally:
        op09_quality.bradley_terry = real
    assert seen == [sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(len(texts)))]
    got = op09_quality.score_quality(docs, model).toPandas()
    assert (got.predicted == got.doc_id % 2).mean() > 0.99


def test_loss_over_all_pairs():
    rng = np.random.default_rng(2)
    bad, good = rng.integers(0, 40, 30), rng.integers(10, 60, 50)
    counts = np.stack([np.bincount(bad, minlength=61), np.bincount(good, minlength=61)]).astype(float)
    loss, (of_bad, of_good) = op09_quality.pair_loss(counts)
    apart = (good[:, None] - bad[None, :]) * op09_quality.STEP
    assert loss == pytest.approx(np.logaddexp(0, -apart).mean())
    assert of_bad[bad] == pytest.approx((1 / (1 + np.exp(apart))).mean(axis=0))
    assert of_good[good] == pytest.approx(-(1 / (1 + np.exp(apart))).mean(axis=1))
