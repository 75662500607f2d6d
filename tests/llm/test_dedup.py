import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from quillsieve.llm import op01_substring_dedup, op05_suffix_dedup, op07_simhash, pairs, phrases, shared

SCHEMA = "doc_id long, text string, source string, trigger int, times string, fp string, content long"


def frame(spark, docs):
    """With extra columns that clash with names used inside."""
    return spark.createDataFrame([(d, t, "s", 1, "x", "y", 5) for d, t in docs], SCHEMA)


def corpus(seed, n=60):
    """Texts of few words, so that all kinds of overlaps arise: copies, near copies, shared passages, loops."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "ß", "日本", " x"]
    passage = " ".join(rng.choices(vocabulary, k=30))
    docs = []
    for d in range(n):
        kind = rng.randrange(6)
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))
        if kind == 0 and docs:
            text = rng.choice(docs)[1]
        elif kind == 1 and docs and docs[-1][1]:
            w = docs[-1][1].split(" ")
            w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        elif kind == 2:
            text = text + "\n" + passage + "\t" + text
        elif kind == 3:
            text = "a b c " * rng.randrange(30)
        docs.append((d * 3 + 1, text))
    return docs + [(0, None), (2, ""), (5, " \n ")]


@pytest.mark.parametrize("seed, hot", [(1, 256), (2, 256), (3, 1), (4, 3)])
def test_substring_dedup(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    docs = corpus(seed)
    got = op01_substring_dedup.substring_dedup(frame(spark, docs), width=6).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.substring_dedup(dict(docs), 6)


def test_the_query_window(spark):
    docs = corpus(7, 80)
    got = op01_substring_dedup.substring_dedup(frame(spark, docs)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.substring_dedup(dict(docs), 20)


def test_long_documents_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STRETCH", 25)
    docs = corpus(5)
    got = op01_substring_dedup.substring_dedup(frame(spark, docs), width=6).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.substring_dedup(dict(docs), 6)


@pytest.mark.parametrize("seed, hot", [(1, 256), (2, 256), (3, 1), (4, 3)])
def test_suffix_dedup(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    docs = corpus(seed)
    got = op05_suffix_dedup.suffix_dedup(frame(spark, docs), width=24).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.suffix_dedup(docs, 24))


def test_whole_characters(spark):
    shared = "日本語テキスト" * 4
    docs = [(1, "é" + shared + "x"), (2, "è" + shared + "y"), (3, "unique")]
    got = op05_suffix_dedup.suffix_dedup(frame(spark, docs), width=24, whole_characters=True).collect()
    texts = {r.doc_id: bytes(r.kept).decode() for r in got}  # valid, though é and è share a byte
    assert texts == {1: "éx", 2: "èy", 3: "unique"}


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(f"t{k}" for k in range(40))
    docs = [(1, text), (1, text), (None, text), (2, "other " + text)]
    got = op01_substring_dedup.substring_dedup(frame(spark, docs), width=20).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 40)]
    got = op05_suffix_dedup.suffix_dedup(frame(spark, docs), width=50).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in got) == [(0, False), (1, True), (1, True), (2, True)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert op01_substring_dedup.substring_dedup(none).count() == 0
    assert op05_suffix_dedup.suffix_dedup(none).count() == 0
    assert op07_simhash.near_duplicates(none).count() == 0


def near_corpus(seed, n=150):
    rng = random.Random(seed)
    docs = []
    for d in range(n):
        w = rng.choices([f"W{k}" for k in range(300)], k=rng.randrange(3, 120))
        if docs and rng.random() < 0.5:
            w = rng.choice(docs)[1].split(" ")
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        docs.append((d * 2, " ".join(w)))
    return docs + [(1001, None), (1003, ""), (1005, "one"), (1007, "ONE"), (1009, "a b c")]


@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 4)])
def test_simhash(spark, monkeypatch, seed, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    docs = near_corpus(seed)
    got = op07_simhash.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in got} == brute.simhash(dict(docs))


def test_simhash_rows_that_share_an_id(spark):
    docs = [(5, "a b c d e f"), (5, "totally different words in this one"), (7, "a b c d e f"), (9, "totally different words in this one"), (None, "a b c d e f")]
    got = op07_simhash.near_duplicates(frame(spark, docs)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(5, 5), (5, 5), (7, 5), (9, 5)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_wide_fingerprints_find_copies_of_similarity(spark):
    rng = random.Random(3)
    base = rng.choices([f"q{k}" for k in range(5000)], k=400)
    docs = [(0, " ".join(base))]
    for d in range(1, 20):
        w = list(base)
        for at in rng.sample(range(400), 4):  # 20 of 400 shingles change: similarity about 0.9
            w[at] = f"n{d}{at}"
        docs.append((d, " ".join(w)))
    docs += [(100 + d, " ".join(rng.choices([f"q{k}" for k in range(5000)], k=300))) for d in range(50)]
    got = {r.doc_id: r.component_id for r in op07_simhash.near_duplicates(frame(spark, docs), shingle=5, words=2, piece=24, max_bits=20).collect()}
    assert all(got[d] == 0 for d in range(20))
    assert all(got[d] == d for d in range(100, 150))


def test_sha_of_an_unchanged_text(spark):
    got = op05_suffix_dedup.suffix_dedup(frame(spark, [(1, "abc\n")])).select(F.sha2("kept", 256)).first()[0]
    assert got == hashlib.sha256(b"abc\n").hexdigest()


@pytest.mark.parametrize("seed, hot", [(1, 256), (3, 1)])
def test_suffix_dedup_of_words(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    docs = corpus(seed)
    split = {d: brute.words(t) for d, t in docs}
    counts = {}
    for w in split.values():
        for k in range(len(w) - 5):
            counts[tuple(w[k : k + 6])] = counts.get(tuple(w[k : k + 6]), 0) + 1
    kept = {}
    for d, w in split.items():
        gone = {j for k in range(len(w) - 5) if counts[tuple(w[k : k + 6])] > 1 for j in range(k, k + 6)}
        kept[d] = [x for j, x in enumerate(w) if j not in gone]
    got = op05_suffix_dedup.suffix_dedup(frame(spark, docs), width=6, words=True).collect()
    assert {r.doc_id: brute.words(bytes(r.kept).decode()) for r in got} == kept


def thue_morse(n, a="a", b="b"):
    return "".join(a if k.bit_count() % 2 == 0 else b for k in range(n))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_clash_in_a_polynomial_hash(spark, size):
    """A Thue-Morse word and its complement: alike to any rolling hash modulo a power of 2."""
    others = " ".join(f"w{k}" for k in range(19))
    docs = [(1, f"{thue_morse(size)} {others}"), (2, f"{thue_morse(size, 'b', 'a')} {others}")]
    got = op01_substring_dedup.substring_dedup(frame(spark, docs), width=20).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}


def test_texts_that_clash_in_a_polynomial_hash(spark):
    docs = [(1, thue_morse(4096)), (2, thue_morse(4096, "b", "a")), (3, thue_morse(4096, "a ", "b ")), (4, thue_morse(4096, "b ", "a "))]
    got = op05_suffix_dedup.suffix_dedup(frame(spark, docs), width=1500).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.suffix_dedup(docs, 1500))
    got = op01_substring_dedup.substring_dedup(frame(spark, docs), width=1500).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.substring_dedup(dict(docs), 1500)


@pytest.mark.parametrize("hot", [256, 1])
def test_keys_of_many_rows_are_dealt_over_tasks(spark, monkeypatch, hot):
    monkeypatch.setattr(shared, "EVEN", 2)
    monkeypatch.setattr(phrases, "HOT", hot)
    line = " ".join(f"l{k}" for k in range(9))
    docs = corpus(11) + [(1000 + k, f"u{k} v{k} {line} x{k} {line}") for k in range(40)]
    got = op01_substring_dedup.substring_dedup(frame(spark, docs), width=6).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.substring_dedup(dict(docs), 6)
    got = op05_suffix_dedup.suffix_dedup(frame(spark, docs), width=24).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.suffix_dedup(docs, 24))


def test_passages_are_counted(spark):
    passage = " ".join(chr(97 + k % 26) for k in range(60))  # 119 bytes
    docs = [(1, f"x {passage} y"), (2, f"{passage}\t\nz"), (3, " ".join(passage.split()[:50])), (4, None), (None, passage)]
    got = op05_suffix_dedup.suffix_dedup(frame(spark, docs), passages=51).collect()
    assert {r.doc_id: (r.n_removed, r.n_passage_words) for r in got} == {1: (0, 60), 2: (0, 60), 3: (0, 0), 4: (0, 0), None: (0, 0)}
