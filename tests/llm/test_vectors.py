import os

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsieve.llm import op03_neighbours, op06_embedding_dedup, pairs
from quillsieve.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, node long, digest string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(v, x, 0, 1, "d", 2) for v, x in rows], SCHEMA)


def clustered(seed=1, n=260):
    rng = np.random.default_rng(seed)
    rows = []
    for v in range(n):
        x = rng.standard_normal(16)
        if rows and rng.random() < 0.5:
            x = np.array(rows[rng.integers(len(rows))][1]) * rng.uniform(0.5, 2) + 0.08 * rng.standard_normal(16) * (rng.random() < 0.8)
        rows.append((v, [float(np.float32(y)) for y in x]))
    rows += [(n + k, rows[0][1]) for k in range(30)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    return rows + [(1000 + k, x) for k, x in enumerate(odd)]


@pytest.mark.parametrize("block", [2048, 8])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rows = clustered()
    got = op06_embedding_dedup.near_vectors(frame(spark, rows), threshold=0.9, tables=40, bits=4).collect()
    expected = brute.near_vectors(dict(rows), 0.9)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert op06_embedding_dedup.near_vectors(frame(spark, [])).count() == 0
    assert op03_neighbours.nearest(frame(spark, []), F.col("vec_id") % 2 == 0).count() == 0


def test_nearest(spark):
    rows = clustered(2, 400)
    valid = {v: np.array(x, dtype=float) for v, x in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    got = op03_neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r)
    queries = [v for v in valid if v % 20 == 0 and len(valid[v]) == 16]
    assert set(by) == set(queries)
    hits = 0
    for q in queries:
        scores = {v: float(x @ valid[q]) for v, x in valid.items() if v != q and len(x) == 16}
        exact = sorted(scores, key=lambda v: (-scores[v], v))[:5]
        assert [r.rank for r in by[q]] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - scores[r.vec_id]) < 1e-12 for r in by[q])
        assert [(-r.score, r.vec_id) for r in by[q]] == sorted((-r.score, r.vec_id) for r in by[q])
        hits += len(set(exact) & {r.vec_id for r in by[q]})
    assert hits >= 0.9 * 5 * len(queries)


def test_few_candidates_and_copies(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])]
    got = op03_neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]


def test_perturbations_come_in_order_of_success():
    found = op03_neighbours.perturbations(4, 20)
    assert found[0] == () and found[1] == (0,) and len(set(found)) == 20
    assert not any(7 - p in places for places in found for p in places)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(max(a, b)), int(min(a, b))) for a, b in rng.integers(0, 300, (220, 2)) if a != b]
    edges += [(k + 1, k) for k in range(400, 430)] + [(500 + k, 500) for k in range(1, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    expected = brute.roots(nodes, edges)
    assert {n: got.get(n, n) for n in nodes} == expected


def recall(spark, x):
    """Of all rows' 20 nearest, and the length of each list."""
    got: dict = {}
    for r in op03_neighbours.nearest(frame(spark, [(v, row.tolist()) for v, row in enumerate(x)]), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score, hits = x @ x.T, []
    np.fill_diagonal(score, -np.inf)
    for q in range(0, len(x), 20):
        best = np.argsort(-score[q], kind="stable")[: min(20, len(x) - 1)]
        assert len(got.get(q, ())) == len(best)
        hits.append(len(got[q] & set(best.tolist())) / len(best))
    return np.mean(hits)


def unit(seed, n):
    x = np.random.default_rng(seed).standard_normal((n, 64)).astype(np.float32).astype(float)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)


@pytest.mark.parametrize("n", [15, 21])
def test_few_vectors_are_all_found(spark, n):
    assert recall(spark, unit(n, n)) == 1


@pytest.mark.parametrize("times", [10, 1000])
def test_recall_does_not_depend_on_the_longest_row(spark, times):
    x = unit(5, 1200)
    x[7] *= times
    found = recall(spark, x)
    print("recall", times, found)
    assert found >= 0.95


def test_rows_that_share_an_id_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 3.0]), (1, [0.5, 0.0]), (None, [9.0, 9.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op03_neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect())
    one = [(0, 1, 0, 1.0), (0, 2, 1, 0.5), (0, 3, 0, 0.0)]  # of either of the two equal rows
    assert got == sorted([*one, *one, (0, 1, 0, 0.0), (0, 2, 0, 0.0), (0, 3, 1, 0.0)])


def test_signs_are_packed():
    sigs = np.random.default_rng(1).integers(0, 1 << 10, (7, 24))
    import pyarrow as pa

    words, back = op06_embedding_dedup.unpacked(pa.array(op06_embedding_dedup.packed(sigs, 10), type=pa.binary()), 24, 10)
    assert (back == sigs).all() and words.shape == (7, 4)
    apart = sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(sigs[0], sigs[1], strict=True))
    assert int(np.bitwise_count(words[0] ^ words[1]).sum()) == apart


def test_large_clusters_count_all_links(spark):
    """A cluster whose members meet in many tables, beside a pair that barely links and one that barely does not."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    rows = [(k, (centre + 0.1 * rng.standard_normal(64)).tolist()) for k in range(400)]
    other = rng.standard_normal(64)
    off = rng.standard_normal(64)
    off -= off @ other / (other @ other) * other
    for k, cosine in enumerate((0.93, 0.89)):
        at = 1000 + 10 * k
        rows += [(at, (other * (1 + k) if k == 0 else -other).tolist()), (at + 1, ((1 if k == 0 else -1) * (cosine * other / np.linalg.norm(other)) + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off)).tolist())]
    rows = [(v, [float(np.float32(y)) for y in x]) for v, x in rows]
    got = op06_embedding_dedup.near_vectors(frame(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute.near_vectors(dict(rows), 0.9)


def test_nearest_writes_a_few_times_its_vectors(spark):
    """Shuffle files and stored tables, in bytes of the vectors."""
    from quillsieve.llm.shared import shared_dir

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(True).iterator()
        total = 0
        while executors.hasNext():
            total += executors.next().totalShuffleWrite()
        top = shared_dir(spark).removeprefix("file://")
        return total + sum(os.lstat(f"{d}/{f}").st_size for d, _, names in os.walk(top) for f in names)

    x = unit(8, 6000)
    rows = frame(spark, [(v, row.tolist()) for v, row in enumerate(x)])
    before = written()
    assert op03_neighbours.nearest(rows, F.col("vec_id") % 20 == 0).count() == 300 * 20
    assert written() - before < 4 * x.size * np.dtype(np.float32).itemsize
