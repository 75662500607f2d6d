import pytest

from quillsieve.operators import stats


def runs(spark):
    rows = [("x", 1, k, float(v)) for k, v in enumerate([9, 9, 1, 2, 3, 4, 5])] + [("y", 1, 2, 7.0)]
    return spark.createDataFrame(rows, "architecture string, workers int, run_idx int, seconds double")


def test_fixture(spark):
    got = {r.architecture: r for r in stats.full_stats(stats.measured(runs(spark)), "architecture").collect()}
    x = got["x"]
    assert (x.n, x.mean, x.median, x.raw_runs) == (5, 3.0, 3.0, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert (x.margin, x.ci_lower, x.ci_upper) == (pytest.approx(1.962928, abs=2e-6), pytest.approx(1.037072, abs=2e-6), pytest.approx(4.962928, abs=2e-6))
    assert got["y"].margin == 0.0


def test_speedups(spark):
    totals = spark.createDataFrame([("seq", 8.0), ("par", 2.0), ("none", 0.0)], "architecture string, total double")
    assert {r.architecture: r.speedup for r in stats.speedup_vs_baseline(totals, "seq").collect()} == {"seq": 1.0, "par": 4.0, "none": 0.0}
    means = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 4.0), ("b", 1, 6.0)], "architecture string, workers int, mean double")
    assert sorted(r.speedup for r in stats.speedup_vs_one_worker(means).collect()) == [1.0, 1.0, 2.0]
    assert {r.baseline for r in stats.weak_baseline(means).collect()} == {8.0}
    chunks = spark.createDataFrame([(10, 3.0), (20, 1.0), (30, 1.0)], "chunk_size int, mean double")
    assert tuple(stats.optimal_chunk(chunks).first()) == (20, 1.0)


def test_report(spark):
    lines = stats.report(stats.mean_ci(runs(spark), "architecture"), "architecture", "mean")
    assert lines[0].split() == ["architecture", "mean"]
    assert len(lines) == 3
