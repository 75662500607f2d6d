from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillsieve.operators import build, store, telemetry

# Lines as runs report them.
TWO = "begin\n[COMPLETED] Sequential execution time: 4.05 seconds (Wall-Clock)\n[METRIC] Throughput: 1,234,567 items/second\n[METRIC] Throughput: 2,500,000 items/second\n"
CASES = [
    (TWO + "[ANALYSIS] The Asynchronous implementation achieved a 2.02x speedup.\n", 1234567, 2500000, 2.02),
    (TWO + "[ANALYSIS] Execution times are comparable.", 1234567, 2500000, 1.0),
    ("[METRIC] Throughput: 900 items/second", None, None, 1.0),
    ("[METRIC] Throughput: 900 items/second\n[ANALYSIS] The Asynchronous implementation achieved a 1.50x speedup.", None, None, 1.5),
    ("[METRIC] Throughput:\t1 items/second [METRIC] Throughput: 2  items/second [METRIC] Throughput: 3 items/second", 1, 2, 1.0),
    ("Speedup: 3.00x", None, None, 1.0),
    ("", None, None, 1.0),
]


def test_metrics_are_scraped(spark):
    rows = spark.createDataFrame([(k, x[0]) for k, x in enumerate(CASES)], "run int, output string")
    got = rows.select("run", *telemetry.scraped(F.col("output"))).orderBy("run").collect()
    assert [tuple(r)[1:] for r in got] == [x[1:] for x in CASES]


@pytest.mark.parametrize("seconds, faster, speedup", [(8.0, 2.0, 4.0), (2.0, 8.0, 1.0)])
def test_reports_can_be_scraped(spark, seconds, faster, speedup):
    line = telemetry.report_lines(F.lit(1000 / seconds), F.lit(1_000_000 / faster), F.lit(seconds), F.lit(faster))
    got = spark.range(1).select(line.alias("output")).select(*telemetry.scraped(F.col("output"))).first()
    assert tuple(got) == (round(1000 / seconds), 1_000_000 // faster, speedup)


def test_runs_are_merged(spark, tmp_path):
    row = ("a", "insert", "wall", 1, 10, 0)
    left = spark.createDataFrame([(*row, 1.0), ("b", "insert", "wall", None, 10, 0, 2.0)], telemetry.RUNS)
    right = spark.createDataFrame([("b", "insert", "wall", None, 10, 0, 5.0)], telemetry.RUNS)
    assert telemetry.read_runs(spark, f"{tmp_path}/none").count() == 0
    telemetry.write_runs(left, f"{tmp_path}/left")
    got = telemetry.merge_runs(telemetry.read_runs(spark, f"{tmp_path}/left"), right)
    assert sorted((r.architecture, r.seconds) for r in got.collect()) == [("a", 1.0), ("b", 5.0)]


@pytest.mark.parametrize("fan", [2, 3, 1000])
def test_running_sums(spark, fan):
    values = {at: at * 7 % 11 for at in range(0, 60, 3)}
    got = build.running_sum(spark.createDataFrame(list(values.items()), "step long, n long"), "step", "n", fan).collect()
    assert {r.step: r.total for r in got} == {at: sum(v for k, v in values.items() if k <= at) for at in values}
    assert set(got[0].asDict()) == {"step", "n", "total"}


def test_ordinals_of_nothing_and_of_many_partitions(spark):
    rows, n = build.ordered(spark.range(0).select("id"), "id")
    assert n == 0 and rows.count() == 0 and rows.columns == ["id", "ordinal"]
    rows, n = build.ordered(spark.range(0, 1000, 1, 40).select((999 - F.col("id")).alias("id")), "id")
    assert n == 1000 and all(r.id == r.ordinal for r in rows.collect())


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.scratch(session)
