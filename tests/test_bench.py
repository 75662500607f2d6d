import pytest

import bench

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("mode, layout", [("synthetic", "base"), ("real", "striped"), ("synthetic", "striped_joined")])
def test_base_suite(spark, mode, layout):
    clocks = bench.base_suite(spark, SF, mode, 2000, 300, layout)
    assert set(clocks.wall) == set(clocks.cpu) == {f"{layout}_insert", f"{layout}_query"}
    assert all(x > 0 for x in [*clocks.wall.values(), *clocks.cpu.values()])


def test_io_suite(spark, capsys):
    clocks = bench.io_suite(spark, SF, "synthetic", 2000, 3)
    assert set(clocks.wall) == {"io_batch", "io_stream", "io_stream_source", "io_stream_work"}
    assert clocks.wall["io_stream_work"] <= clocks.wall["io_stream"]
    assert capsys.readouterr().err.count("[METRIC] Throughput: ") == 2


def test_scaling(spark):
    clocks = bench.scaling(spark, 2, 2000, 500)
    assert {"strong_1", "strong_2", "weak_1", "weak_2", "chunk_10000", "chunk_1000000"} <= set(clocks.wall)
