import pytest
from pyspark.sql import functions as F

from quillsieve.operators import build, probe
from quillsieve.params import FilterConfig
from quillsieve.streaming import ingest


def sizes(layers):
    return [(x.layer, x.depth, x.n_items) for x in layers]


def test_advance_and_aging():
    config = FilterConfig(10, 0.01)
    state, dealt = ingest.advance(ingest.State(), 35, config)
    assert sizes(state.layers) == [(0, 0, 10), (1, 1, 20), (2, 2, 5)]
    assert [(lo, hi) for _, lo, hi in dealt] == [(0, 10), (10, 30), (30, 35)]
    state = ingest.aged(state, 2)
    assert sizes(state.layers) == [(1, 1, 20), (2, 2, 5)]
    state, _ = ingest.advance(state, 40, config)  # fills the 40 of depth 2, then begins at depth 2 again
    assert sizes(state.layers) == [(1, 1, 20), (2, 2, 40), (3, 2, 5)]
    assert ingest.aged(state, 15) == state


def test_an_exactly_full_layer():
    state, _ = ingest.advance(ingest.State(), 10, FilterConfig(10, 0.01))
    assert len(state.layers) == 1


@pytest.fixture
def stream(spark, tmp_path):
    for b in range(3):
        spark.range(b * 100, b * 100 + 100).select(F.col("id").alias("x")).coalesce(1).write.parquet(str(tmp_path / f"in/part={b}"))
    return spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))


def test_stream_equals_batch(spark, tmp_path, stream):
    config = FilterConfig(50, 0.01)
    ingestor = ingest.Ingestor(spark, str(tmp_path / "state"), "x", config)
    q = ingest.ingest(stream, ingestor, str(tmp_path / "log"))
    q.awaitTermination()
    assert [s["rows"] for s in ingest.batch_stats(q)] == [100, 100, 100]
    items = spark.range(300).select(F.col("id").alias("x"), F.col("id").alias("ordinal"))
    plan = config.plan(300)
    key = lambda df: sorted((r.layer, r.bucket, bytes(r.bitmap)) for r in df.collect())
    assert key(ingestor.bits(ingestor.last)) == key(build.packed_bits(items, "x", plan))
    found = probe.probe(items.select("x"), "x", ingestor.bits(ingestor.last), ingestor.plan(ingestor.last))
    assert found.filter("not present").count() == 0
    # An epoch delivered again changes nothing.
    before = key(ingestor.bits(ingestor.last))
    ingestor(spark.range(200, 300).select(F.col("id").alias("x")), ingestor.last)
    assert key(ingestor.bits(ingestor.last)) == before
    assert [r.n_items for r in ingestor.layers(ingestor.last).orderBy("layer").collect()] == [50, 100, 150]


def test_closed_form(spark):
    rows = ingest.layers_after(spark, [35, 40], FilterConfig(10, 0.01), max_layers=2).orderBy("layer").collect()
    assert [(r.layer, r.depth, r.n_items) for r in rows] == [(2, 2, 40), (3, 2, 5)]
