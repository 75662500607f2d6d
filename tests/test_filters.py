import pytest
from pyspark.sql import functions as F

from quillsieve.operators import build, metrics, probe, store
from quillsieve.params import FilterConfig, fixed
from quillsieve.sources.generators import labelled


def compat_filter(spark, prefix, n, config):
    items = labelled(spark, prefix, n)
    plan = config.plan(n)
    bits = build.compat_bits(items, "item", plan, config)
    return items, plan, bits


# Set bits by an independent model of the contract.
@pytest.mark.parametrize(
    "prefix, n, capacity, rate, layers",
    [("item_pos_", 500, 1000, 0.01, [(14378, 10, 4217)]), ("known_", 8000, 5000, 0.05, [(55139, 8, 28527), (112471, 8, 21608)]), ("scale_test_", 300, 100, 0.01, [(1438, 10, 725), (2920, 10, 1465)])],
)
def test_golden_bits(spark, prefix, n, capacity, rate, layers):
    config = FilterConfig(capacity, rate)
    items, plan, bits = compat_filter(spark, prefix, n, config)
    got = {r.layer: (r.m, r.k, r.set_bits) for r in metrics.layer_metrics(bits, plan).collect()}
    assert [got[k] for k in sorted(got)] == layers
    found = probe.probe_local(items, "item", build.pack(bits), plan, config, family="compat")
    assert found.filter("not present").count() == 0


def test_golden_false_positives(spark):
    config = FilterConfig(5000, 0.05)
    _, plan, bits = compat_filter(spark, "known_", 8000, config)
    found = probe.probe_local(labelled(spark, "unknown_", 5000), "item", build.pack(bits), plan, config, family="compat")
    assert found.filter("present").count() == 32


@pytest.mark.parametrize("scheme, wrap", [("h1", False), ("h1", True), ("hash32", False)])
def test_striped_compat(spark, scheme, wrap):
    config = FilterConfig(500, 0.05, tightening=None, stripes=3, wrap64=wrap)
    items = labelled(spark, "known_", 1200)
    plan = config.plan(1200)
    packed = build.pack(build.compat_bits(items, "item", plan, config, scheme))
    assert probe.probe_local(items, "item", packed, plan, config, "compat", scheme).filter("not present").count() == 0
    absent = probe.probe_local(labelled(spark, "unknown_", 3000), "item", packed, plan, config, "compat", scheme)
    assert absent.filter("present").count() / 3000 <= 1.3 * 0.05


@pytest.mark.parametrize("stripes", [1, 4])
def test_relational_and_local_probes_agree(spark, stripes):
    config = FilterConfig(200, 0.2, tightening=None if stripes > 1 else 0.9, stripes=stripes)
    items = labelled(spark, "a", 900)
    plan = config.plan(900)
    rows = build.bit_rows(items, "item", plan, stripes)
    packed = build.packed_bits(items, "item", plan, stripes)
    asked = labelled(spark, "a", 1800).unionByName(spark.createDataFrame([(0, None), (1, "")], "ordinal long, item string"))
    one = {r.item: r.present for r in probe.probe(asked, "item", rows, plan, stripes).collect()}
    two = {r.item: r.present for r in probe.probe_local(asked, "item", packed, plan, config).collect()}
    assert one == two
    assert one[None] is None
    assert all(one[f"a{k}"] for k in range(900))
    assert packed.agg(F.sum(F.bitmap_count("bitmap"))).first()[0] == rows.count()


def test_empty_filter_has_nothing(spark):
    plan = fixed(100, 0.01)
    empty = build.packed_bits(spark.createDataFrame([], "item string"), "item", plan)
    found = probe.probe(labelled(spark, "a", 10), "item", empty, plan)
    assert found.filter("present").count() == 0
    assert metrics.layer_metrics(empty, plan).first().set_bits == 0
    assert metrics.popcount(empty).first().set_bits == 0


def test_duplicates_consume_capacity(spark):
    items = spark.range(250).select(F.col("id").alias("ordinal"), F.lit("same").alias("item"))
    plan = FilterConfig(100, 0.01).plan(250)
    counts = {r.layer: r.n_items for r in build.layer_counts(items, plan).collect()}
    assert counts == {0: 100, 1: 150}


def test_batches_and_merges(spark):
    plan = fixed(500, 0.01)
    a, b = labelled(spark, "a", 200), labelled(spark, "b", 200)
    both = build.packed_bits(a.unionByName(b), "item", plan)
    pa, pb = build.packed_bits(a, "item", plan), build.packed_bits(b, "item", plan)
    key = lambda df: sorted((r.layer, r.stripe, r.bucket, bytes(r.bitmap)) for r in df.collect())
    assert key(store.union_filters(pa, pb)) == key(store.union_filters(pb, pa)) == key(both)
    assert key(store.union_filters(pa, pa)) == key(pa)


def test_order_inside_a_layer_is_free(spark):
    plan = FilterConfig(300, 0.01).plan(200)
    items = labelled(spark, "a", 200)
    reverse = items.withColumn("ordinal", 199 - F.col("ordinal"))
    rows = lambda df: sorted(tuple(r) for r in build.bit_rows(df, "item", plan).collect())
    assert rows(items) == rows(reverse)


def test_save_and_load(spark, tmp_path):
    plan = FilterConfig(50, 0.01).plan(200)
    packed = build.packed_bits(labelled(spark, "a", 200), "item", plan)
    store.save_filter(packed, plan, str(tmp_path / "f"))
    again, plan2 = store.load_filter(spark, str(tmp_path / "f"))
    assert plan2 == plan
    assert probe.probe(labelled(spark, "a", 200), "item", again, plan2).filter("not present").count() == 0


def test_ordinals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = build.with_ordinal(df.repartition(7), "x").collect()
    assert sorted((r.x, r.ordinal) for r in rows) == [(k, k) for k in range(1000)]
    assert build.with_ordinal(df.limit(0), "x").count() == 0


def test_saturation_raises(spark):
    found = metrics.saturation(labelled(spark, "a", 1000), "item", fixed(100, 0.01))
    with pytest.raises(ValueError, match="saturated"):
        metrics.require_unsaturated(found)
    metrics.require_unsaturated(metrics.saturation(labelled(spark, "a", 100), "item", fixed(100, 0.01)))


def test_saturation_replay(spark):
    plan = fixed(100, 0.01)
    rows = metrics.saturation(labelled(spark, "a", 400), "item", plan).collect()
    for r in rows:
        prefix = build.bit_rows(labelled(spark, "a", int(r.inserted)), "item", plan).count()
        assert r.set_bits == prefix


def test_verdicts_and_rates(spark):
    probed = spark.createDataFrame([(True,), (False,), (False,), (False,)], "present boolean")
    r = metrics.empirical_rate(probed).first()
    assert (r.false_positives, r.probes, r.fpr) == (1, 4, 0.25)
    assert metrics.empirical_rate(probed.limit(0)).first().fpr == 0.0
    one = spark.createDataFrame([(0.054,)], "fpr double")
    assert one.select(metrics.verdict(F.col("fpr"), 0.05, True), metrics.verdict(F.col("fpr"), 0.05, False)).first() == (True, True)


def test_prefiltered_join(spark):
    left = spark.range(1000).select(F.col("id").alias("k"))
    right = spark.range(0, 1000, 10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plan = fixed(100, 0.01)
    packed = build.packed_bits(right, "k", plan)
    assert probe.prefiltered_join(left, right, "k", packed, plan).count() == 100


def test_large_filters_are_not_broadcast(spark):
    with pytest.raises(ValueError):
        probe.probe_local(labelled(spark, "a", 1), "item", spark.createDataFrame([], "layer int, stripe int, bucket long, bitmap binary"), fixed(10**9, 0.001))


@pytest.mark.parametrize("scheme, stripes", [("h1", 1), ("h1", 3), ("hash32", 3)])
def test_both_probes_agree_on_compat_filters(spark, monkeypatch, scheme, stripes):
    config = FilterConfig(60, 0.05, stripes=stripes)
    items = labelled(spark, "in_", 300)
    plan = config.plan(300)
    packed = build.pack(build.compat_bits(items, "item", plan, config, scheme))
    asked = items.select("item").unionByName(labelled(spark, "out_", 300).select("item")).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS item"))
    local = probe.probe_by_size(asked, "item", packed, plan, config, "compat", scheme).collect()
    monkeypatch.setattr(probe, "BROADCAST_BYTES", 0)
    joined = probe.probe_by_size(asked, "item", packed, plan, config, "compat", scheme).collect()
    assert {r.item: r.present for r in local} == {r.item: r.present for r in joined}
    assert len(joined) == 601 and all(r.present for r in joined if r.item and r.item.startswith("in_"))
