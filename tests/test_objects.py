import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsieve.filters import FixedFilter, ScalableFilter

ITEMS = st.one_of(st.text(max_size=6), st.integers(-(2**63), 2**63 - 1), st.binary(max_size=6))


@pytest.mark.parametrize("family", ["sql", "compat"])
def test_batches_and_items(spark, family):
    with ScalableFilter(spark, 100, 0.01, family=family) as f:
        assert f.contains_batch(["a", None]) == [False, None]
        f.add_batch([f"x{k}" for k in range(150)]).add("one").add_batch([])
        assert len(f) == 151 and f.layers().count() == 2
        assert all(f.contains_batch([f"x{k}" for k in range(150)]))
        assert "one" in f and 7 not in f
        f.add(7)
        assert 7 in f and "7" not in f and True not in f


def test_split_batches_give_the_same_bits(spark):
    items = [f"x{k}" for k in range(250)]
    key = lambda f: sorted((r.layer, r.bucket, bytes(r.bitmap)) for r in f.packed.collect())
    one = ScalableFilter(spark, 100, 0.01).add_batch(items)
    two = ScalableFilter(spark, 100, 0.01).add_batch(items[:120]).add_batch(items[120:])
    assert key(one) == key(two)
    df = spark.createDataFrame(list(enumerate(items)), "n long, url string")
    assert key(ScalableFilter(spark, 100, 0.01).add_batch(df, "url", order="n")) == key(one)
    assert one.contains_batch(df, "url").filter(~F.col("present")).count() == 0


def test_saturation_and_union(spark):
    with pytest.raises(ValueError, match="saturated"):
        FixedFilter(spark, 50, 0.01).add_batch([str(k) for k in range(500)])
    a, b = (FixedFilter(spark, 100, 0.01).add_batch([f"{p}{k}" for k in range(40)]) for p in "ab")
    a.union(b)
    assert len(a) == 80 and all(a.contains_batch([f"{p}{k}" for k in range(40) for p in "ab"]))
    with pytest.raises(ValueError):
        a.union(FixedFilter(spark, 200, 0.01))
    with pytest.raises(ValueError):
        FixedFilter(spark, 10, 0.1, family="other")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ITEMS, min_size=1, max_size=30))
def test_no_false_negatives(spark, items):
    assert all(ScalableFilter(spark, 10, 0.05).add_batch(items).contains_batch(items))
