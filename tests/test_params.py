import pytest

from quillsieve.params import FilterConfig, bits_for, compound_rate, fixed


def test_sizes():
    assert bits_for(100_000, 0.05 * 0.1) == (1_102_776, 8)
    assert bits_for(50_000, 0.05) == (311_762, 4)


@pytest.mark.parametrize("capacity, rate", [(0, 0.1), (-1, 0.1), (10, 0.0), (10, 1.0)])
def test_invalid_sizes(capacity, rate):
    with pytest.raises(ValueError):
        bits_for(capacity, rate)


@pytest.mark.parametrize("bad", [{"capacity": 0}, {"fp_rate": 1.0}, {"tightening": 1.0}, {"growth": 1}, {"stripes": 0}])
def test_invalid_configs(bad):
    with pytest.raises(ValueError):
        FilterConfig(**({"capacity": 10, "fp_rate": 0.1} | bad))


@pytest.mark.parametrize(
    "items, capacity, rate, layers, last_m, last_k, total",
    [(3_000_000, 100_000, 0.05, 5, 19_047_888, 8, 36_335_120), (1_500_000, 100_000, 0.05, 4, 9_348_509, 8, 17_287_232), (5_000_000, 200_000, 0.01, 5, 48_815_245, 11, 93_439_209), (5_000_000, 50_000, 0.01, 7, 50_218_728, 11, 98_337_026), (300_000, 100_000, 0.01, 2, 2_919_377, 10, 4_357_136)],
)
def test_plans(items, capacity, rate, layers, last_m, last_k, total):
    plan = FilterConfig(capacity, rate).plan(items)
    assert (len(plan), plan[-1].m, plan[-1].k, sum(x.m for x in plan)) == (layers, last_m, last_k, total)
    assert compound_rate(plan) <= rate


def test_a_full_layer_begins_no_other():
    config = FilterConfig(100, 0.01)
    assert [len(config.plan(n)) for n in (0, 1, 100, 101, 300, 301)] == [1, 1, 1, 2, 2, 3]


def test_striped_rule():
    plan = FilterConfig(100, 0.05, tightening=None, stripes=3).plan(1000)
    assert {x.fp_rate for x in plan} == {0.1 * 0.05}
    m, _ = bits_for(100, 0.1 * 0.05)
    assert plan[0].m == -(-m // 3)


def test_fixed_has_one_layer():
    assert len(fixed(10, 0.1)) == 1
