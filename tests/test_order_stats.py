"""The bucketed order statistics against a direct computation."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.functions.order_stats import percentiles, top_fraction_sums

QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
few = settings(
    max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def check(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in percentiles(df, ["g"], "v", QUANTILES).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for name, q in QUANTILES.items():
            assert got[g][name] == pytest.approx(np.percentile(values, q * 100), rel=1e-9, abs=1e-9)


values = st.one_of(
    st.integers(-5, 5).map(float),
    st.floats(-1e9, 1e9, allow_nan=False),
    st.floats(0, 1e18, allow_nan=False),
)


@few
@given(st.lists(st.tuples(st.sampled_from("abc"), values), min_size=1, max_size=60))
def test_percentiles_equal_direct_computation(spark, rows):
    check(spark, rows)


def test_one_value_holding_most_rows(spark):
    check(spark, [("a", 7.0)] * 500 + [("a", float(i)) for i in range(100)] + [("b", 1.5)])


@few
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=150))
def test_top_sums_equal_direct_computation(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "v bigint")
    row = top_fraction_sums(df, "v", (100, 10, 3)).first()
    ordered = sorted(numbers, reverse=True)
    for tiles in (100, 10, 3):
        size = len(numbers) // tiles + (len(numbers) % tiles > 0)
        assert row[f"top_{tiles}"] == sum(ordered[:size])
    assert (row.n, row.total) == (len(numbers), sum(numbers))
