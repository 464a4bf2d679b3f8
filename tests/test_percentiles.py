"""Thresholds to the last bit as SQL's quantile_cont gives them."""

import random

import duckdb
import numpy as np
import pytest

from phasespark.operators import intermittency, recurrence
from phasespark.operators.percentiles import between_numbers


@pytest.fixture(scope="module")
def series():
    """Series of prices, whose percentiles mostly lie between two values."""
    rng = random.Random(5)
    return {str(s): [round(rng.uniform(1, 100), 2) for _ in range(rng.randint(2, 40))] for s in range(300)}


def quantiles(values: dict, share: float) -> dict:
    columns = [s for s, xs in values.items() for _ in xs], [float(x) for xs in values.values() for x in xs]
    found = duckdb.connect().execute(f"SELECT s, quantile_cont(x, {share}) FROM (SELECT unnest(?) s, unnest(?) x) GROUP BY 1", columns)
    return dict(found.fetchall())


def test_percentile_to_the_last_bit(spark, series):
    rows = spark.createDataFrame([(s, x) for s, xs in series.items() for x in [-3.0, 0.0, *xs]], "series_id string, gap double")
    assert {r["series_id"]: r["eps"] for r in intermittency.positive_percentile(rows, "gap", 40).collect()} == quantiles(series, 0.4)


def test_channel_keeps_the_same_points(spark, series):
    rows = [(s, k, x, x + 0.3) for s, xs in series.items() for k, x in enumerate(xs)]  # gaps that differ in their last bits only
    found = intermittency.tangent_channel(spark.createDataFrame(rows, "series_id string, k long, x double, y double"), 40, 0)
    gaps = {s: [abs(x + 0.3 - x) for x in xs] for s, xs in series.items()}
    limits = quantiles(gaps, 0.4)
    assert {r["series_id"]: r["n"] for r in found.collect()} == {s: sum(g <= limits[s] for g in own) for s, own in gaps.items()}


def test_recurrence_threshold_to_the_last_bit(spark, series):
    points = spark.createDataFrame([(s, t, x) for s, xs in series.items() for t, x in enumerate(xs)], "series_id string, t long, p0 double")
    gaps = {s: [abs(a - b) for i, a in enumerate(xs) for b in xs[i + 1 :] for _ in "12" if a != b] for s, xs in series.items()}
    want = quantiles(gaps, 0.1)
    assert {r["series_id"]: r["eps"] for r in recurrence.thresholds(points, 10, block=16).collect()} == want
    for s, xs in list(series.items())[:100]:
        gap = np.array(gaps[s][::2])
        first, second, part = recurrence._rank(len(gap), 0.1)
        assert between_numbers(*np.sort(gap)[[first, second]].tolist(), part) == want[s]
