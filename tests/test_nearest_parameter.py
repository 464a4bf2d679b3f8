"""The nearest-parameter lookup against all pairs, on grids of any size."""

import random

import pytest

from phasespark.operators import sections


@pytest.mark.parametrize(("n", "range_rows"), [(5000, 700), (2500, 100_000), (3, 2), (0, 10)])
def test_nearest_parameter_matches_all_pairs(spark, n, range_rows):
    rng = random.Random(n)
    grid = [(float(rng.randrange(40 * n)) / 4, float(i)) for i in range(n)]
    asked = [float(rng.randrange(-20, 44 * n + 20)) / 4 for _ in range(300)] * 2 + [None]
    queries = spark.createDataFrame([(p,) for p in asked], "p double")
    options = {"range_rows": range_rows} if n != 2500 else {}
    got = sections.nearest_parameter(queries, spark.createDataFrame(grid, "q double, value double"), **options).collect()
    want = [(p, *min(grid, key=lambda g: (abs(g[0] - (p if p is not None else -1e9)), g), default=(None, None))) for p in asked]
    assert sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0)) == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0))
