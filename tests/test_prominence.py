"""Prominent and spaced extrema over blocks, against plain loops over the whole series."""

import numpy as np
import pandas as pd
import pytest

from phasespark.operators import intermittency


def plain(x, prominence, distance):
    peaks, i = [], 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if i > 0 and j < len(x) - 1 and x[i - 1] < x[i] > x[j + 1]:
            peaks.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(peaks, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= (distance or 1) for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        lows = []
        for step in (-1, 1):
            low, k = x[p], p
            while 0 <= k < len(x) and x[k] <= x[p]:
                low, k = min(low, x[k]), k + step
            lows.append(low)
        if x[p] - max(lows) >= (prominence or 0):
            out.append((p, x[p], x[p] - max(lows)))
    return out


@pytest.mark.parametrize("span", [4, 16, 1 << 16])
@pytest.mark.parametrize("case", [(None, None), (0.8, None), (None, 5), (0.5, 12)])
def test_prominences_over_blocks(spark, span, case):
    rng = np.random.default_rng(span)
    series = {"walk": np.cumsum(rng.normal(size=160)).round(1), "ties": rng.integers(0, 4, 120).astype(float), "rise": np.arange(60.0) + 5 * (np.arange(60) % 3 == 0), "flat": np.ones(9), "one": np.ones(1)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "t": np.arange(len(v)), "x": v}) for k, v in series.items()]))
    for kind, sign in (("max", 1), ("min", -1)) if span == 16 else (("max", 1),):
        got = intermittency.spaced_extrema(df, kind, *case, span=span).toPandas().sort_values(["series_id", "t"])
        for name, x in series.items():
            own = got[got.series_id == name]
            want = plain(sign * x, *case)
            assert list(own.t) == [w[0] for w in want]
            assert np.allclose(own.x, [sign * w[1] for w in want]) and np.allclose(own.prominence, [w[2] for w in want])


def test_the_last_higher_place():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 100):
        v = rng.integers(0, 6, n).astype(float)
        place, least = intermittency._reach_left(v, np.arange(n))
        for i in range(n):
            j = i - 1
            while j >= 0 and v[j] <= v[i]:
                j -= 1
            assert place[i] == j and least[i] == v[j + 1 : i].min(initial=np.inf)
