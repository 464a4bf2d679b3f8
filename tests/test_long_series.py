"""Pairs within a reach, exact percentiles and windows over long series: equal at any size of a block, and to plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasespark.operators import correlation, embedding, entropy, fourier, intermittency, recurrence, sections
from phasespark.operators.tiles import each, met, tiles


def signal(spark, x, series="0"):
    return spark.createDataFrame(pd.DataFrame({"series_id": series, "t": np.arange(len(x)), "x": np.asarray(x, float)}))


def points(spark, rows, series="0"):
    rows = np.asarray(rows, float)
    return spark.createDataFrame(pd.DataFrame({"series_id": series, "t": np.arange(len(rows))} | {f"p{j}": rows[:, j] for j in range(rows.shape[1])}))


def pairs_of(tile_rows, theiler=0):
    def kernel(tile):
        keep = np.zeros((len(tile.ta), len(tile.tb)), bool)
        keep[tile.once(theiler)] = True
        a, b = np.nonzero(keep)
        return {"i": tile.ta[a], "j": tile.tb[b], "d": tile.distances("chebyshev")[a, b]}

    return [(min(r["i"], r["j"]), max(r["i"], r["j"]), r["d"]) for r in each(tile_rows, kernel, "i long, j long, d double").collect()]


@pytest.mark.parametrize("block", [3, 7, 100])
def test_tiles_hold_every_pair_once(spark, block):
    got = pairs_of(tiles(points(spark, [[i] for i in range(25)]), block=block), 2)
    want = {(i, j, float(j - i)) for i in range(25) for j in range(i + 3, 25)}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("d", [1, 2, 3])
@pytest.mark.parametrize("theiler", [0, 4])
def test_cells_lose_no_pair_within_reach(spark, d, theiler):
    rng = np.random.default_rng(d)
    x = np.round(rng.normal(size=(120, d)), 1) * 7  # coordinates on a grid of the reach: pairs exactly a reach apart
    x[:40] = x[0]  # a dense cell, in several blocks
    limits = spark.createDataFrame([("0", 0.7)], "series_id string, r double")
    got = [p for p in pairs_of(tiles(points(spark, x), limits, "r", 8), theiler) if p[2] <= 0.7 + 1e-12]
    far = np.abs(x[:, None] - x[None]).max(axis=2)
    want = {(i, j) for i in range(120) for j in range(i + 1 + theiler, 120) if far[i, j] <= 0.7 + 1e-12}
    assert len(got) == len(want) and {p[:2] for p in got} == want


@pytest.mark.parametrize("r", [0.0, float("nan"), float("inf"), -1.0, 1e-300, 1e300])
def test_odd_reaches_take_whole_blocks(spark, r):
    limits = spark.createDataFrame([("0", r)], "series_id string, r double")
    assert len(pairs_of(tiles(points(spark, [[i] for i in range(20)]), limits, "r", 4))) == 190


def test_few_pairs_are_met_for_a_small_reach(spark):
    x = points(spark, np.random.default_rng(0).uniform(size=(6000, 2)))
    limits = spark.createDataFrame([("0", 0.02)], "series_id string, r double")
    near, whole = (met(tiles(x, limits, reach)).first()["pairs"] for reach in ("r", None))
    assert whole == 6000 * 5999 // 2
    assert near < whole / 100
    radii = [0.005, 0.01, 0.02]
    got = {r["k"]: r["c"] for r in correlation.correlation_integral(x, radii).collect()}
    p = np.random.default_rng(0).uniform(size=(6000, 2))
    far = np.concatenate([np.abs(p[i] - p[i + 1 :]).max(axis=1) for i in range(6000)])
    assert got == {k: (far < r).sum() / whole for k, r in enumerate(radii)}


@pytest.mark.parametrize("metric", ["chebyshev", "cityblock", "euclidean", "sqeuclidean"])
def test_counts_don_t_depend_on_blocks(spark, metric):
    x = np.random.default_rng(4).normal(size=(90, 2))
    p = points(spark, x).unionByName(points(spark, x[:5], "short"))
    rows = [sorted(map(tuple, correlation.correlation_integral(p, [0.1, 0.4], 1, metric, block).collect())) for block in (8, 1024)]
    assert rows[0] == rows[1]
    cells = [sorted(map(tuple, recurrence.recurrences(p, None, metric, 10, block=block).collect())) for block in (8, 1024)]
    assert cells[0] == cells[1] and cells[0]


@pytest.mark.parametrize("percentile", [0, 3, 50, 99.7, 100])
def test_percentile_of_a_long_series_is_exact(spark, percentile):
    rng = np.random.default_rng(7)
    series = {"smooth": rng.normal(size=300), "ties": np.round(rng.normal(size=300), 1), "wide": 10.0 ** rng.uniform(-9, 9, size=300), "two": np.array([1.0, 2.0])}
    p = None
    for name, x in series.items():
        own = points(spark, x[:, None], name)
        p = own if p is None else p.unionByName(own)
    p = p.unionByName(points(spark, [[5.0]] * 30, "constant"))
    got = {r["series_id"]: r["eps"] for r in recurrence.thresholds(p, percentile, block=64).collect()}
    assert set(got) == set(series)
    for name, x in series.items():
        d = np.abs(x[:, None] - x[None])[~np.eye(len(x), dtype=bool)]
        assert got[name] == pytest.approx(np.percentile(d[d > 0], percentile), rel=1e-12)


def test_recurrences_of_a_long_series(spark):
    x = np.cumsum(np.random.default_rng(2).normal(size=3000))
    p = embedding.embed(signal(spark, x), 2, 3)
    one, two = (recurrence.rqa(p, percentile=1.0, block=b).first().asDict() for b in (256, 4096))
    assert one == pytest.approx(two) and one["lmax"] > 2


@pytest.mark.parametrize("block", [16, 1024])
def test_entropies_against_loops(spark, block):
    x = np.round(np.random.default_rng(3).normal(size=80), 2)
    r = 0.2 * x.std(ddof=1)
    s = signal(spark, x)

    def templates(m, n):
        return np.stack([x[i : i + n] for i in range(m)], axis=1)

    far = lambda e: np.abs(e[:, None] - e[None]).max(axis=2)
    off = ~np.eye(78, dtype=bool)
    b, a = (((far(templates(m, 78)) < r) & off).sum() for m in (2, 3))
    assert entropy.sample_entropy(s, block=block).first()["entropy"] == pytest.approx(-np.log(a / b))
    phi = [np.log((far(templates(m, 81 - m)) <= r).mean(axis=1)).mean() for m in (2, 3)]
    assert entropy.approximate_entropy(s, block=block).first()["entropy"] == pytest.approx(phi[0] - phi[1])
    own = [templates(m, 78) - templates(m, 78).mean(axis=1, keepdims=True) for m in (2, 3)]
    b, a = (np.exp(-((far(e) / r) ** 2))[off].sum() for e in own)
    assert entropy.fuzzy_entropy(s, block=block).first()["entropy"] == pytest.approx(-np.log(a / b))


@pytest.mark.parametrize("theiler", [0, 5])
@pytest.mark.parametrize("metric", ["chebyshev", "euclidean"])
def test_nearest_neighbours_of_all_dimensions_in_one_pass(spark, theiler, metric):
    x = np.round(np.random.default_rng(5).normal(size=70), 1)
    s = signal(spark, x)
    df = embedding.nearest(s, 3, 2, theiler, metric, block=16)
    got = {(r["d"], r["t"]): (r["dist"], r["gap"]) for r in df.collect()}
    want = {}
    for d in (1, 2, 3):
        n = 70 - 2 * d
        for i in range(n):
            others = []
            for j in range(n):
                if abs(i - j) > theiler:
                    gaps = [abs(x[i + 2 * k] - x[j + 2 * k]) for k in range(d)]
                    others.append((max(gaps) if metric == "chebyshev" else float(np.sqrt(sum(g * g for g in gaps))), j))
            dist, j = min(others)
            want[d, i] = (dist, abs(x[i + 2 * d] - x[j + 2 * d]))
    assert got == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # all dimensions from one pass


@pytest.mark.parametrize("span", [5, 100, 1 << 16])
def test_lags_over_time_blocks(spark, span):
    x = np.arange(203.0)
    rows = embedding.lagged(signal(spark, x), [0, 3, 17], span=span).orderBy("t").collect()
    assert [tuple(r)[1:] for r in rows] == [(t, t, t + 3, t + 17) for t in range(203 - 17)]
    every = embedding.lagged(signal(spark, x), [0, 17], whole=False, span=span).filter(F.isnan("p1")).count()
    assert every == 17


def test_a_series_of_100_000_points(spark):
    x = np.random.default_rng(6).uniform(size=100_000)
    p = embedding.embed(signal(spark, x), 2, 1)
    assert p.count() == 99_999
    limits = spark.createDataFrame([("0", 0.002)], "series_id string, r double")
    assert met(tiles(p, limits, "r")).first()["pairs"] < 99_999 * 99_998 / 2 / 1000
    row = recurrence.rqa(p, eps=0.002, metric="chebyshev", theiler=1).first()
    assert row["rr"] == pytest.approx(0.004**2, rel=0.05) and row["n"] == 99_999


@pytest.mark.parametrize("whole", [1 << 16, 50])
def test_transforms_of_any_length(spark, whole):
    rng = np.random.default_rng(8)
    series = {"prime": rng.normal(size=97), "even": rng.normal(size=120), "short": rng.normal(size=16), "one": rng.normal(size=1), "square": rng.normal(size=121)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "t": np.arange(len(v)), "x": v}) for k, v in series.items()]))
    got = fourier.transform(df, whole).toPandas().sort_values("k")
    for name, x in series.items():
        own = got[got.series_id == name]
        assert list(own.k) == list(range(len(x))) and set(own.n) == {len(x)}
        assert np.allclose(own.re + 1j * own.im, np.fft.fft(x), atol=1e-11)
    assert fourier.transform(df.limit(0), whole).count() == 0


def test_period_and_autocovariance_of_a_long_series(spark):
    t = np.arange(200_000)
    x = np.sin(2 * np.pi * t / 80) + 0.1 * np.random.default_rng(1).normal(size=len(t))
    s = signal(spark, x)
    assert sections.dominant_period(s).first()["period"] == 80
    c = x - x.mean()
    for max_lag, span in ((5, 1 << 16), (200, 1 << 14)):
        got = {r["lag"]: r["acov"] for r in sections.autocovariance(s, max_lag, span).collect()}
        assert got == pytest.approx({k: (c[: len(c) - k] * c[k:]).mean() for k in range(max_lag + 1)}, abs=1e-9)


def runs_of(mask):
    out, start = [], None
    for t, m in enumerate([*mask, False]):
        if m and start is None:
            start = t
        if not m and start is not None:
            out.append((start, t - start))
            start = None
    return out


@pytest.mark.parametrize("span", [4, 7, 1000])
@pytest.mark.parametrize("share", [0.2, 0.9, 1.0])
def test_runs_over_time_blocks(spark, span, share):
    mask = np.random.default_rng(span).uniform(size=90) < share
    cells = signal(spark, mask).withColumn("odd", F.col("t") % 13 == 0)
    got = embedding.consecutive(cells.filter("x > 0"), ["series_id"], ("odd",), span).orderBy("start").collect()
    want = runs_of(mask)
    assert [(r["start"], r["length"]) for r in got] == want
    assert [r["odd"] for r in got] == [any(t % 13 == 0 for t in range(a, a + n)) for a, n in want]


@pytest.mark.parametrize("span", [5, 1000])
def test_masks_and_extrema_over_time_blocks(spark, span):
    x = np.round(np.random.default_rng(9).normal(size=150), 0)
    s = signal(spark, x)
    got = {r["t"] for r in sections.sustained(s, -0.5, 3, span).collect() if r["sustained"]}
    assert got == {t for a, n in runs_of(x > -0.5) if n >= 3 for t in range(a, a + n)}
    gap = np.abs(x[4:] - x[:-4])
    eps = np.percentile(gap[gap > 0], 60)
    got = {r["t"] for r in intermittency.laminar_by_period(s, 4, 60, span).collect() if r["laminar"]}
    assert got == {t + 4 for t in range(146) if gap[t] <= eps}
    fine = x + np.random.default_rng(2).normal(size=150)  # no two windows of equal deviation
    sd = np.array([fine[i : i + 5].std() for i in range(146)])
    eps = np.percentile(sd[sd > 0], 30)
    got = {r["t"] for r in intermittency.laminar_by_variance(signal(spark, fine), 5, 30, span).collect() if r["laminar"]}
    assert got == {t for i in range(146) if sd[i] <= eps + 1e-12 for t in range(i, i + 5)}
    for kind, sign in (("max", 1), ("min", -1)):
        v, want, i = sign * x, [], 0
        while i < 150:
            j = i
            while j + 1 < 150 and v[j + 1] == v[i]:
                j += 1
            if i > 0 and j < 149 and v[i - 1] < v[i] > v[j + 1]:
                want.append(((i + j) // 2, x[i]))
            i = j + 1
        assert sorted(tuple(r)[1:] for r in intermittency.extrema(s, kind, span).collect()) == want


@pytest.mark.parametrize("span", [10, 1 << 16])
def test_mutual_information_over_time_blocks(spark, span):
    x = np.random.default_rng(10).normal(size=200)
    got = {r["tau"]: r["ami"] for r in embedding.average_mutual_information(signal(spark, x), 7, 8, span).collect()}
    lo, hi = x.min(), x.max()
    b = np.minimum(np.floor((x - lo) / (hi + 1e-10 * (hi - lo) - lo) * 8), 7).astype(int)
    for tau in range(1, 8):
        p = np.zeros((8, 8))
        np.add.at(p, (b[:-tau], b[tau:]), 1 / (200 - tau))
        with np.errstate(divide="ignore", invalid="ignore"):
            assert got[tau] == pytest.approx(np.nansum(p * np.log(p / np.outer(p.sum(1), p.sum(0)))))
