"""Power laws by blocks of values and bounds, against every candidate with its whole tail."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasespark.operators import intermittency
from phasespark.operators.intermittency import discrete_alphas, zeta


def runs(spark, own):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"run_id": k, "value": np.asarray(v, float)}) for k, v in own.items()]))


def plain_fit(x, min_tail, discrete):
    x = np.sort(x[x > 0])
    best = None
    for low in np.unique(x):
        tail = x[x >= low]
        spread = np.log(tail).mean() - np.log(low)
        if len(tail) < min_tail or spread <= 1e-12:
            continue
        alpha = discrete_alphas(np.array([np.log(tail).mean()]), np.array([low]))[0] if discrete else 1 + 1 / spread
        v, c = np.unique(tail, return_counts=True)
        model = 1 - zeta(alpha, v + 1) / zeta(alpha, low) if discrete else 1 - (v / low) ** (1 - alpha)
        ks = np.abs(c.cumsum() / len(tail) - model).max()
        if best is None or ks < best[2] - 1e-12:
            best = (low, alpha, ks, len(tail))
    return best


def drawn(seed, n=400):
    rng = np.random.default_rng(seed)
    return np.r_[(1 - rng.random(n)) ** (-1 / 1.5) * 3, rng.uniform(0.1, 3, n // 2)]


@pytest.mark.parametrize("values", [16, 4096])
@pytest.mark.parametrize("discrete", [False, True])
def test_fits_with_bounds_are_those_of_all_candidates(spark, values, discrete, monkeypatch):
    monkeypatch.setattr(intermittency, "VALUES", values)
    monkeypatch.setattr(intermittency, "KNOTS", values)
    own = {k: drawn(k, 300) for k in range(3)} | {7: [1.0] * 20, 8: [0.0, -1.0], 9: np.r_[[2.0] * 15, 3.0, 4.0, 5.0]}
    if discrete:
        own = {k: np.floor(np.asarray(v) * 4) for k, v in own.items()}
    got = {r["run_id"]: r for r in intermittency.fit_power_law(runs(spark, own), 10, discrete).collect()}
    want = {k: plain_fit(np.asarray(v), 10, discrete) for k, v in own.items()}
    assert set(got) == {k for k, v in want.items() if v}
    for k, r in got.items():
        assert (r["x_min"], r["n_tail"]) == (want[k][0], want[k][3])
        assert (r["alpha"], r["ks"]) == pytest.approx(want[k][1:3], rel=1e-6)


def test_bounds_hold_and_discard(spark):
    x = np.sort(drawn(1, 3000))
    v, c = np.unique(x, return_counts=True)
    n = c[::-1].cumsum()[::-1]
    mean = (c * np.log(v))[::-1].cumsum()[::-1] / n
    ok = (n >= 10) & (mean - np.log(v) > 1e-12)
    low, tail, alpha = v[ok], n[ok], 1 + 1 / (mean - np.log(v))[ok]
    exact = intermittency._bounds(low, tail, alpha, v, n - c, False)[0]
    some = np.r_[np.arange(0, len(v), 16), len(v) - 1]
    least, most = intermittency._bounds(low, tail, alpha, v[some], (n - c)[some], False)
    assert (least <= exact + 1e-12).all() and (exact <= most + 1e-12).all()
    assert (least <= most.min()).mean() < 0.5  # at every 16th value; over half needn't see their tails


@pytest.mark.parametrize("discrete", [False, True])
def test_bootstrap_from_counts(spark, discrete, monkeypatch):
    monkeypatch.setattr(intermittency, "DRAWS", 100)
    monkeypatch.setattr(intermittency, "VALUES", 64)
    own = {"law": drawn(5, 600), "flat": np.random.default_rng(1).uniform(1, 2, 600), "none": [1.0, 2.0]}
    if discrete:
        own = {k: np.ceil(np.asarray(v) * 10) for k, v in own.items()}
    df = runs(spark, own)
    got = {r["run_id"]: r for r in intermittency.power_law_bootstrap(df, 20, 50, seed=3, discrete=discrete).collect()}
    again = {r["run_id"]: r for r in intermittency.power_law_bootstrap(df, 20, 50, seed=3, discrete=discrete).collect()}
    assert got == again and set(got) == set(own)
    assert got["law"]["lower"] < 2.5 < got["law"]["upper"] and 0 <= got["law"]["p_value"] <= 1
    assert got["none"]["alpha"] is None and got["none"]["p_value"] is None


def test_resamples_fit_as_plain_ones_do(spark):
    x = drawn(5, 600)
    low, alpha, _, n_tail = plain_fit(x, 50, False)
    rng, plain = np.random.default_rng(0), []
    for _ in range(40):
        k = rng.binomial(len(x), n_tail / len(x))
        plain.append(plain_fit(np.r_[low * (1 - rng.random(k)) ** (-1 / (alpha - 1)), rng.choice(x[x < low], len(x) - k)], 50, False)[2])
    df = runs(spark, {"a": x})
    fit = intermittency.fit_power_law(df, 50).select("run_id", "x_min", "alpha", "n_tail")
    again = intermittency._resamples(intermittency._value_blocks(df), fit, 40, 1, False).select(F.col("boot").alias("run_id"), "value", "c")
    mine = [r["ks"] for r in intermittency._fit_blocks(intermittency._blocks_of_counts(again.groupBy("run_id", "value").agg(F.sum("c").alias("c"))), 50, False).collect()]
    assert len(mine) == 40
    assert abs(np.mean(mine) - np.mean(plain)) < 4 * np.hypot(np.std(mine), np.std(plain)) / 40**0.5


def test_resamples_keep_the_number_of_values(spark, monkeypatch):
    monkeypatch.setattr(intermittency, "VALUES", 32)
    df = runs(spark, {"a": drawn(2, 200)})
    blocks = intermittency._value_blocks(df)
    fit = intermittency.fit_power_law(df, 10).select("run_id", "x_min", "alpha", "n_tail")
    rows = intermittency._resamples(blocks, fit, 5, 0, False).groupBy("boot").sum("c").collect()
    assert {r["boot"]: r["sum(c)"] for r in rows} == {b: 300 for b in range(1, 6)}


def test_few_candidates_meet_their_whole_tail(spark, monkeypatch):
    monkeypatch.setattr(intermittency, "VALUES", 512)
    monkeypatch.setattr(intermittency, "KNOTS", 512)
    kept, left = intermittency.settled, []

    def counted(df):
        out = kept(df)
        if "lower" in out.columns:
            left.append(out.count())
        return out

    monkeypatch.setattr(intermittency, "settled", counted)
    x = np.random.default_rng(3).uniform(1, 5e5, 12_000)  # like prices: no power law fits, the best one is of a short tail
    r = intermittency.fit_power_law(runs(spark, {1: x})).first()
    want = plain_fit(x, 10, False)
    assert (r["x_min"], r["n_tail"]) == (want[0], want[3])
    assert left and sum(left) < 300


def test_many_short_runs_are_spread_over_tasks(spark, monkeypatch):
    kept, tasks = intermittency.settled, []

    def counted(df):
        if "lower" in df.columns:
            tasks.append(df.rdd.getNumPartitions())
        return kept(df)

    monkeypatch.setattr(intermittency, "settled", counted)
    own = {k: np.floor(drawn(k, 12) * 4) for k in range(40)}
    got = {r["run_id"]: r for r in intermittency.fit_power_law(runs(spark, own), 3, True).collect()}
    want = {k: plain_fit(v, 3, True) for k, v in own.items()}
    assert set(got) == {k for k, v in want.items() if v}
    for k, r in got.items():
        assert (r["x_min"], r["n_tail"]) == (want[k][0], want[k][3])
        assert (r["alpha"], r["ks"]) == pytest.approx(want[k][1:3], rel=1e-6)
    assert tasks == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
