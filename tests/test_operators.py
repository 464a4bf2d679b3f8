"""Operators against known values and plain loops."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasespark.functions.maps import FLOWS, SYSTEMS, flow_step, matrix
from phasespark.operators import chaos, correlation, embedding, entropy, intermittency, lattice, multifractal, ordinal, recurrence, sections
from phasespark.operators.embedding import embed
from phasespark.plans import cache, workflow
from phasespark.sources import signals as src
from phasespark.sources import simulate


def signal(spark, x, series="0"):
    return spark.createDataFrame([(series, t, float(v)) for t, v in enumerate(x)], "series_id string, t long, x double")


def points(spark, rows):
    d = len(rows[0])
    return spark.createDataFrame([("0", t, *map(float, r)) for t, r in enumerate(rows)], "series_id string, t long, " + ", ".join(f"p{j} double" for j in range(d)))


def test_percentile_counts_each_pair_twice(spark):
    row = recurrence.thresholds(points(spark, [[15], [18], [23]]), 40).first()
    assert row["eps"] == 5.0


def test_all_recurrent_and_none_recurrent(spark):
    row = recurrence.rqa(points(spark, [[0.0]] * 5), eps=0.0).first()
    assert row["rr"] == 1.0 and row["lmax"] == 4
    none = recurrence.rqa(points(spark, [[0], [10], [20], [30]]), eps=0.0, theiler=4).first()
    assert all(none[k] == 0 for k in ("rr", "det", "lam", "l", "tt", "entr", "lmax"))


def test_sample_entropy_edges(spark):
    assert entropy.sample_entropy(signal(spark, [1.0, 2.0])).first()["entropy"] == math.inf
    assert math.isnan(entropy.sample_entropy(signal(spark, range(50)), r=1e-15).first()["entropy"])


def test_lehmer_codes_match_a_loop(spark):
    from phasespark.streaming.ordinal import lehmer

    x = np.round(np.random.default_rng(1).normal(size=80), 1)
    got = {r["t"]: r["lehmer"] for r in ordinal.patterns(signal(spark, x), 4, 2).collect()}
    assert got == {t: lehmer(x[t : t + 7 : 2]) for t in range(len(x) - 6)}


def test_correlation_integral_matches_a_loop(spark):
    x = np.random.default_rng(2).normal(size=(40, 2))
    d = np.abs(x[:, None] - x[None]).max(axis=2)
    i, j = np.triu_indices(40, 3)
    got = [r["c"] for r in correlation.correlation_integral(points(spark, x.tolist()), [0.1, 0.5, 1.0], theiler=2).orderBy("k").collect()]
    assert np.allclose(got, [(d[i, j] < r).mean() for r in (0.1, 0.5, 1.0)])


def test_circle_has_dimension_one(spark):
    a = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    row = correlation.correlation_dimension(points(spark, np.c_[np.sin(a), np.cos(a)].tolist()), 30).first()
    assert 0.9 < row["d2"] < 1.1


@pytest.mark.parametrize("how", [{"eps": 0.5}, {"percentile": 10}, {"percentile": 20, "theiler": 2}, {"eps": 0.7, "metric": "chebyshev", "l_min": 3, "v_min": 3}, {"eps": 0.0}, {"eps": 0.6, "metric": "cityblock", "theiler": 1}])
def test_short_and_long_series_count_alike(spark, how):
    rng = np.random.default_rng(4)
    frames = [signal(spark, np.round(rng.normal(size=n), 1), str(n)) for n in (1, 2, 3, 30, 61)] + [signal(spark, [1.0] * 9, "flat")]
    s = frames[0]
    for f in frames[1:]:
        s = s.unionByName(f)
    got = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in recurrence.rqa(embed(s, 2, 1), block=b, **how).collect()) for b in (1024, 0)]
    assert got[0] == got[1]
    with pytest.raises(ValueError):
        recurrence.rqa(embed(s, 2, 1), eps=-1.0)


def test_bands(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (1.5, True), (3.0, True), (1.0, False)], "d double, s boolean")
    got = [r[0] for r in df.select(correlation.band(F.col("d"), F.col("s"))).collect()]
    assert got == [correlation.TORUS_1, correlation.TORUS_2, correlation.GAP, correlation.HIGH, correlation.UNRESOLVED]


def test_uniform_field_has_dimension_two(spark):
    field = spark.range(64 * 64).select(F.lit(0).alias("field_id"), F.floor(F.col("id") / 64).alias("y"), (F.col("id") % 64).alias("x"), F.lit(1.0).alias("mass"))
    for r in multifractal.spectrum(field, [2, 4, 8, 16, 32], [-4, -1, 0, 1, 2, 4]).collect():
        assert math.isclose(r["d_q"], 2.0, abs_tol=1e-9) and math.isclose(r["r2"], 1.0)


def test_boxes_of_any_sizes_by_a_pyramid(spark):
    rng = np.random.default_rng(4)
    mass = np.where(rng.random((37, 50)) < 0.7, rng.random((37, 50)), 0.0)
    field = spark.createDataFrame([(0, y, x, float(mass[y, x])) for y in range(37) for x in range(50)], "field_id int, y long, x long, mass double")
    boxes = [1, 2, 3, 4, 6, 10, 12]
    assert multifractal._finest(boxes) == {1: [1], 2: [2, 4, 6, 10, 12], 3: [3]}
    got = {(r["box"], r["q"]): r["log_z"] for r in multifractal.moments(field, boxes, [-1.0, 2.0, float("nan")]).collect()}
    for b in boxes:
        m = mass[: 37 // b * b, : 50 // b * b].reshape(37 // b, b, 50 // b, b).sum(axis=(1, 3)).ravel()
        p = m[m > 0] / m.sum()
        for q in (-1.0, 2.0):
            assert math.isclose(got[b, q], math.log((p**q).sum()), rel_tol=1e-9)
    assert len(got) == 2 * len(boxes)
    assert {r["box"] for r in multifractal.moments(field, None, [2.0]).collect()} == {2, 4, 8, 16}
    assert multifractal.spectrum(field).count() == 65


def test_orders_from_codes(spark):
    from itertools import permutations

    from phasespark.streaming.ordinal import lehmer

    for d in (2, 3, 5):
        rows = [(lehmer(np.argsort(o)), list(o)) for o in permutations(range(d))]
        df = spark.createDataFrame(rows + [(-1, None), (math.factorial(d), None), (None, None)], "code int, want array<int>")
        assert all(r["got"] == r["want"] for r in df.select("want", ordinal.order_of(F.col("code"), d).alias("got")).collect())


@pytest.mark.parametrize(("angles", "lags"), [([], 5), ([1.0], 1), ([1.0], 2.5)])
def test_zero_one_refuses_odd_parameters(spark, angles, lags):
    with pytest.raises(ValueError, match="at least 2"):
        chaos.zero_one(signal(spark, range(20)), angles, lags)


def test_default_boxes():
    assert [multifractal.default_boxes(n) for n in (0, 3, 4, 8, 16, 17, 31, 64)] == [[], [], [2], [2, 4], [2, 4, 8], [2, 4, 8], [2, 4, 8], [2, 4, 8, 16, 32]]


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf"), None])
def test_odd_masses_are_refused(spark, bad):
    field = spark.createDataFrame([(0, i // 16, i % 16, 1.0 if i else bad) for i in range(256)], "field_id int, y long, x long, mass double")
    with pytest.raises(Exception, match="finite and not negative"):
        multifractal.moments(field, [1, 2], [2.0]).collect()


def test_run_lengths_and_censoring(spark):
    mask = spark.createDataFrame([("0", t, b) for t, b in enumerate([True, True, False, True, False, True, True, True])], "series_id string, t long, laminar boolean")
    assert sorted(r["length"] for r in intermittency.run_lengths(mask).collect()) == [1, 2, 3]
    assert sorted(r["length"] for r in intermittency.run_lengths(mask, drop_final_censored=True).collect()) == [1, 2]


def test_pareto_exponent(spark):
    u = np.random.default_rng(2028).random(4000)
    df = spark.createDataFrame(pd.DataFrame({"run_id": 0, "value": np.round((1 - u) ** (-1 / 1.5), 3)}))
    row = intermittency.fit_power_law(df, 500).first()
    assert abs(row["alpha"] - 2.5) < 0.15


def test_zeta():
    assert math.isclose(intermittency.zeta(2.0, 1.0), math.pi**2 / 6, rel_tol=1e-10)


def test_crossings_of_a_sine(spark):
    t = np.arange(400)
    found = sections.crossings(signal(spark, np.sin(2 * np.pi * t / 40)), fs=10.0).orderBy("k").collect()
    gaps = np.diff([r["time"] for r in found])
    assert len(found) == 9 or len(found) == 10
    assert np.allclose(gaps, 4.0, atol=1e-3)
    short = signal(spark, [0.0, 1.0])
    row = sections.section_quality(sections.section(short), short).first()
    assert (row["n"], row["label"]) == (0, "insufficient_data")
    sine = signal(spark, np.sin(2 * np.pi * t / 40))
    assert sections.section_quality(sections.section(sine, 10.0, delay=10), sine).first()["label"] == "highly_periodic"
    assert sections.dominant_period(sine).first()["period"] == 40


def test_prominence_and_distance(spark):
    x = [0, 2, 1, 3, 0, 1, 0.5, 1.5, 0, 5, 5, 0, 2, 0]
    got = lambda **k: [(r["t"], r["prominence"]) for r in intermittency.spaced_extrema(signal(spark, x), **k).orderBy("t").collect()]
    assert got() == [(1, 1.0), (3, 3.0), (5, 0.5), (7, 1.5), (9, 5.0), (12, 2.0)]
    assert [t for t, _ in got(prominence=1.5)] == [3, 7, 9, 12] and [t for t, _ in got(distance=3)] == [3, 9, 12]
    with pytest.raises(ValueError):
        intermittency.spaced_extrema(signal(spark, x), distance=0)


def test_takens_theiler_tail_takes_the_middle_slope(spark):
    r = np.geomspace(0.01, 1.0, 20)
    c = r**2
    c[1] = c[0]
    rows = [("s", k, float(a), float(b), 1e-9) for k, (a, b) in enumerate(zip(r, c, strict=True))]
    d = [x["d"] for x in correlation.takens_theiler_curve(spark.createDataFrame(rows, "series_id string, k int, r double, c double, floor double")).orderBy("k").collect()]
    assert abs(d[0] - 2) < 1e-6 and abs(d[-1] - 2) < 0.05


def test_discrete_power_law_recovers_zipf(spark):
    x = np.random.default_rng(2029).zipf(2.2, 5000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"run_id": 0, "value": x}))
    row = intermittency.fit_power_law_discrete(df, 1000).first()
    assert abs(row["alpha"] - 2.2) < 0.1 and row["x_min"] == 1.0
    again = intermittency._draw_discrete(np.random.default_rng(1), 2.2, 3.0, 20_000)
    assert again.min() == 3 and abs((again == 3).mean() - 3**-2.2 / intermittency.zeta(2.2, 3.0)) < 0.01


def test_cao_rules(spark):
    pick = lambda e, **k: embedding.select_dimension_cao(spark.createDataFrame([("s", i + 1, float(v)) for i, v in enumerate(e)], "series_id string, d int, e1 double"), **k).first()["dimension"]
    assert pick([0.2, 0.5, 0.97, 0.98, 0.99, 1.0]) == 3
    assert pick([0.2, 0.5, 0.955, 0.974, 0.992, 0.8]) == 3 and pick([0.2, 0.5, 0.96, 1.04, 0.96, 1.2]) == 3
    assert pick([0.2, 0.5, 0.9, 0.7]) == 3 and pick([0.2, 0.5, 0.9, 0.7], max_dim=2) == 2
    assert pick([0.0, 3.0, 0.0, 3.0, 0.0], window=3) in (2, 4)
    with pytest.raises(ValueError):
        embedding.optimal_dimension(signal(spark, [1.0, 2.0]), 1, 1)


@pytest.mark.parametrize("name", sorted(SYSTEMS))
def test_trajectory_matches_steps(spark, name):
    own = SYSTEMS[name]
    got = simulate.trajectories(spark.range(1).withColumnRenamed("id", "param_id"), name, 20, 5).orderBy("t").collect()
    s, p = [np.array([v]) for v in own.start], own.parameters({}, 1)
    for k in range(25):
        s = own.step(s, p)
        if k >= 5:
            assert [float(c[0]) for c in s] == [got[k - 5][f"p{j}"] for j in range(len(s))]


@pytest.mark.parametrize("name", [k for k, v in {**SYSTEMS, **FLOWS}.items() if v.jacobian])
def test_jacobians_match_differences(name):
    own = SYSTEMS.get(name) or FLOWS[name]
    s, p = [np.array([v + 0.03]) for v in own.start], own.parameters({}, 1)
    j = matrix(own.jacobian(s, p), 1)[0]
    for k in range(len(s)):
        up, down = [c.copy() for c in s], [c.copy() for c in s]
        up[k] += 1e-6
        down[k] -= 1e-6
        column = [(a[0] - b[0]) / 2e-6 for a, b in zip(own.step(up, p), own.step(down, p), strict=True)]
        assert np.allclose(j[:, k], column, atol=1e-4)


def test_flow_keeps_to_a_known_orbit():
    s = flow_step(lambda s, p: [s[1], -s[0]], [np.array([0.0]), np.array([1.0])], {}, math.pi / 2, 64)
    assert np.allclose([s[0][0], s[1][0]], [1.0, 0.0], atol=1e-7)


def test_logistic_exponent_is_ln_two(spark):
    row = chaos.lyapunov_logistic(spark.createDataFrame([(0, 2.0)], "param_id long, a double"), 3000, 10, 0.3).first()
    assert abs(row["lyapunov"] - math.log(2)) < 0.02


def test_henon_spectrum_sums_to_ln_b(spark):
    got = chaos.lyapunov_spectrum(spark.range(1).withColumnRenamed("id", "param_id"), "henon", 400, 50).collect()
    assert abs(sum(r["exponent"] for r in got) - math.log(0.3)) < 1e-9


def test_periodic_runs_join_over_the_seam(spark):
    bits = [1, 1, 0, 1, 0, 0, 1, 1]
    mask = spark.createDataFrame([(0, 0, i, bool(b)) for i, b in enumerate(bits)] + [(0, 1, i, True) for i in range(4)], "run_id int, t long, site int, burst boolean")
    got = sorted((r["t"], r["length"]) for r in lattice.periodic_runs(mask).collect())
    assert got == [(0, 1), (0, 4), (1, 4)]


def test_zero_one_separates_order_from_chaos(spark):
    x = [0.3]
    for _ in range(299):
        x.append(4 * x[-1] * (1 - x[-1]))
    c = chaos.frequencies(15)
    wild = chaos.zero_one_statistic(signal(spark, x), c, 30).first()["k"]
    tame = chaos.zero_one_statistic(signal(spark, np.sin(0.5 * np.arange(300))), c, 30).first()["k"]
    assert wild > 0.8 and tame < 0.3


def test_numpy_source(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(5.0))
    np.savez(tmp_path / "y.npz", a=np.arange(3.0), b=np.arange(2.0))
    assert [r["x"] for r in src.from_numpy(spark, str(tmp_path / "x.npy")).orderBy("t").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        src.from_numpy(spark, str(tmp_path / "y.npz"))
    assert src.from_numpy(spark, str(tmp_path / "y.npz"), "b").count() == 2


def test_workflow(spark, tmp_path):
    doc = """{ // a comment
      "input": {"generated": {"name": "logistic", "n": 200, "a": 1.99, "x0": 0.3}}, /* another */
      "output": {"dir": "out"},
      "diagnostics": [{"name": "permutation_entropy", "d": 3}, {"name": "rqa_streaming", "eps": 0.1, "embedding": {"d": 2, "tau": 1}}]}"""
    (tmp_path / "c.jsonc").write_text(doc)
    found = workflow.run_workflow(spark, tmp_path / "c.jsonc")["diagnostics"]
    assert 0.5 < found["permutation_entropy"]["value"] <= 1 and found["rqa_streaming"]["rr"] > 0
    assert json.loads((tmp_path / "out/metadata.json").read_text())["input"]["length"] == 200
    assert (tmp_path / "out/summary.md").exists()
    (tmp_path / "d.jsonc").write_text('{"input": {}, "diagnostics": [{"name": "rqa_dense"}]}')
    with pytest.raises(workflow.WorkflowError):
        workflow.run_workflow(spark, tmp_path / "d.jsonc")


def test_cache(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert cache.status(spark, path) == "missing"
    for _ in range(2):
        assert cache.load_or_compute(spark, path, compute, ["id"], str(tmp_path / "ledger")).count() == 3
    assert len(calls) == 1 and cache.status(spark, path, ["other"]) == "missing_keys"
    assert len((tmp_path / "ledger").read_text().splitlines()) == 2


def test_streaming_patterns_match_batch(spark, tmp_path):
    from phasespark.streaming.ordinal import patterns

    x = np.random.default_rng(5).normal(size=30)
    for k in range(3):
        signal(spark, x[k * 10 : k * 10 + 10]).withColumn("t", F.col("t") + 10 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = patterns(stream, 3).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["t"], r["lehmer"]) for r in spark.table("found").collect()}
    want = {(r["t"], r["lehmer"]) for r in ordinal.patterns(signal(spark, x), 3).collect()}
    assert got == want
