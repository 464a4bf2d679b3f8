"""Coupled map lattices states(run_id, t, site, x) and globally coupled maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasespark.functions.maps import logistic, logistic_slope
from phasespark.sources.simulate import trajectories

GOLDEN = (5**0.5 - 1.0) / 2.0


def by_site():
    """The window of a lattice state in order of site."""
    return Window.partitionBy("run_id", "t").orderBy("site")


def model_a(x: Column, a: float = -0.01) -> Column:
    """The piecewise map with a weakly stable laminar branch."""
    return F.when(x < GOLDEN, x + x * x + a).otherwise(-3.0 * (x - GOLDEN) + 1.0 + a)


def model_b(x: Column, a: float = 0.2, c: float = 0.55) -> Column:
    return F.pmod(x + a * F.sin(2 * F.pi() * x) + c, F.lit(1.0))


def model_b_coupling(x: Column) -> Column:
    return F.sin(2 * F.pi() * x)


def model_c(x: Column, a: float = 1.752) -> Column:
    return logistic(x, a)


#: Local map and coupling function of a model for whole batches, with its parameter ``a`` as a column vector.
MODELS = {
    "A": (lambda x, a: np.where(x < GOLDEN, x + x * x + a, -3.0 * (x - GOLDEN) + 1.0 + a),) * 2,
    "B": (lambda x, a: np.mod(x + a * np.sin(2 * np.pi * x) + 0.55, 1.0), lambda x, a: np.sin(2 * np.pi * x)),
    "C": (logistic, logistic),
}


def initial(sites: int, seed: int | None, low: float = -1.0, high: float = 1.0) -> np.ndarray:
    """Uniform random states, or without a seed those of a golden rotation, which SQL can make too."""
    unit = np.random.default_rng(seed).random(sites) if seed is not None else np.mod((np.arange(sites) + 1) * GOLDEN, 1.0)
    return low + (high - low) * unit


def _diffused(x: np.ndarray, a: np.ndarray, eps: np.ndarray, model: str = "C") -> np.ndarray:
    f, g = MODELS[model]
    gx = g(x, a)
    return f(x, a) + eps / 2 * (np.roll(gx, 1, 1) + np.roll(gx, -1, 1) - 2 * gx)


def _global(x: np.ndarray, a: np.ndarray, eps: np.ndarray) -> np.ndarray:
    f = logistic(x, a)
    return (1.0 - eps) * f + eps * f.mean(axis=1, keepdims=True)


def _around(c: str) -> tuple[Column, Column]:
    """The neighbours' values on a ring, from one window over the sites."""
    ring = by_site().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lag(c).over(by_site()), F.last(c).over(ring)), F.coalesce(F.lead(c).over(by_site()), F.first(c).over(ring))


def cml_step(states: DataFrame, f: Callable[[Column], Column], g: Callable[[Column], Column], eps: float) -> DataFrame:
    """One step of f(x) + eps/2 (g(left) + g(right) - 2 g(x)) on a ring; t grows by 1."""
    s = states.select("run_id", "t", "site", f(F.col("x")).alias("fx"), g(F.col("x")).alias("gx"))
    left, right = _around("gx")
    return s.select("run_id", (F.col("t") + 1).alias("t"), "site", (F.col("fx") + eps / 2 * (left + right - 2 * F.col("gx"))).alias("x"))


def gcm_step(states: DataFrame, a: float, eps: float) -> DataFrame:
    """One step of globally coupled logistic maps."""
    s = states.select("run_id", "t", "site", logistic(F.col("x"), a).alias("fx"))
    mean = F.avg("fx").over(Window.partitionBy("run_id", "t"))
    return s.select("run_id", (F.col("t") + 1).alias("t"), "site", ((1.0 - eps) * F.col("fx") + eps * mean).alias("x"))


def spatial_autocorrelation(states: DataFrame, max_lag: int) -> DataFrame:
    """(run_id, lag, c): autocorrelation along a ring, averaged over sites and times, over its value at lag 0."""
    mean = states.groupBy("run_id").agg(F.avg("x").alias("mean"))
    whole = F.array_sort(F.collect_list(F.struct("site", "c")))
    rows = states.join(mean, "run_id").select("run_id", "t", "site", (F.col("x") - F.col("mean")).alias("c")).groupBy("run_id", "t").agg(F.transform(whole, lambda p: p["c"]).alias("v"))
    pairs = rows.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).select(
        "run_id", "lag", F.posexplode("v").alias("i", "a"), F.col("v")
    )
    other = F.get("v", F.pmod(F.col("i") + F.col("lag"), F.size("v")))
    c = pairs.groupBy("run_id", "lag").agg(F.avg(F.col("a") * other).alias("c"))
    first = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(Window.partitionBy("run_id"))
    return c.select("run_id", "lag", F.try_divide(F.col("c"), first).alias("c"))


def burst_mask(states: DataFrame, delta: float = 0.05) -> DataFrame:
    """(run_id, t, site, burst): |x_i - x_(i+1)| over delta on a ring."""
    _, right = _around("x")
    return states.select("run_id", "t", "site", (F.abs(F.col("x") - right) > delta).alias("burst"))


def periodic_runs(mask: DataFrame) -> DataFrame:
    """(run_id, t, length): runs of true sites on a ring, one across the seam counting once; a full ring is one run."""
    by = ["run_id", "t"]
    size = mask.groupBy(*by).agg(F.count("*").alias("n"))
    on = mask.filter("burst").select(*by, "site", (F.col("site") - F.row_number().over(by_site())).alias("island"))
    runs = on.groupBy(*by, "island").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.count("*").alias("length")).join(size, by)
    seam = (F.col("lo") == 0) | (F.col("hi") == F.col("n") - 1)
    edge = F.count(F.when(seam, 1)).over(Window.partitionBy(*by)) == 2
    key = F.when(edge & seam, F.lit(-1 << 40)).otherwise(F.col("island"))
    return runs.withColumn("key", key).groupBy(*by, "key").agg(F.sum("length").alias("length")).drop("key")


def simulate(
    params: DataFrame,
    sites: int,
    n: int,
    transient: int,
    *,
    kind: str = "cml",
    model: str = "C",
    seed: int | None = 42,
    low: float = -1.0,
    high: float = 1.0,
    every: int = 1,
) -> DataFrame:
    """(run_id, t, site, x) for each (param_id, a, eps): diffusive (cml, of a model) or global (gcm, logistic) coupling.

    Initial states lie between ``low`` and ``high``, the same for all rows (see ``initial``); ``every`` steps make one record. The rows
    of a batch advance together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, eps = pdf["a"].to_numpy()[:, None], pdf["eps"].to_numpy()[:, None]
            x = np.tile(initial(sites, seed, low, high), (len(pdf), 1))
            for t in range(-transient, n):
                for _ in range(every if t >= 0 else 1):
                    x = _global(x, a, eps) if kind == "gcm" else _diffused(x, a, eps, model)
                if t >= 0:
                    yield pd.DataFrame({"run_id": np.repeat(pdf["param_id"].to_numpy(), sites), "t": t, "site": np.tile(np.arange(sites), len(pdf)), "x": x.ravel()})

    return params.mapInPandas(run, "run_id long, t long, site int, x double")


def phase_diagram(params: DataFrame, sites: int, n: int, transient: int, *, seed: int | None = 42) -> DataFrame:
    """(param_id, variance, activity) for each (param_id, a, eps): variance in time of the middle site, mean step between neighbours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, eps = pdf["a"].to_numpy()[:, None], pdf["eps"].to_numpy()[:, None]
            x = np.tile(initial(sites, seed), (len(pdf), 1))
            first, second, steps = np.zeros((3, len(pdf)))
            for t in range(-transient, n):
                x = _diffused(x, a, eps)
                if t >= 0:
                    middle = x[:, sites // 2]
                    first, second = first + middle, second + middle * middle
                    steps = steps + np.abs(x - np.roll(x, 1, axis=1)).mean(axis=1)
            yield pd.DataFrame({"param_id": pdf["param_id"], "variance": second / n - (first / n) ** 2, "activity": steps / n})

    return params.mapInPandas(run, "param_id long, variance double, activity double")


def mean_field(params: DataFrame, n: int, transient: int, *, seed: int | None = 42) -> DataFrame:
    """(param_id, mean, msd) for each (param_id, a, eps, sites): mean and variance in time of a globally coupled lattice's mean field.

    Each row is a lattice of its own size, advanced alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                x, h = initial(int(row.sites), seed)[None, :], np.empty(n)
                for t in range(-transient, n):
                    x = _global(x, row.a, row.eps)
                    if t >= 0:
                        h[t] = logistic(x, row.a).mean()
                yield pd.DataFrame({"param_id": [row.param_id], "mean": h.mean(), "msd": h.var()})

    return params.mapInPandas(run, "param_id long, mean double, msd double")


def collective_exponent(params: DataFrame, sites: int, n: int, transient: int, *, every: int = 10, delta: float = 1e-8, seed: int | None = 42) -> DataFrame:
    """(param_id, exponent) for each (param_id, a, eps): growth a step of the distance of the mean fields of two globally coupled copies.

    The second copy starts ``delta`` off at all sites. Every ``every`` steps the distance is read and drawn back to ``delta``; a copy that
    meets the other or escapes starts anew. No reading: 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, eps, m = pdf["a"].to_numpy()[:, None], pdf["eps"].to_numpy()[:, None], len(pdf)
            x = np.tile(initial(sites, seed), (m, 1))
            y, total, reads = x + delta, np.zeros(m), np.zeros(m)
            for t in range(-transient, n):
                x, y = _global(x, a, eps), _global(y, a, eps)
                if t < 0 or (t + 1) % every:
                    continue
                gap = np.abs((y - x).mean(axis=1))
                seen = (gap > 0) & np.isfinite(y).all(axis=1)
                total[seen] += np.log(gap[seen] / delta)
                reads += seen
                scale = np.where(seen, delta / np.where(gap > 0, gap, 1), 0.0)[:, None]
                y = x + np.where(seen[:, None], (np.where(seen[:, None], y, x) - x) * scale, delta)
            yield pd.DataFrame({"param_id": pdf["param_id"], "exponent": np.where(reads > 0, total / np.maximum(reads * every, 1), 0.0)})

    return params.mapInPandas(run, "param_id long, exponent double")


def lyapunov_density(params: DataFrame, sites: int, sizes: list[int], n: int, transient: int, *, seed: int | None = 42) -> DataFrame:
    """(param_id, size, density) for each (param_id, a, eps): the largest exponent of the first ``size`` sites under the rest, per site.

    A tangent on those sites is carried by their part of the Jacobian, neighbours outside counting nothing. Sizes are rows of their own.
    """
    rows = params.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, eps, m = pdf["a"].to_numpy()[:, None], pdf["eps"].to_numpy()[:, None], len(pdf)
            inside = np.arange(sites) < pdf["size"].to_numpy()[:, None]
            x, total = np.tile(initial(sites, seed, -0.5, 0.5), (m, 1)), np.zeros(m)
            v = np.where(inside, np.cos(np.arange(sites) + 1.0), 0.0)
            for t in range(-transient, n):
                if t >= 0:
                    w = logistic_slope(x, a) * v
                    v = np.where(inside, (1.0 - eps) * w + eps / 2 * (np.roll(w, 1, 1) + np.roll(w, -1, 1)), 0.0)
                    size = np.maximum(np.linalg.norm(v, axis=1), 1e-300)
                    total, v = total + np.log(size), v / size[:, None]
                x = _diffused(x, a, eps)
            yield pd.DataFrame({"param_id": pdf["param_id"], "size": pdf["size"], "density": total / n / pdf["size"]})

    return rows.mapInPandas(run, "param_id long, size int, density double")


def turbulence(states: DataFrame, delta: float = 0.05) -> DataFrame:
    """(run_id, turbulent, decay): the share of sites in bursts, and the decay rate of the lengths of laminar clusters of two or more."""
    mask = burst_mask(states, delta)
    share = mask.groupBy("run_id").agg(F.avg(F.col("burst").cast("double")).alias("turbulent"))
    runs = periodic_runs(mask.withColumn("burst", ~F.col("burst"))).groupBy("run_id", "length").agg(F.count("*").alias("n"))
    pmf = runs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("run_id"))).filter("length >= 2")
    return share.join(decay_rate(pmf), "run_id", "left").select("run_id", "turbulent", F.col("rate").alias("decay"))


def comoving_exponent(params: DataFrame, sites: int, velocities: list[float], n: int, transient: int, segment: int = 100, every: int = 10, seed: int = 42) -> DataFrame:
    """(param_id, v, exponent): growth of a small local perturbation seen at a moving site, over segments of ``segment`` steps.

    A segment starts from a unit tangent at the middle and ends with the logarithm of its size at the site reached; tangents are rescaled
    every ``every`` steps. No usable segment: -10. Velocities are rows of their own, so they spread over the cluster.
    """
    rows = params.withColumn("v", F.explode(F.array(*map(F.lit, map(float, velocities)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, eps, v = (pdf[c].to_numpy() for c in ("a", "eps", "v"))
            m, middle = len(pdf), sites // 2
            x = np.tile(np.random.default_rng(seed).uniform(-1, 1, sites), (m, 1))
            mix = lambda y: (1.0 - eps[:, None]) * y + eps[:, None] / 2 * (np.roll(y, 1, 1) + np.roll(y, -1, 1))
            for _ in range(transient):
                x = mix(logistic(x, a[:, None]))
            total, used = np.zeros(m), np.zeros(m)
            for _ in range(max(1, n // segment)):
                w, scale = np.zeros((m, sites)), np.zeros(m)
                w[:, middle] = 1.0
                for k in range(segment):
                    w = mix(logistic_slope(x, a[:, None]) * w)
                    x = mix(logistic(x, a[:, None]))
                    if (k + 1) % every == 0:
                        size = np.maximum(np.linalg.norm(w, axis=1), 1e-300)
                        w, scale = w / size[:, None], scale + np.log(size)
                at = middle + np.floor(v * segment).astype(int)
                inside = (at >= 0) & (at < sites)
                here = np.abs(w[np.arange(m), np.where(inside, at, 0)])
                ok = inside & (here > 0)
                total += np.where(ok, (scale + np.log(np.where(ok, here, 1))) / segment, 0)
                used += ok
            yield pd.DataFrame({"param_id": pdf["param_id"], "v": v, "exponent": np.where(used > 0, total / np.maximum(used, 1), -10.0)})

    return rows.mapInPandas(run, "param_id long, v double, exponent double")


def jacobian_block(states: DataFrame, a: float, eps: float, size: int) -> DataFrame:
    """(run_id, t, i, j, v): the non-zero entries of the periodic Jacobian among the first ``size`` sites."""
    n = F.count("*").over(Window.partitionBy("run_id", "t"))
    s = states.select("run_id", "t", "site", logistic_slope(F.col("x"), a).alias("s"), n.cast("int").alias("n"))
    near = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in ((0, 1.0 - eps), (-1, eps / 2), (1, eps / 2))])).alias("e")
    cells = s.select("run_id", "t", "site", "s", "n", near).select("run_id", "t", F.pmod(F.col("site") + F.col("e.k"), F.col("n")).alias("i"), F.col("site").alias("j"), (F.col("e.w") * F.col("s")).alias("v"))
    return cells.filter((F.col("i") < size) & (F.col("j") < size))


def reference_orbit(params: DataFrame, transient: int, period: int) -> DataFrame:
    """(param_id, t, p0, p1): a period of the coupled logistic maps' orbit from (x0, x1) of each (param_id, A, D, x0, x1), after a transient."""
    return trajectories(params, "coupled_logistic", period, transient)


def basin(params: DataFrame, transient: int, reference: list[tuple[float, float]]) -> DataFrame:
    """(param_id, label) for each (A, D, x, y): 1 if the final state is nearer to the reference orbit than to its mirror image, else 2;
    -1 where it diverges, 0 on the diagonal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = np.array(reference)
        for pdf in batches:
            a, d, x, y = (pdf[c].to_numpy() for c in ("A", "D", "x", "y"))
            with np.errstate(all="ignore"):
                for _ in range(transient):
                    x, y = logistic(x, a) + d * (y - x), logistic(y, a) + d * (x - y)
                near = lambda r: ((x[:, None] - r[:, 0]) ** 2 + (y[:, None] - r[:, 1]) ** 2).min(axis=1)
                label = np.where(near(ref) <= near(ref[:, ::-1]), 1, 2)
            label = np.where(np.abs(x - y) < 1e-12, 0, label)
            yield pd.DataFrame({"param_id": pdf["param_id"], "label": np.where(np.isfinite(x + y) & (np.abs(x) < 1e10), label, -1)})

    return params.mapInPandas(run, "param_id long, label int")


def decay_rate(pmf: DataFrame) -> DataFrame:
    """(run_id, rate): minus the slope of ln p against length."""
    return pmf.filter("p > 0").groupBy("run_id").agg((-F.regr_slope(F.log("p"), F.col("length"))).alias("rate"))


