"""Chaos indicators: tangent-space exponents, alignment indices and the 0-1 test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasespark.functions.maps import FLOWS, SYSTEMS, flow_step, matrix


def lyapunov_logistic(params: DataFrame, n: int, transient: int = 0, x0: float = 0.1) -> DataFrame:
    """(param_id, lyapunov) of 1 - a x^2 for each ``a``: a fold inside the JVM, no Python worker. Slopes are floored at 1e-300."""
    step = lambda x: 1.0 - F.col("a") * x * x
    start = F.aggregate(F.sequence(F.lit(1), F.lit(transient)), F.lit(float(x0)), lambda x, _: step(x)) if transient else F.lit(float(x0))

    def add(acc: Column, _: Column) -> Column:
        slope = F.greatest(F.abs(-2.0 * F.col("a") * acc["x"]), F.lit(1e-300))
        return F.struct(step(acc["x"]).alias("x"), (acc["s"] + F.log(slope)).alias("s"))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.struct(start.alias("x"), F.lit(0.0).alias("s")), add, lambda acc: acc["s"] / n)
    return params.select("param_id", fold.alias("lyapunov"))


def rotation_number(params: DataFrame, n: int, transient: int = 0, theta0: float = 0.1) -> DataFrame:
    """(param_id, rho): mean unwrapped advance of the circle map for each (A, D), as a fold inside the JVM."""
    step = lambda x, _: x + F.col("D") + F.col("A") * F.sin(2 * F.pi() * x)
    start = F.aggregate(F.sequence(F.lit(1), F.lit(transient)), F.lit(float(theta0)), step) if transient else F.lit(float(theta0))
    return params.withColumn("_s", start).select("param_id", ((F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.col("_s"), step) - F.col("_s")) / n).alias("rho"))


def lyapunov_spectrum(params: DataFrame, system: str, n: int, transient: int = 0, every: int = 1, *, dt: float = 0.01) -> DataFrame:
    """(param_id, k, exponent, error): the spectrum in descending order by repeated QR of the tangent map; all rows of a batch at once.

    error is the deviation of the running estimate over ten checkpoints of the second half. For flows, steps are of ``dt``, the tangent
    follows the midpoint's Jacobian, and exponents are per unit of time.
    """
    flow = system in FLOWS
    own = FLOWS[system] if flow else SYSTEMS[system]
    dim = len(own.start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            p = own.parameters({k: pdf[k].to_numpy() for k in pdf.columns}, m)
            s = [np.full(m, v) for v in own.start]
            checks = set(np.unique(np.linspace(n // 2, n, 10, dtype=int)).tolist()) - {0}
            q, total, count, seen = np.broadcast_to(np.eye(dim), (m, dim, dim)).copy(), np.zeros((m, dim)), 0, []
            with np.errstate(all="ignore"):
                for i in range(-transient, n):
                    if i >= 0:
                        j = matrix(own.jacobian(s, p), m)
                        if flow:
                            a = dt * j
                            q = q + a @ q + a @ (a @ q) / 2 + a @ (a @ (a @ q)) / 6
                        else:
                            q = j @ q
                    s = flow_step(own.step, s, p, dt, 4) if flow else own.step(s, p)
                    if i >= 0 and (i + 1) % every == 0:
                        bad = ~np.isfinite(q).all(axis=(1, 2))
                        q[bad] = np.eye(dim)
                        q, r = np.linalg.qr(q)
                        d = np.abs(np.diagonal(r, axis1=1, axis2=2))
                        total += np.where(bad[:, None], np.nan, np.log(np.where(d > 0, d, 1e-300)))
                        count += 1
                        if i + 1 in checks:
                            seen.append(total / (count * every))
            mean = total / (count * every) / (dt if flow else 1.0)
            error = np.std(seen, axis=0) / (dt if flow else 1.0) if seen else np.zeros_like(mean)
            order = np.argsort(-mean, axis=1)
            for k in range(dim):
                at = order[:, k]
                yield pd.DataFrame({"param_id": pdf["param_id"], "k": k, "exponent": mean[np.arange(m), at], "error": error[np.arange(m), at]})

    return params.mapInPandas(run, "param_id long, k int, exponent double, error double")


def alignment(params: DataFrame, system: str, n: int, transient: int = 0, k: int = 2, seed: int = 42) -> DataFrame:
    """(param_id, t, sali, gali): smaller alignment of the first two unit tangent vectors, and the volume that k of them span."""
    own = SYSTEMS[system]
    dim = len(own.start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            p = own.parameters({c: pdf[c].to_numpy() for c in pdf.columns}, m)
            s = [np.full(m, v) for v in own.start]
            v = np.broadcast_to(np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, k)))[0], (m, dim, k)).copy()
            for i in range(-transient, n):
                j = matrix(own.jacobian(s, p), m)
                s = own.step(s, p)
                if i < 0:
                    continue
                v = j @ v
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                a, b = v[:, :, 0], v[:, :, min(1, k - 1)]
                sali = np.minimum(np.linalg.norm(a + b, axis=1), np.linalg.norm(a - b, axis=1))
                yield pd.DataFrame({"param_id": pdf["param_id"], "t": i, "sali": sali, "gali": np.prod(np.linalg.svd(v, compute_uv=False), axis=1)})

    return params.mapInPandas(run, "param_id long, t long, sali double, gali double")


def rotation_numbers(params: DataFrame, n: int, transient: int) -> DataFrame:
    """(param_id, rho_theta, rho_phi) of the modulated circle map for each (param_id, A, C, D, eps): mean turns a step of both angles."""
    own = SYSTEMS["modulated_circle"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = own.parameters({c: pdf[c].to_numpy() for c in pdf.columns}, len(pdf))
            theta, phi = (np.full(len(pdf), v) for v in own.start)
            for t in range(transient + n):
                if t == transient:
                    start = theta, phi
                theta, phi = theta + p["A"] * np.sin(2 * np.pi * theta) + p["D"] + p["eps"] * np.sin(2 * np.pi * phi), phi + p["C"]
            yield pd.DataFrame({"param_id": pdf["param_id"], "rho_theta": (theta - start[0]) / n, "rho_phi": (phi - start[1]) / n})

    return params.mapInPandas(run, "param_id long, rho_theta double, rho_phi double")


def lyapunov_max(params: DataFrame, system: str, n: int, transient: int = 0) -> DataFrame:
    """(param_id, lyapunov): the largest exponent, from the growth of one tangent vector that is drawn back to unit length each step.

    It starts as (1, 1, ..); one that vanishes counts -100 and starts anew.
    """
    own = SYSTEMS[system]
    dim = len(own.start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            p = own.parameters({c: pdf[c].to_numpy() for c in pdf.columns}, m)
            s, total = [np.full(m, v) for v in own.start], np.zeros(m)
            v = np.full((m, dim), dim**-0.5)
            for t in range(-transient, n):
                if t >= 0:
                    v = (matrix(own.jacobian(s, p), m) @ v[:, :, None])[:, :, 0]
                    size = np.linalg.norm(v, axis=1)
                    total += np.where(size > 0, np.log(np.where(size > 0, size, 1.0)), -100.0)
                    v = np.where(size[:, None] > 0, v / np.where(size > 0, size, 1.0)[:, None], dim**-0.5)
                s = own.step(s, p)
            yield pd.DataFrame({"param_id": pdf["param_id"], "lyapunov": total / n})

    return params.mapInPandas(run, "param_id long, lyapunov double")


def frequencies(n_c: int, seed: int = 0) -> list[float]:
    """``n_c`` random angles in (pi/5, 4 pi/5)."""
    return np.random.default_rng(seed).uniform(np.pi / 5, 4 * np.pi / 5, n_c).tolist()


def zero_one(signals: DataFrame, c_values: list[float], n_cut: int) -> DataFrame:
    """(series_id, c, k): the growth of the translation variables' mean-square displacement, as a correlation with the lag.

    Displacements follow from unbiased autocovariances at lags 0..n_cut-1, correlated with 1..n_cut; a flat one gives 0. Running sums and
    the later values of a point come from windows over (series, c): nothing is joined.
    """
    if not c_values or int(n_cut) != n_cut or n_cut < 2:
        raise ValueError("an angle and a whole number of at least 2 lags are needed")
    by = Window.partitionBy("series_id", "c").orderBy("t")
    whole = Window.partitionBy("series_id", "c")
    s = signals.withColumn("c", F.explode(F.array(*map(F.lit, c_values))))
    angle = (F.col("t") + 1) * F.col("c")
    walked = s.select("series_id", "c", "t", F.sum(F.col("x") * F.cos(angle)).over(by).alias("p"), F.sum(F.col("x") * F.sin(angle)).over(by).alias("q"))
    centred = walked.select("series_id", "c", "t", (F.col("p") - F.avg("p").over(whole)).alias("p"), (F.col("q") - F.avg("q").over(whole)).alias("q"))
    ahead = F.collect_list(F.struct("p", "q")).over(by.rowsBetween(0, n_cut - 1))
    terms = centred.select("series_id", "c", "p", "q", ahead.alias("ahead")).select("series_id", "c", "p", "q", F.posexplode("ahead").alias("lag", "b"))
    acov = terms.groupBy("series_id", "c", "lag").agg(F.avg(F.col("p") * F.col("b.p") + F.col("q") * F.col("b.q")).alias("a"))
    d = acov.select("series_id", "c", "lag", (2 * (F.max(F.when(F.col("lag") == 0, F.col("a"))).over(whole) - F.col("a"))).alias("d"))
    flat = F.max(F.abs("d")) <= 1e-15
    return d.groupBy("series_id", "c").agg(F.when(flat, 0.0).otherwise(F.corr("lag", "d")).alias("k"))


def zero_one_statistic(signals: DataFrame, c_values: list[float], n_cut: int) -> DataFrame:
    """(series_id, k): the median over all angles."""
    return zero_one(signals, c_values, n_cut).groupBy("series_id").agg(F.percentile("k", 0.5).alias("k"))
