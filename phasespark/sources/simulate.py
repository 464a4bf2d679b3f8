"""Simulated trajectories: a table of parameters in, a table of samples out.

Rows of a batch advance together in numpy, so a sweep costs one vectorised loop per batch; batches spread over the cluster. Samples leave
in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from phasespark.functions.maps import FLOWS, SYSTEMS, System, flow_step

ROWS_PER_PIECE = 200_000


def grid(spark: SparkSession, **axes: list[float]) -> DataFrame:
    """(param_id, axes...): all combinations of the values of each axis, in order."""
    names = list(axes)
    sizes = [len(axes[k]) for k in names]
    total = int(np.prod(sizes))
    values = [np.asarray(axes[k], dtype=np.float64) for k in names]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unravel_index(pdf["param_id"].to_numpy(), sizes)
            yield pd.DataFrame({"param_id": pdf["param_id"]} | {k: v[i] for k, v, i in zip(names, values, at, strict=True)})

    parts = max(1, min(total, spark.sparkContext.defaultParallelism))
    return spark.range(0, total, 1, parts).withColumnRenamed("id", "param_id").mapInPandas(fill, "param_id long, " + ", ".join(f"{k} double" for k in names))


def _system(name: str) -> tuple[System, bool]:
    return (SYSTEMS[name], False) if name in SYSTEMS else (FLOWS[name], True)


def trajectories(
    params: DataFrame,
    system: str,
    n: int,
    transient: int = 0,
    *,
    start: tuple[float, ...] | None = None,
    record_first: bool = False,
    dt: float = 0.01,
    escape: float = 1e10,
) -> DataFrame:
    """(param_id, t, p0..): ``n`` samples of a map or flow for every row of ``params`` after ``transient`` steps.

    Samples are taken after each step, or before it with ``record_first``. A row whose state leaves ``escape`` ends there. Columns x0..
    of ``params`` give a row its own initial state.
    """
    own, flow = _system(system)
    dim = len(own.start)
    first = start or own.start

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            p = own.parameters({k: pdf[k].to_numpy() for k in pdf.columns}, m)
            ids = pdf["param_id"].to_numpy()
            s = [pdf[f"x{j}"].to_numpy(np.float64) if f"x{j}" in pdf else np.full(m, float(first[j])) for j in range(dim)]
            advance = (lambda s: flow_step(own.step, s, p, dt)) if flow else (lambda s: own.step(s, p))
            alive = np.ones(m, bool)
            piece, rows = [], 0
            with np.errstate(all="ignore"):
                for t in range(-transient, n):
                    before = s
                    s = advance(s)
                    seen = before if record_first else s
                    alive &= np.all([np.abs(c) <= escape for c in seen], axis=0)
                    if t < 0:
                        continue
                    piece.append(pd.DataFrame({"param_id": ids[alive], "t": np.full(alive.sum(), t)} | {f"p{j}": seen[j][alive] for j in range(dim)}))
                    rows += int(alive.sum())
                    if rows >= ROWS_PER_PIECE:
                        yield pd.concat(piece)
                        piece, rows = [], 0
                    if not alive.any():
                        break
            if piece:
                yield pd.concat(piece)

    return params.mapInPandas(run, "param_id long, t long, " + ", ".join(f"p{j} double" for j in range(dim)))


def on_off(params: DataFrame, n: int, x0: float = 1e-6) -> DataFrame:
    """(param_id, t, x): noise-driven multiplicative process. Columns of ``params``: param_id, seed and optionally transverse, noise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                kick = np.exp(row.get("transverse", 0.0) + row.get("noise", 0.25) * np.random.default_rng(int(row["seed"])).normal(size=n))
                x, out = x0, np.empty(n)
                for t in range(n):
                    x = kick[t] * x / (1.0 + x * x)
                    out[t] = x
                yield pd.DataFrame({"param_id": row["param_id"], "t": np.arange(n), "x": out})

    return params.mapInPandas(run, "param_id long, t long, x double")


def mackey_glass(params: DataFrame, n: int, *, dt: float = 1.0, t_transient: float = 500.0, beta: float = 0.2, gamma: float = 0.1, power: float = 10.0) -> DataFrame:
    """(param_id, t, x) of the delay equation for each ``tau`` of ``params``: explicit Euler at a tenth of a unit, history 1.2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = max(1, int(dt / 0.1))
        h = dt / every
        for pdf in batches:
            for row in pdf.to_dict("records"):
                past = np.full(int(row["tau"] * dt / h) + 1, 1.2)
                skip, x, out = int(t_transient / h), 1.2, []
                for k in range(skip + n * every):
                    at = k % len(past)
                    x += h * (beta * past[at] / (1.0 + past[at] ** power) - gamma * x)
                    past[at] = x
                    if k >= skip and (k - skip) % every == 0:
                        out.append(x)
                yield pd.DataFrame({"param_id": row["param_id"], "t": np.arange(len(out)), "x": out})

    return params.mapInPandas(run, "param_id long, t long, x double")
