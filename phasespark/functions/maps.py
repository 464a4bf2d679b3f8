"""Discrete maps, normal forms and flows, each for a whole batch of parameter rows at once.

A state is a list of arrays, one per coordinate, with an entry per parameter row; parameters are arrays alike. Jacobians are nested lists
of the same arrays (or numbers). The same formulas serve Spark columns where they use arithmetic only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import pi, sqrt

import numpy as np


def logistic(x, a):
    """1 - a x^2."""
    return 1.0 - a * x * x


def logistic_slope(x, a):
    return -2.0 * a * x


@dataclass(frozen=True)
class System:
    """step(state, parameters) and jacobian(state, parameters) with default parameters and initial state."""

    step: Callable
    start: tuple[float, ...]
    defaults: dict[str, float] = field(default_factory=dict)
    jacobian: Callable | None = None

    def parameters(self, given: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
        return {k: np.asarray(given.get(k, np.full(n, v)), dtype=np.float64) for k, v in self.defaults.items()}


def _circle(s, p):
    return [np.mod(s[0] + p["D"] + p["A"] * np.sin(2 * pi * s[0]), 1.0)]


def _circle_unwrapped(s, p):
    return [s[0] + p["D"] + p["A"] * np.sin(2 * pi * s[0])]


def _modulated(s, p):
    turn = np.sin(2 * pi * s[0])
    return [np.mod(s[0] + p["A"] * turn + p["D"] + p["eps"] * np.sin(2 * pi * s[1]), 1.0), np.mod(s[1] + p["C"], 1.0)]


def _coupled_logistic(s, p):
    x, y = s
    return [logistic(x, p["A"]) + p["D"] * (y - x), logistic(y, p["A"]) + p["D"] * (x - y)]


def _delayed(s, p):
    return [p["A"] * s[0] + (1.0 - p["A"]) * logistic(s[1], p["D"]), s[0]]


def _coupled_delayed(s, p):
    x, y, z, w = s
    grow = lambda v, d: d * v * (1.0 - v)
    return [p["A"] * x + grow(y, p["DA"]) + p["eps"] * (z - w), x, p["A"] * z + grow(w, p["DB"]) + p["eps"] * (y - x), z]


def _map_one(s, p):
    x, y, z = s
    return [p["A"] * x + (1.0 - p["A"]) * logistic(y, p["D"]), z, x]


def _map_four(s, p):
    x, y, z, w = s
    pull = lambda own, late: p["A"] * own + (1.0 - p["A"]) * logistic(late, p["D"])
    return [pull(x, y), z, pull(z, w), x]


def _standard(s, p):
    momentum = s[1] + p["K"] * np.sin(s[0])
    return [np.mod(s[0] + momentum, 2 * pi), np.mod(momentum, 2 * pi)]


def _type_one(s, p):
    x = s[0] + p["eps"] + p["a"] * s[0] * s[0]
    return [np.where(p["modulo"] != 0, np.mod(x, 1.0), x)]


def _type_two(s, p):
    grow = 1.0 + p["eps"] + p["a"] * (s[0] * s[0] + s[1] * s[1])
    c, d = np.cos(p["theta"]), np.sin(p["theta"])
    return [grow * (c * s[0] - d * s[1]), grow * (d * s[0] + c * s[1])]


def _skew(s, p):
    kick = 4.0 * p["eps"] * (1.0 - 2.0 * s[0])
    return [4.0 * s[0] * (1.0 - s[0]), kick * s[1] / (1.0 + s[1] * s[1])]


SYSTEMS: dict[str, System] = {
    "logistic": System(lambda s, p: [logistic(s[0], p["a"])], (0.1,), {"a": 1.99}, lambda s, p: [[logistic_slope(s[0], p["a"])]]),
    "circle": System(_circle, (0.1,), {"A": 0.1, "D": 0.25}, lambda s, p: [[1.0 + 2 * pi * p["A"] * np.cos(2 * pi * s[0])]]),
    "circle_unwrapped": System(_circle_unwrapped, (0.1,), {"A": 0.1, "D": 0.25}),
    "modulated_circle": System(_modulated, (0.1, 0.1), {"A": 0.1, "C": (sqrt(5) - 1) / 2, "D": 0.25, "eps": 0.05}),
    "coupled_logistic": System(
        _coupled_logistic,
        (0.1, 0.2),
        {"A": 1.2, "D": 0.1},
        lambda s, p: [[logistic_slope(s[0], p["A"]) - p["D"], p["D"]], [p["D"], logistic_slope(s[1], p["A"]) - p["D"]]],
    ),
    "delayed_logistic": System(
        _delayed, (0.1, 0.1), {"A": 0.3, "D": 1.5}, lambda s, p: [[p["A"], (1.0 - p["A"]) * logistic_slope(s[1], p["D"])], [1.0, 0.0]]
    ),
    "coupled_delayed": System(
        _coupled_delayed,
        (0.3, 0.3, 0.31, 0.31),
        {"A": 0.4, "DA": 2.0, "DB": 2.0, "eps": 0.005},
        lambda s, p: [
            [p["A"], p["DA"] * (1.0 - 2.0 * s[1]), p["eps"], -p["eps"]],
            [1.0, 0.0, 0.0, 0.0],
            [-p["eps"], p["eps"], p["A"], p["DB"] * (1.0 - 2.0 * s[3])],
            [0.0, 0.0, 1.0, 0.0],
        ],
    ),
    "map_I": System(
        _map_one,
        (0.1, 0.1, 0.1),
        {"A": 0.4, "D": 1.4},
        lambda s, p: [[p["A"], (1.0 - p["A"]) * logistic_slope(s[1], p["D"]), 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]],
    ),
    "map_IV": System(
        _map_four,
        (0.1, 0.1, 0.1, 0.1),
        {"A": 0.3, "D": 1.4},
        lambda s, p: [
            [p["A"], (1.0 - p["A"]) * logistic_slope(s[1], p["D"]), 0.0, 0.0],
            [0.0, 0.0, 1.0, 0.0],
            [0.0, 0.0, p["A"], (1.0 - p["A"]) * logistic_slope(s[3], p["D"])],
            [1.0, 0.0, 0.0, 0.0],
        ],
    ),
    "henon": System(
        lambda s, p: [1.0 - p["a"] * s[0] * s[0] + s[1], p["b"] * s[0]], (0.1, 0.1), {"a": 1.4, "b": 0.3}, lambda s, p: [[-2.0 * p["a"] * s[0], 1.0], [p["b"], 0.0]]
    ),
    "standard": System(
        _standard, (0.5, 0.5), {"K": 1.0}, lambda s, p: [[1.0 + p["K"] * np.cos(s[0]), 1.0], [p["K"] * np.cos(s[0]), 1.0]]
    ),
    "type_i": System(_type_one, (0.0,), {"eps": 1e-4, "a": 1.0, "modulo": 1.0}),
    "type_ii": System(_type_two, (1e-3, 0.0), {"eps": 1e-3, "a": -1.0, "theta": sqrt(5.0)}),
    "type_iii": System(lambda s, p: [-(1.0 + p["eps"]) * s[0] - p["a"] * s[0] * s[0] * s[0]], (1e-3,), {"eps": 1e-3, "a": 1.0}),
    "on_off_skew": System(_skew, (0.217, 1e-2), {"eps": 0.499}),
    "logistic_type_i": System(lambda s, p: [p["r"] * s[0] * (1.0 - s[0])], (0.2,), {"r": 1 + sqrt(8.0) - 1e-4}),
}


def lorenz(s, p):
    x, y, z = s
    return [p["sigma"] * (y - x), x * (p["rho"] - z) - y, x * y - p["beta"] * z]


def lorenz_jacobian(s, p):
    x, y, z = s
    return [[-p["sigma"], p["sigma"], 0.0], [p["rho"] - z, -1.0, -x], [y, x, -p["beta"]]]


def rossler(s, p):
    x, y, z = s
    return [-y - z, x + p["a"] * y, p["b"] + z * (x - p["c"])]


def rossler_jacobian(s, p):
    x, _, z = s
    return [[0.0, -1.0, -1.0], [1.0, p["a"], 0.0], [z, 0.0, x - p["c"]]]


FLOWS: dict[str, System] = {
    "lorenz": System(lorenz, (1.0, 1.0, 1.0), {"sigma": 10.0, "rho": 28.0, "beta": 8.0 / 3.0}, lorenz_jacobian),
    "rossler": System(rossler, (1.0, 1.0, 0.0), {"a": 0.2, "b": 0.2, "c": 5.7}, rossler_jacobian),
}


def flow_step(rhs: Callable, s: list, p: dict, dt: float, substeps: int = 8) -> list:
    """One classical fourth-order Runge-Kutta advance by dt in ``substeps``: fixed steps keep a batch of rows together."""
    h = dt / substeps
    for _ in range(substeps):
        k1 = rhs(s, p)
        k2 = rhs([x + h / 2 * k for x, k in zip(s, k1, strict=True)], p)
        k3 = rhs([x + h / 2 * k for x, k in zip(s, k2, strict=True)], p)
        k4 = rhs([x + h * k for x, k in zip(s, k3, strict=True)], p)
        s = [x + h / 6 * (a + 2 * b + 2 * c + d) for x, a, b, c, d in zip(s, k1, k2, k3, k4, strict=True)]
    return s


def matrix(jacobian: list, n: int) -> np.ndarray:
    """A nested list of arrays and numbers as an array (n, dim, dim)."""
    return np.stack([np.stack([np.broadcast_to(np.asarray(v, dtype=np.float64), (n,)) for v in row], axis=1) for row in jacobian], axis=1)
