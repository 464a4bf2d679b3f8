"""More named queries: simulated systems, lattices, sections and intermittency composites, with recursive SQL beside the simulations."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasespark.operators import chaos, correlation, intermittency, lattice, multifractal, sections, sweeps
from phasespark.operators.embedding import embed
from phasespark.plans.registry import FIELD, LOG, PEAKS, PERIOD, RING, SIG, cheb, dimension_sql, emb, logistic_grid, order_values, period_mask, quantity_field, query, ring, rounded
from phasespark.sources import signals as src
from phasespark.sources import simulate
from phasespark.sources.tables import table


def one(spark) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("param_id"))


# --- trajectories -------------------------------------------------------------------------------------------------------------------


def walk_sql(start: tuple[float, ...], step: list[str], last: int) -> str:
    """CTE ``w``: states s0.. by step k, from k = 0; ``step`` gives the next state in terms of s0.."""
    names = [f"s{j}" for j in range(len(start))]
    first = ", ".join(f"CAST({v!r} AS DOUBLE)" for v in start)
    return f"RECURSIVE w(k, {', '.join(names)}) AS (SELECT 0, {first} UNION ALL SELECT k + 1, {', '.join(step)} FROM w WHERE k < {last})"


def trajectory_sql(start: tuple[float, ...], step: list[str], n: int, transient: int) -> str:
    columns = ", ".join(f"round(s{j}, 6) + 0.0 p{j}" for j in range(len(start)))
    return f"WITH {walk_sql(start, step, n + transient)} SELECT CAST(0 AS BIGINT) param_id, CAST(k - 1 - {transient} AS BIGINT) t, {columns} FROM w WHERE k > {transient}"


def runge_kutta_sql(rates: list[str], h: float) -> list[str]:
    """One step by a nested query each for the four slopes; ``rates`` in terms of {0}, {1}, {2}."""
    at = [f"s{j}" for j in range(3)]
    slopes = []
    for factor in (0.0, h / 2, h / 2, h):
        place = [f"({s} + {factor!r} * {k})" if slopes else s for s, k in zip(at, slopes[-1] if slopes else at, strict=True)]
        slopes.append([f"({r.format(*place)})" for r in rates])
    return [f"{s} + {h / 6!r} * ({a} + 2 * {b} + 2 * {c} + {d})" for s, a, b, c, d in zip(at, *slopes, strict=True)]


GOLDEN, ANGLE = repr((sqrt(5) - 1) / 2), sqrt(5.0)
TURN = "1.0 + 1e-3 - (s0 * s0 + s1 * s1)"
MAPS = {
    "circle": ((0.1,), ["(s0 + 0.25 + 0.1 * sin(2 * pi() * s0)) - floor(s0 + 0.25 + 0.1 * sin(2 * pi() * s0))"]),
    "modulated_circle": (
        (0.1, 0.1),
        [
            "(s0 + 0.1 * sin(2 * pi() * s0) + 0.25 + 0.05 * sin(2 * pi() * s1)) - floor(s0 + 0.1 * sin(2 * pi() * s0) + 0.25 + 0.05 * sin(2 * pi() * s1))",
            f"(s1 + {GOLDEN}) - floor(s1 + {GOLDEN})",
        ],
    ),
    "coupled_logistic": ((0.1, 0.2), ["(1.0 - 1.2 * s0 * s0) + 0.1 * (s1 - s0)", "(1.0 - 1.2 * s1 * s1) + 0.1 * (s0 - s1)"]),
    "delayed_logistic": ((0.1, 0.1), ["0.3 * s0 + (1.0 - 0.3) * (1.0 - 1.5 * s1 * s1)", "s0"]),
    "coupled_delayed": (
        (0.3, 0.3, 0.31, 0.31),
        ["0.4 * s0 + 2.0 * s1 * (1.0 - s1) + 0.005 * (s2 - s3)", "s0", "0.4 * s2 + 2.0 * s3 * (1.0 - s3) + 0.005 * (s1 - s0)", "s2"],
    ),
    "map_I": ((0.1, 0.1, 0.1), ["0.4 * s0 + (1.0 - 0.4) * (1.0 - 1.4 * s1 * s1)", "s2", "s0"]),
    "map_IV": ((0.1, 0.1, 0.1, 0.1), ["0.3 * s0 + (1.0 - 0.3) * (1.0 - 1.4 * s1 * s1)", "s2", "0.3 * s2 + (1.0 - 0.3) * (1.0 - 1.4 * s3 * s3)", "s0"]),
    "standard": (
        (0.5, 0.5),
        [
            "(s0 + s1 + sin(s0)) - 2 * pi() * floor((s0 + s1 + sin(s0)) / (2 * pi()))",
            "(s1 + sin(s0)) - 2 * pi() * floor((s1 + sin(s0)) / (2 * pi()))",
        ],
    ),
    "type_i": ((0.0,), ["(s0 + 1e-4 + s0 * s0) - floor(s0 + 1e-4 + s0 * s0)"]),
    "type_ii": ((1e-3, 0.0), [f"({TURN}) * (cos({ANGLE!r}) * s0 - sin({ANGLE!r}) * s1)", f"({TURN}) * (sin({ANGLE!r}) * s0 + cos({ANGLE!r}) * s1)"]),
    "type_iii": ((1e-3,), ["-(1.0 + 1e-3) * s0 - s0 * s0 * s0"]),
    "logistic_type_i": ((0.2,), [f"{1 + sqrt(8.0) - 1e-4!r} * s0 * (1.0 - s0)"]),
}
#: Steps short enough that the last bits of a sine don't grow into six places.
CHAOTIC = {"standard": (60, 10)}


def _trajectory(system: str, n: int, transient: int, **more):
    def run(spark, sf_dir):
        return rounded(simulate.trajectories(one(spark), system, n, transient, **more))

    run.__name__ = f"trajectory_{system}"
    return run


for _name, (_start, _step) in MAPS.items():
    _n, _transient = CHAOTIC.get(_name, (200, 50))
    query(trajectory_sql(_start, _step, _n, _transient))(_trajectory(_name, _n, _transient))


def flow_sql(start: tuple[float, ...], rates: list[str], n: int, transient: int, dt: float, substeps: int = 8) -> str:
    """Substeps are steps of the recursion; every eighth state is a sample."""
    columns = ", ".join(f"round(s{j}, 6) + 0.0 p{j}" for j in range(3))
    last = (n + transient) * substeps
    return f"WITH {walk_sql(start, runge_kutta_sql(rates, dt / substeps), last)} SELECT CAST(0 AS BIGINT) param_id, CAST(k // {substeps} - 1 - {transient} AS BIGINT) t, {columns} FROM w WHERE k > {transient * substeps} AND k % {substeps} = 0"


query(flow_sql((1.0, 1.0, 1.0), ["10.0 * ({1} - {0})", "{0} * (28.0 - {2}) - {1}", f"{{0}} * {{1}} - {8.0 / 3.0!r} * {{2}}"], 200, 100, 0.02))(_trajectory("lorenz", 200, 100, dt=0.02))
query(flow_sql((1.0, 1.0, 0.0), ["-{1} - {2}", "{0} + 0.2 * {1}", "0.2 + {2} * ({0} - 5.7)"], 200, 100, 0.02))(_trajectory("rossler", 200, 100, dt=0.02))


@query("""RECURSIVE w(k, x, past) AS (SELECT 0, CAST(1.2 AS DOUBLE), list_transform(range(171), lambda i: CAST(1.2 AS DOUBLE)) UNION ALL
 SELECT k + 1, x + 0.1 * (0.2 * past[1] / (1.0 + pow(past[1], 10)) - 0.1 * x), list_append(past[2:], x + 0.1 * (0.2 * past[1] / (1.0 + pow(past[1], 10)) - 0.1 * x)) FROM w WHERE k < 7991)
 SELECT CAST(0 AS BIGINT) param_id, CAST((k - 5001) // 10 AS BIGINT) t, round(x, 6) x FROM w WHERE k > 5000 AND (k - 5001) % 10 = 0""")
def mackey_glass(spark, sf_dir):
    return rounded(simulate.mackey_glass(one(spark).withColumn("tau", F.lit(17.0)), 300))


@query("""RECURSIVE w(p, k, th, ph) AS (SELECT k, 0, CAST(0.1 AS DOUBLE), CAST(0.1 AS DOUBLE) FROM range(6) r(k) UNION ALL
 SELECT p, k + 1, th + 0.1 * sin(2 * pi() * th) + (0.1 + 0.05 * p) + 0.05 * sin(2 * pi() * ph), ph + """ + GOLDEN + """ FROM w WHERE k < 300)
 SELECT CAST(a.p AS BIGINT) param_id, round((b.th - a.th) / 250, 6) rho_theta, round((b.ph - a.ph) / 250, 6) rho_phi FROM w a JOIN w b USING (p) WHERE a.k = 50 AND b.k = 300""")
def rotation_numbers_modulated(spark, sf_dir):
    params = spark.range(6).select(F.col("id").alias("param_id"), (0.1 + 0.05 * F.col("id")).alias("D"))
    return rounded(chaos.rotation_numbers(params, 250, 50))


def tangent_sql(grid: str, start: tuple[float, ...], step: list[str], rows: list[list[str]], n: int, transient: int) -> str:
    """The largest exponent of a two-dimensional map: states and one tangent side by side in a recursion over (p, D)."""
    u, v = (" + ".join(f"({c}) * {t}" for c, t in zip(row, ("u", "v"), strict=True)) for row in rows)
    size = f"sqrt(pow({u}, 2) + pow({v}, 2))"
    move = lambda e, old: f"CASE WHEN k < {transient} THEN {old} ELSE ({e}) / {size} END"
    return f"""RECURSIVE w(p, D, k, s0, s1, u, v, total) AS ({grid.format(start=", ".join(f"CAST({x!r} AS DOUBLE)" for x in start))} UNION ALL
 SELECT p, D, k + 1, {step[0]}, {step[1]}, {move(u, "u")}, {move(v, "v")}, CASE WHEN k < {transient} THEN 0 ELSE total + ln({size}) END FROM w WHERE k < {n + transient})
 SELECT CAST(p AS BIGINT) param_id, round(total / {n}, 5) + 0.0 lyapunov FROM w WHERE k = {n + transient}"""


@query(tangent_sql("SELECT i, 1.3 + 0.05 * i, 0, {start}, sqrt(0.5), sqrt(0.5), CAST(0 AS DOUBLE) FROM range(6) r(i)", (0.1, 0.1), ["0.3 * s0 + (1.0 - 0.3) * (1.0 - D * s1 * s1)", "s0"], [["0.3", "(1.0 - 0.3) * (-2.0 * D * s1)"], ["1.0", "0.0"]], 60, 20))
def lyapunov_max_delayed(spark, sf_dir):
    params = spark.range(6).select(F.col("id").alias("param_id"), (1.3 + 0.05 * F.col("id")).alias("D"))
    return rounded(chaos.lyapunov_max(params, "delayed_logistic", 60, 20), 5)


@query("""RECURSIVE w(p, k, x, s) AS (SELECT i, 0, CAST(0.1 AS DOUBLE), CAST(0 AS DOUBLE) FROM range(8) r(i) UNION ALL
 SELECT p, k + 1, x + (0.2 + 0.01 * p) + 0.1 * sin(2 * pi() * x), CASE WHEN k < 20 THEN 0 ELSE s + ln(abs(1 + 2 * pi() * 0.1 * cos(2 * pi() * x))) END FROM w WHERE k < 120)
 SELECT CAST(p AS BIGINT) param_id, round(s / 100, 5) + 0.0 lyapunov FROM w WHERE k = 120""")
def lyapunov_circle(spark, sf_dir):
    params = spark.range(8).select(F.col("id").alias("param_id"), (0.2 + 0.01 * F.col("id")).alias("D"))
    return rounded(chaos.lyapunov_max(params, "circle", 100, 20), 5)


def _exponents(system: str, grid: dict[str, list[float]], n: int, transient: int):
    def run(spark, sf_dir):
        return rounded(chaos.lyapunov_spectrum(simulate.grid(spark, **grid), system, n, transient))

    run.__name__ = f"lyapunov_spectrum_{system}"
    return run


for _name, _grid in (("coupled_delayed", {"DA": [1.6, 1.8], "DB": [1.6, 1.8]}), ("map_I", {"D": [1.2, 1.4]}), ("map_IV", {"D": [1.2, 1.4]})):
    query()(_exponents(_name, _grid, 300, 100))


# --- 0-1 test, fields, escapes ----------------------------------------------------------------------------------------------------------


def zero_one_sql(of: str, n_cut: int, angles: list[float], key: str = "series_id") -> str:
    return f"""cs AS (SELECT unnest({angles}::DOUBLE[]) c), zw AS (SELECT {key}, t, c, sum(x * cos((t + 1) * c)) OVER s p, sum(x * sin((t + 1) * c)) OVER s q FROM {of}, cs WINDOW s AS (PARTITION BY {key}, c ORDER BY t)),
 zc AS (SELECT {key}, t, c, p - avg(p) OVER s p, q - avg(q) OVER s q FROM zw WINDOW s AS (PARTITION BY {key}, c)),
 za AS (SELECT a.{key}, a.c, b.t - a.t lag, avg(a.p * b.p + a.q * b.q) v FROM zc a JOIN zc b ON a.{key} = b.{key} AND a.c = b.c AND b.t - a.t BETWEEN 0 AND {n_cut - 1} GROUP BY 1, 2, 3),
 zd AS (SELECT *, 2 * (max(v) FILTER (WHERE lag = 0) OVER (PARTITION BY {key}, c) - v) d FROM za), zk AS (SELECT {key}, c, corr(lag, d) k FROM zd GROUP BY 1, 2)"""


@query(f"{SIG}, {zero_one_sql('sig', 6, chaos.frequencies(15))} SELECT series_id, round(quantile_cont(k, 0.5), 5) + 0.0 k FROM zk GROUP BY 1")
def zero_one_test(spark, sf_dir):
    return rounded(chaos.zero_one_statistic(src.events_by_user(spark, sf_dir), chaos.frequencies(15), 6), 5)


@query(f"{LOG.format(n=80)}, sig AS (SELECT param_id, a, k - 21 t, x FROM walk WHERE k > 20), {zero_one_sql('sig', 10, chaos.frequencies(10), 'param_id')} SELECT CAST(zk.param_id AS BIGINT) param_id, 1.5 + 0.05 * zk.param_id::DOUBLE a, round(quantile_cont(k, 0.5), 4) + 0.0 k FROM zk GROUP BY zk.param_id")
def zero_one_of_logistic(spark, sf_dir):
    return rounded(sweeps.sweep(logistic_grid(spark), "logistic", 60, 20, lambda s: chaos.zero_one_statistic(s, chaos.frequencies(10), 10)), 4)


@query(f"""{FIELD.split(" bx AS")[0].rstrip().rstrip(",")}, tl AS (SELECT field_id, y // 16 ty, x // 16 tx, y % 16 y, x % 16 x, mass FROM fld JOIN shp USING (field_id) WHERE (y // 16 + 1) * 16 <= ny AND (x // 16 + 1) * 16 <= nx),
 bx AS (SELECT field_id, ty, tx, box, sum(mass) m FROM tl, (SELECT unnest([1, 2, 4, 8]) box) GROUP BY field_id, ty, tx, box, y // box, x // box HAVING sum(mass) > 0), pr AS (SELECT *, m / sum(m) OVER (PARTITION BY field_id, ty, tx, box) p FROM bx),
 mo AS (SELECT field_id, ty, tx, box, ln(box) lb, ln(count(*)) z0, ln(sum(p * p)) z2 FROM pr GROUP BY 1, 2, 3, 4), ph AS (SELECT field_id, ty, tx, -regr_slope(z0, lb) - regr_slope(z2, lb) phi FROM mo GROUP BY 1, 2, 3)
 SELECT field_id, CAST(ty AS BIGINT) ty, CAST(tx AS BIGINT) tx, round(phi, 6) + 0.0 phi FROM ph""")
def multifractal_tiles(spark, sf_dir):
    out = multifractal.local_multifractality(quantity_field(spark, sf_dir), 16, [1, 2, 4, 8], [0.0, 2.0]).select("field_id", "ty", "tx", "phi")
    return rounded(out.withColumns({"ty": F.col("ty").cast("long"), "tx": F.col("tx").cast("long")}))


#: Rectangular tiles of 16 rows and 8 columns: range, mean, spread and the median fit over five exponents.
TILES = f"""{FIELD.split(" bx AS")[0].rstrip().rstrip(",")}, tl AS (SELECT field_id, y // 16 ty, x // 8 tx, y % 16 y, x % 8 x, mass FROM fld JOIN shp USING (field_id) WHERE (y // 16 + 1) * 16 <= ny AND (x // 8 + 1) * 8 <= nx),
 st AS (SELECT field_id, ty, tx, max(mass) - CASE WHEN count(*) < 128 THEN 0 ELSE min(mass) END delta, sum(mass) / 128 mean FROM tl GROUP BY 1, 2, 3),
 bx AS (SELECT field_id, ty, tx, box, sum(mass) m FROM tl, (SELECT unnest([2, 4]) box) GROUP BY field_id, ty, tx, box, y // box, x // box HAVING sum(mass) > 0), pr AS (SELECT *, m / sum(m) OVER (PARTITION BY field_id, ty, tx, box) p FROM bx),
 mo AS (SELECT field_id, ty, tx, q, ln(box) lb, ln(sum(pow(p, q))) lz FROM pr, (SELECT unnest([-2.0, 0.0, 2.0, 3.0, 4.0]::DOUBLE[]) q) GROUP BY 1, 2, 3, 4, 5),
 ft AS (SELECT field_id, ty, tx, q, regr_slope(lz, lb) sl, coalesce(regr_r2(lz, lb), 1) r2 FROM (SELECT field_id, ty, tx, q, lb, round(lz, 10) lz FROM mo) GROUP BY 1, 2, 3, 4),
 ph AS (SELECT field_id, ty, tx, -max(sl) FILTER (WHERE q = 0) - max(sl) FILTER (WHERE q = 2) phi FROM ft GROUP BY 1, 2, 3),
 tiles AS (SELECT field_id, ty, tx, coalesce(phi, 'nan'::DOUBLE) phi, delta, mean FROM st LEFT JOIN ph USING (field_id, ty, tx))"""


@query(f"{TILES} SELECT field_id, CAST(ty AS BIGINT) ty, CAST(tx AS BIGINT) tx, round(phi, 6) + 0.0 phi, round(delta, 6) delta, round(mean, 6) mean FROM tiles")
def multifractal_tile_statistics(spark, sf_dir):
    out = multifractal.local_multifractality(quantity_field(spark, sf_dir), (16, 8), None, [-2.0, 0.0, 2.0, 3.0, 4.0]).drop("r2_tau")
    return rounded(out.withColumns({"ty": F.col("ty").cast("long"), "tx": F.col("tx").cast("long")}))


@query(f"""{TILES} SELECT field_id, count(phi) FILTER (WHERE NOT isnan(phi) AND delta > 0) n, round(regr_slope(phi, ln(delta)) FILTER (WHERE NOT isnan(phi) AND delta > 0), 6) slope,
 round(regr_intercept(phi, ln(delta)) FILTER (WHERE NOT isnan(phi) AND delta > 0), 6) intercept, round(regr_r2(phi, ln(delta)) FILTER (WHERE NOT isnan(phi) AND delta > 0), 6) r2 FROM tiles WHERE delta > 0 GROUP BY 1""")
def multifractal_tile_scaling(spark, sf_dir):
    return rounded(multifractal.tile_scaling(multifractal.local_multifractality(quantity_field(spark, sf_dir), (16, 8), None, [0.0, 2.0])))


@query(f"""RECURSIVE w(p, k, s0, s1) AS (SELECT i, 0, CAST(0.05 * (i + 1) AS DOUBLE), CAST(0 AS DOUBLE) FROM range(5) r(i) UNION ALL
 SELECT p, k + 1, ({TURN.replace("1e-3 - (", "0.01 + (")}) * (cos({ANGLE!r}) * s0 - sin({ANGLE!r}) * s1), ({TURN.replace("1e-3 - (", "0.01 + (")}) * (sin({ANGLE!r}) * s0 + cos({ANGLE!r}) * s1) FROM w WHERE k < 5000 AND sqrt(s0 * s0 + s1 * s1) < 1)
 SELECT CAST(p AS BIGINT) param_id, CAST(min(k) FILTER (WHERE sqrt(s0 * s0 + s1 * s1) >= 1) AS BIGINT) length FROM w GROUP BY 1""")
def spiral_escape_lengths(spark, sf_dir):
    params = spark.range(5).select(F.col("id").alias("param_id"), F.lit(0.01).alias("eps"), F.lit(1.0).alias("a"), (0.05 * (F.col("id") + 1)).alias("x0"))
    return sweeps.escape_lengths(params, "type_ii", 1.0)


@query("""RECURSIVE w(eps, x0, k, x, y) AS (SELECT e, 0.123 + 0.02 * i, 0, CAST(0.123 + 0.02 * i AS DOUBLE), CAST(0.01 AS DOUBLE) FROM (SELECT unnest([0.45, 0.49]::DOUBLE[]) e), range(10) r(i) UNION ALL
 SELECT eps, x0, k + 1, 4.0 * x * (1.0 - x), 4.0 * eps * (1.0 - 2.0 * x) * y / (1.0 + y * y) FROM w WHERE k < 200),
 f AS (SELECT eps, x0, coalesce(min(k) FILTER (WHERE abs(y) < 1e-6), 200) n FROM w WHERE k > 0 GROUP BY 1, 2) SELECT eps, round(avg(n), 6) length FROM f GROUP BY 1""")
def mean_off_lengths(spark, sf_dir):
    params = simulate.grid(spark, eps=[0.45, 0.49], x0=[0.123 + 0.02 * k for k in range(10)])
    lengths = sweeps.first_passage(simulate.trajectories(params, "on_off_skew", 200), "p1", 1e-6)
    return rounded(params.join(lengths, "param_id").groupBy("eps").agg(F.avg("length").alias("length")))


@query("""g AS (SELECT i / 500.0 x0 FROM range(501) r(i)), a AS (SELECT x0, x0 y, CAST(1 AS DOUBLE) d FROM g), b AS (SELECT x0, R * y * (1 - y) y, d * R * (1 - 2 * y) d FROM a), c AS (SELECT x0, R * y * (1 - y) y, d * R * (1 - 2 * y) d FROM b)
 SELECT round(x0, 6) x, round(R * y * (1 - y), 6) + 0.0 y, round(d * R * (1 - 2 * y), 5) + 0.0 slope FROM c""".replace("R *", f"{1 + sqrt(8.0)!r} *"))
def third_iterate_grid(spark, sf_dir):
    out = sweeps.iterate_grid(spark, 501, 0.0, 1.0, lambda x: (1 + sqrt(8.0)) * x * (1 - x), lambda x: (1 + sqrt(8.0)) * (1 - 2 * x), 3)
    return rounded(out.withColumn("slope", F.round("slope", 5)))


@query("""g AS (SELECT -0.08 + 0.16 * i / 200.0 x FROM range(201) r(i)), a AS (SELECT x, -(1.0 + 2e-3) * x - x * x * x y, -(1.0 + 2e-3) - 3.0 * x * x d FROM g)
 SELECT round(x, 6) + 0.0 x, round(-(1.0 + 2e-3) * y - y * y * y, 6) + 0.0 y, round(d * (-(1.0 + 2e-3) - 3.0 * y * y), 5) slope FROM a""")
def second_iterate_grid(spark, sf_dir):
    out = sweeps.iterate_grid(spark, 201, -0.08, 0.08, lambda x: -(1.0 + 2e-3) * x - x * x * x, lambda x: -(1.0 + 2e-3) - 3.0 * x * x, 2)
    return rounded(out.withColumn("slope", F.round("slope", 5)))


@query("""RECURSIVE w(p, k, x) AS (SELECT i, 0, CAST(0.01 + 0.002 * i AS DOUBLE) FROM range(20) r(i) UNION ALL SELECT p, k + 1, -(1.0 + 2e-3) * x - x * x * x FROM w WHERE abs(x) < 0.35 AND k < 5000),
 n AS (SELECT p, count(*) FILTER (WHERE abs(x) < 0.35) n FROM w GROUP BY 1), o AS (SELECT p, n, coalesce(sum(n + 1) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM n)
 SELECT '0' series_id, CAST(b + k + 1 AS BIGINT) t, round(abs(x), 6) x, true laminar FROM w JOIN o USING (p) WHERE abs(x) < 0.35
 UNION ALL SELECT '0', CAST(b + n + 1 AS BIGINT), 0.42, false FROM o UNION ALL SELECT '0', 0, 0.42, false""")
def escape_episodes(spark, sf_dir):
    params = spark.range(20).select(F.col("id").alias("param_id"), (0.01 + 0.002 * F.col("id")).alias("x0"), F.lit(2e-3).alias("eps"))
    return rounded(sweeps.escape_episodes(params, "type_iii", 0.35))


@query(f"""{dimension_sql("""RECURSIVE w(p, k, s0, s1) AS (SELECT i, 0, CAST(0.1 AS DOUBLE), CAST(0.1 AS DOUBLE) FROM range(4) r(i) UNION ALL SELECT p, k + 1, 0.3 * s0 + (1.0 - 0.3) * (1.0 - (1.3 + 0.05 * p) * s1 * s1), s0 FROM w WHERE k < 150),
 pts AS (SELECT CAST(p AS VARCHAR) series_id, k - 51 t, round(s0, 9) p0, round(s1, 9) p1 FROM w WHERE k > 50), d AS (SELECT a.series_id, """ + cheb(2) + """ d FROM pts a JOIN pts b ON a.series_id = b.series_id AND b.t > a.t)""", 20)}
 SELECT CAST(i.series_id AS BIGINT) param_id, round(1.3 + 0.05 * CAST(i.series_id AS DOUBLE), 6) D, round(d2, 5) + 0.0 d2 FROM (SELECT DISTINCT series_id FROM pts) i LEFT JOIN d2 USING (series_id)""")
def dimension_sweep(spark, sf_dir):
    params = spark.range(4).select(F.col("id").alias("param_id"), (1.3 + 0.05 * F.col("id")).alias("D"))
    walk = simulate.trajectories(params, "delayed_logistic", 100, 50)
    points = walk.select(F.col("param_id").cast("string").alias("series_id"), "t", F.round("p0", 9).alias("p0"), F.round("p1", 9).alias("p1"))
    found = correlation.correlation_dimension(points, 20).select(F.col("series_id").cast("long").alias("param_id"), "d2")
    return rounded(params.join(found, "param_id").select("param_id", "D", F.round("d2", 5).alias("d2")))


# --- lattices -----------------------------------------------------------------------------------------------------------------------


def lattice_sql(grid: str, sites: int, last: int, f: str, g: str | None = None, low: float = -1.0, high: float = 1.0, kind: str = "cml") -> str:
    """CTE ``w`` (p, a, eps, k, x): states as lists; ``grid`` gives (p, a, eps), ``f`` and ``g`` are in terms of $."""
    g = g or f
    start = f"list_transform(range(1, {sites + 1}), lambda i: CAST({low} + {high - low} * (i * {GOLDEN} - floor(i * {GOLDEN})) AS DOUBLE))"
    cell = lambda e, at: "(" + e.replace("$", f"x[{at}]") + ")"
    if kind == "gcm":
        mean = f"list_avg(list_transform(x, lambda v: {f.replace('$', 'v')}))"
        step = f"list_transform(range(1, {sites + 1}), lambda i: (1.0 - eps) * {cell(f, 'i')} + eps * {mean})"
    else:
        left, right = f"(i + {sites - 2}) % {sites} + 1", f"i % {sites} + 1"
        step = f"list_transform(range(1, {sites + 1}), lambda i: {cell(f, 'i')} + eps / 2 * ({cell(g, left)} + {cell(g, right)} - 2 * {cell(g, 'i')}))"
    return f"RECURSIVE w(p, a, eps, k, x) AS (SELECT p, a, eps, 0, {start} FROM ({grid}) UNION ALL SELECT p, a, eps, k + 1, {step} FROM w WHERE k < {last})"


GRID = "SELECT i p, CAST([1.5, 1.7][i // 2 + 1] AS DOUBLE) a, CAST([0.1, 0.3][i % 2 + 1] AS DOUBLE) eps FROM range(4) r(i)"
LOGISTIC = "1.0 - a * $ * $"
CELLS = "c AS (SELECT p, a, eps, k, i - 1 site, x[i] x FROM w, range(1, {n}) r(i))"


def couplings(spark) -> DataFrame:
    return simulate.grid(spark, a=[1.5, 1.7], eps=[0.1, 0.3])


@query(f"{lattice_sql(GRID, 16, 20, LOGISTIC)}, {CELLS.format(n=17)} SELECT CAST(p AS BIGINT) run_id, CAST(k - 11 AS BIGINT) t, CAST(site AS INT) site, round(x, 6) + 0.0 x FROM c WHERE k > 10")
def lattice_simulation(spark, sf_dir):
    return rounded(lattice.simulate(couplings(spark), 16, 10, 10, seed=None))


A_GRID, B_GRID = ("SELECT i p, CAST({a} AS DOUBLE) a, CAST([{e}][i + 1] AS DOUBLE) eps FROM range(3) r(i)".format(a=a, e=e) for a, e in ((-0.01, "0.06, 0.07, 0.08"), (0.2, "0.02, 0.024, 0.03")))
A_MAP = f"CASE WHEN $ < {GOLDEN} THEN $ + $ * $ + a ELSE -3.0 * ($ - {GOLDEN}) + 1.0 + a END"
B_MAP = "($ + a * sin(2 * pi() * $) + 0.55) - floor($ + a * sin(2 * pi() * $) + 0.55)"


@query(f"{lattice_sql(A_GRID, 32, 15, A_MAP, low=0.0)}, {CELLS.format(n=33)} SELECT CAST(p AS BIGINT) run_id, CAST(k - 6 AS BIGINT) t, CAST(site AS INT) site, round(x, 6) + 0.0 x FROM c WHERE k > 5")
def lattice_model_a(spark, sf_dir):
    return rounded(lattice.simulate(simulate.grid(spark, a=[-0.01], eps=[0.06, 0.07, 0.08]), 32, 10, 5, model="A", seed=None, low=0.0))


@query(f"{lattice_sql(B_GRID, 32, 25, B_MAP, 'sin(2 * pi() * $)', low=0.0)}, {CELLS.format(n=33)} SELECT CAST(p AS BIGINT) run_id, CAST(k - 6 AS BIGINT) t, CAST(site AS INT) site, round(x, 6) + 0.0 x FROM c WHERE k > 5")
def lattice_model_b(spark, sf_dir):
    return rounded(lattice.simulate(simulate.grid(spark, a=[0.2], eps=[0.02, 0.024, 0.03]), 32, 20, 5, model="B", seed=None, low=0.0))


@query(f"{lattice_sql(GRID, 24, 30, LOGISTIC)}, {CELLS.format(n=25)} SELECT CAST(p AS BIGINT) run_id, CAST(k // 5 - 3 AS BIGINT) t, CAST(site AS INT) site, round(x, 5) + 0.0 x FROM c WHERE k > 10 AND k % 5 = 0")
def space_amplitude(spark, sf_dir):
    return rounded(lattice.simulate(couplings(spark), 24, 4, 10, seed=None, every=5), 5)


@query(f"""{lattice_sql(GRID, 20, 30, LOGISTIC)}, {CELLS.format(n=21)}, d AS (SELECT a.p, a.k, avg(abs(a.x - b.x)) s FROM c a JOIN c b ON a.p = b.p AND a.k = b.k AND b.site = (a.site + 19) % 20 WHERE a.k > 10 GROUP BY 1, 2)
 SELECT CAST(c.p AS BIGINT) param_id, round(var_pop(x), 6) + 0.0 variance, round(any_value(act), 6) activity FROM c JOIN (SELECT p, avg(s) act FROM d GROUP BY 1) e ON e.p = c.p WHERE k > 10 AND site = 10 GROUP BY c.p""")
def pattern_phase_diagram(spark, sf_dir):
    return rounded(lattice.phase_diagram(couplings(spark), 20, 20, 10, seed=None))


@query(f"{lattice_sql(GRID, 12, 20, LOGISTIC, kind='gcm')}, {CELLS.format(n=13)} SELECT CAST(p AS BIGINT) run_id, CAST(k - 11 AS BIGINT) t, CAST(site AS INT) site, round(x, 6) + 0.0 x FROM c WHERE k > 10")
def global_simulation(spark, sf_dir):
    return rounded(lattice.simulate(couplings(spark), 12, 10, 10, kind="gcm", seed=None))


@query(f"""{lattice_sql(GRID, 12, 20, LOGISTIC, kind='gcm')}, {CELLS.format(n=13)}, st AS (SELECT p, k, site, round(x, 9) x FROM c WHERE k > 10), o AS (SELECT *, coalesce((x - lag(x) OVER (PARTITION BY p, k ORDER BY x, site) > 0.05)::INT, 0) n FROM st)
 SELECT CAST(p AS BIGINT) run_id, CAST(k - 11 AS BIGINT) t, CAST(site AS INT) site, CAST(sum(n) OVER (PARTITION BY p, k ORDER BY x, site) AS BIGINT) label FROM o""")
def global_clusters(spark, sf_dir):
    return sections.cluster_labels(rounded(lattice.simulate(couplings(spark), 12, 10, 10, kind="gcm", seed=None), 9), 0.05)


def _mean_field_sql(sites: int) -> str:
    return f"""SELECT * FROM (WITH {lattice_sql("SELECT 0 p, CAST(1.6 AS DOUBLE) a, CAST(0.1 AS DOUBLE) eps", sites, 30, LOGISTIC, kind="gcm")}, h AS (SELECT k, list_avg(list_transform(x, lambda v: 1.0 - a * v * v)) h FROM w WHERE k > 10)
 SELECT CAST({sites} AS BIGINT) sites, round(avg(h), 6) mean, round(var_pop(h), 6) + 0.0 msd FROM h)"""


@query(" UNION ALL ".join(map(_mean_field_sql, (8, 16, 32))))
def mean_field_variance(spark, sf_dir):
    params = spark.createDataFrame([(i, 1.6, 0.1, n) for i, n in enumerate((8, 16, 32))], "param_id long, a double, eps double, sites long")
    return rounded(params.join(lattice.mean_field(params, 20, 10, seed=None), "param_id").select("sites", "mean", "msd"))


@query()
def collective_exponent(spark, sf_dir):
    return rounded(lattice.collective_exponent(simulate.grid(spark, a=[1.5, 1.6, 1.8], eps=[0.1]), 50, 200, 100))


@query(f"""RECURSIVE w(p, a, k, x, y) AS (SELECT i, 1.5 + 0.2 * i, 0, list_transform(range(1, 11), lambda j: -1.0 + 2.0 * (j * {GOLDEN} - floor(j * {GOLDEN}))), list_transform(range(1, 11), lambda j: (-1.0 + 2.0 * (j * {GOLDEN} - floor(j * {GOLDEN}))) + 0.01) FROM range(2) r(i) UNION ALL
 SELECT p, a, k + 1, list_transform(x, lambda v: 0.9 * (1.0 - a * v * v) + 0.1 * list_avg(list_transform(x, lambda u: 1.0 - a * u * u))), list_transform(y, lambda v: 0.9 * (1.0 - a * v * v) + 0.1 * list_avg(list_transform(y, lambda u: 1.0 - a * u * u))) FROM w WHERE k < 5)
 SELECT CAST(p AS BIGINT) param_id, round(ln(abs(list_avg(y) - list_avg(x)) / 0.01) / 5, 6) + 0.0 exponent FROM w WHERE k = 5""")
def collective_growth(spark, sf_dir):
    return rounded(lattice.collective_exponent(simulate.grid(spark, a=[1.5, 1.7], eps=[0.1]), 10, 5, 0, every=5, delta=0.01, seed=None))


@query()
def lyapunov_density(spark, sf_dir):
    return rounded(lattice.lyapunov_density(simulate.grid(spark, a=[1.5, 1.85], eps=[0.3]), 40, [5, 10, 20, 40], 200, 100))


@query(f"""RECURSIVE w(n, k, x, v, total) AS (SELECT n, 0, list_transform(range(1, 9), lambda i: -0.5 + (i * {GOLDEN} - floor(i * {GOLDEN}))), list_transform(range(1, 9), lambda i: CASE WHEN i <= n THEN cos(i) ELSE 0 END), CAST(0 AS DOUBLE) FROM (SELECT unnest([3, 8]) n) UNION ALL
 SELECT n, k + 1, list_transform(range(1, 9), lambda i: (1 - 1.7 * x[i] * x[i]) + 0.15 * ((1 - 1.7 * pow(x[(i + 6) % 8 + 1], 2)) + (1 - 1.7 * pow(x[i % 8 + 1], 2)) - 2 * (1 - 1.7 * x[i] * x[i]))),
  list_transform(u, lambda q: q / sqrt(list_sum(list_transform(u, lambda z: z * z)))), total + ln(sqrt(list_sum(list_transform(u, lambda z: z * z)))) FROM
  (SELECT *, list_transform(range(1, 9), lambda i: CASE WHEN i <= n THEN 0.7 * (-3.4 * x[i] * v[i]) + 0.15 * (-3.4 * x[(i + 6) % 8 + 1] * v[(i + 6) % 8 + 1] - 3.4 * x[i % 8 + 1] * v[i % 8 + 1]) ELSE 0 END) u FROM w WHERE k < 15))
 SELECT CAST(n AS INT) size, round(total / 15 / n, 6) + 0.0 density FROM w WHERE k = 15""")
def lyapunov_density_small(spark, sf_dir):
    return rounded(lattice.lyapunov_density(simulate.grid(spark, a=[1.7], eps=[0.3]), 8, [3, 8], 15, 0, seed=None).select("size", "density"))


LATTICE_RUNS = """rn AS (SELECT run_id, t, lo, hi, n, count(*) FILTER (WHERE lo = 0 OR hi = m - 1) OVER (PARTITION BY run_id, t) e, m FROM
  (SELECT run_id, t, min(site) lo, max(site) hi, count(*) n, any_value(m) m FROM (SELECT *, site - row_number() OVER (PARTITION BY run_id, t ORDER BY site) g FROM (SELECT *, count(*) OVER (PARTITION BY run_id, t) m FROM bm) WHERE on_) GROUP BY run_id, t, g)),
 ln AS (SELECT run_id, t, n length FROM rn WHERE e < 2 OR NOT (lo = 0 OR hi = m - 1) UNION ALL SELECT run_id, t, sum(n) FROM rn WHERE e = 2 AND (lo = 0 OR hi = m - 1) GROUP BY 1, 2)"""


@query(f"{RING}, bm AS (SELECT a.run_id, a.t, a.site, abs(a.x - b.x) > 0.1 on_ FROM st a JOIN st b ON b.t = a.t AND b.site = (a.site + 1) % 64), {LATTICE_RUNS} SELECT run_id, t, CAST(length AS BIGINT) length FROM ln")
def lattice_runs(spark, sf_dir):
    return lattice.periodic_runs(lattice.burst_mask(ring(spark, sf_dir), 0.1))


@query(f"""{RING}, bs AS (SELECT a.run_id, a.t, a.site, abs(a.x - b.x) > 0.1 b FROM st a JOIN st b ON b.t = a.t AND b.site = (a.site + 1) % 64), bm AS (SELECT run_id, t, site, NOT b on_ FROM bs), {LATTICE_RUNS},
 pm AS (SELECT run_id, length, count(*) / sum(count(*)) OVER (PARTITION BY run_id) p FROM ln GROUP BY 1, 2), dk AS (SELECT run_id, -regr_slope(ln(p), length) decay FROM pm WHERE length >= 2 GROUP BY 1)
 SELECT run_id, round(avg(b::INT), 6) turbulent, round(any_value(decay), 6) decay FROM bs LEFT JOIN dk USING (run_id) GROUP BY 1""")
def turbulence(spark, sf_dir):
    return rounded(lattice.turbulence(ring(spark, sf_dir), 0.1))


BASIN = """RECURSIVE w(p, k, x, y) AS (SELECT i, 0, CAST(-0.5 + 0.25 * (i // 5) AS DOUBLE), CAST(-0.5 + 0.25 * (i % 5) AS DOUBLE) FROM range(25) r(i) UNION ALL
 SELECT p, k + 1, (1.0 - 1.35344 * x * x) + 0.1 * (y - x), (1.0 - 1.35344 * y * y) + 0.1 * (x - y) FROM w WHERE k < 40 AND abs(x) < 1e100 AND abs(y) < 1e100)"""


@query(f"""{BASIN}, e AS (SELECT * FROM w WHERE k = 40), n AS (SELECT p, x, y, least(pow(x - 0.2, 2) + pow(y - 0.6, 2), pow(x - 0.5, 2) + pow(y - 0.1, 2)) a, least(pow(x - 0.6, 2) + pow(y - 0.2, 2), pow(x - 0.1, 2) + pow(y - 0.5, 2)) b FROM e)
 SELECT CAST(i AS BIGINT) param_id, CAST(CASE WHEN x IS NULL OR abs(x) >= 1e10 THEN -1 WHEN abs(x - y) < 1e-12 THEN 0 WHEN a <= b THEN 1 ELSE 2 END AS INT) label FROM range(25) r(i) LEFT JOIN n ON p = i""")
def basin_grid(spark, sf_dir):
    params = simulate.grid(spark, A=[1.35344], D=[0.1], x=[-0.5 + 0.25 * k for k in range(5)], y=[-0.5 + 0.25 * k for k in range(5)])
    return lattice.basin(params, 40, [(0.2, 0.6), (0.5, 0.1)])


@query("""RECURSIVE w(k, x, y) AS (SELECT 0, CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE) UNION ALL SELECT k + 1, (1.0 - 1.2 * x * x) + 0.1 * (y - x), (1.0 - 1.2 * y * y) + 0.1 * (x - y) FROM w WHERE k < 208)
 SELECT CAST(0 AS BIGINT) param_id, CAST(k - 201 AS BIGINT) t, round(x, 6) p0, round(y, 6) p1 FROM w WHERE k > 200""")
def reference_orbit(spark, sf_dir):
    params = one(spark).withColumns({"A": F.lit(1.2), "D": F.lit(0.1), "x0": F.lit(0.1), "x1": F.lit(0.3)})
    return rounded(lattice.reference_orbit(params, 200, 8))


CORRELATION_LENGTH = f"""{{of}}, m AS (SELECT avg(x) m FROM st), c AS (SELECT t, site, x - m c FROM st, m), v AS (SELECT lag, avg(a.c * b.c) v FROM c a JOIN c b ON a.t = b.t, range(0, 11) r(lag) WHERE b.site = (a.site + lag) % {{n}} GROUP BY 1),
 ac AS (SELECT lag, v / max(v) FILTER (WHERE lag = 0) OVER () c FROM v), b AS (SELECT *, lag(c) OVER (ORDER BY lag) b FROM ac), cr AS (SELECT arg_min(lag - 1 + (b - exp(-1)) / (b - c), lag) x FROM b WHERE c <= exp(-1) AND b > exp(-1))
 SELECT 0::{{kind}} run_id, round(any_value(x), 5) crossing, round(-1 / regr_slope(ln(c), lag), 5) decay FROM ac, cr WHERE c > 0 AND lag <= coalesce(x, lag) + 1"""


@query(CORRELATION_LENGTH.format(of=f"{lattice_sql('SELECT 0 p, CAST(1.72 AS DOUBLE) a, CAST(0.4 AS DOUBLE) eps', 64, 20, LOGISTIC)}, st AS (SELECT k t, i - 1 site, x[i] x FROM w, range(1, 65) r(i) WHERE k > 10)", n=64, kind="BIGINT"))
def correlation_length(spark, sf_dir):
    runs = lattice.simulate(simulate.grid(spark, a=[1.72], eps=[0.4]), 64, 10, 10, seed=None)
    return rounded(sweeps.correlation_length(lattice.spatial_autocorrelation(runs, 10)), 5)


# --- sections -----------------------------------------------------------------------------------------------------------------------

SECTION = f"""{SIG}, mn AS (SELECT series_id, avg(x) m, count(*) n FROM sig GROUP BY 1 HAVING count(*) >= 3), g1 AS (SELECT series_id, t, x, x - 60 s, n, coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w) * 2 * pi() d1 FROM sig JOIN mn USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 g2 AS (SELECT *, coalesce((lead(d1) OVER w - lag(d1) OVER w) / 2, lead(d1) OVER w - d1, d1 - lag(d1) OVER w) * 2 * pi() d2 FROM g1 WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 g3 AS (SELECT *, lead(s) OVER w s1, lead(x) OVER w x1, lead(d1) OVER w e1, lead(d2) OVER w e2, lag(x, 2) OVER w past, lead(x, 2) OVER w future FROM g2 WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 cx AS (SELECT series_id, t, n, -s / (s1 - s) a, x, x1, d1, e1, d2, e2, past, future FROM g3 WHERE (s <= 1e-12 AND s1 > 1e-12 OR s >= -1e-12 AND s1 < -1e-12) AND abs(s1 - s) > 1e-12)"""


@query(f"""{SECTION} SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY (t + a) / (2 * pi())) - 1 AS k, round((t + a) / (2 * pi()), 6) AS "time", round(x + a * (x1 - x), 6) AS "value", round(d1 + a * (e1 - d1), 6) + 0.0 d1, round(d2 + a * (e2 - d2), 6) + 0.0 d2,
 CASE WHEN t >= 2 AND t + 2 < n THEN past END past, CASE WHEN t >= 2 AND t + 2 < n THEN future END future FROM cx""")
def section_planes(spark, sf_dir):
    return rounded(sections.section(src.events_by_user(spark, sf_dir), 2 * pi, delay=2, level=60.0, direction="both"))


SPECTRUM = f"""{SIG}, ms AS (SELECT series_id, t, x - avg(x) OVER s c, count(*) OVER s n FROM sig WINDOW s AS (PARTITION BY series_id)),
 pw AS (SELECT series_id, n, k, pow(sum(c * cos(2 * pi() * ((k * t) % n) / n)), 2) + pow(sum(c * sin(2 * pi() * ((k * t) % n) / n)), 2) power FROM ms, range(1, 200) r(k) WHERE 2 * k <= n GROUP BY 1, 2, 3)"""


@query(f"{SPECTRUM} SELECT series_id, CAST(greatest(round_even(any_value(n) / arg_max(k, CASE WHEN 2 * k = n THEN power / 2 ELSE power END), 0), 1) AS BIGINT) period FROM pw GROUP BY 1")
def dominant_period(spark, sf_dir):
    return sections.dominant_period(src.events_by_user(spark, sf_dir))


@query(f"""{SPECTRUM}, rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY power DESC, k) r FROM pw), sr AS (SELECT series_id, sqrt(max(power) FILTER (WHERE r = 1) / max(power) FILTER (WHERE r = 2)) ratio FROM rk GROUP BY 1),
 {SECTION.split(", mn AS", 1)[1].join(["mn AS", ""])}, tm AS (SELECT series_id, (t + a) / (2 * pi()) tt, (t + a) / (2 * pi()) - lag((t + a) / (2 * pi())) OVER (PARTITION BY series_id ORDER BY t) gap FROM cx),
 qs AS (SELECT series_id, count(*) n, avg(gap) m, stddev_pop(gap) / avg(gap) cv FROM tm GROUP BY 1), al AS (SELECT i.series_id, coalesce(n, 0) n, m, cv, ratio FROM (SELECT DISTINCT series_id FROM sig) i LEFT JOIN qs USING (series_id) LEFT JOIN sr USING (series_id))
 SELECT series_id, n, CASE WHEN n >= 3 THEN round(m, 6) END mean_period, CASE WHEN n >= 3 THEN round(cv, 6) END cv, CASE WHEN n >= 3 THEN round(ratio, 6) END ratio,
 CASE WHEN n < 3 THEN 'insufficient_data' WHEN cv < 0.05 AND ratio >= 5 THEN 'highly_periodic' WHEN cv < 0.2 AND ratio >= 3 THEN 'periodic' WHEN cv < 0.6 AND ratio >= 1.5 THEN 'quasi_periodic' ELSE 'chaotic' END AS "label" FROM al""")
def section_quality(spark, sf_dir):
    signals = src.events_by_user(spark, sf_dir)
    return rounded(sections.section_quality(sections.section(signals, 2 * pi, delay=2, level=60.0, direction="both"), signals))


@query(f"""{SIG}, m AS (SELECT series_id, t, x - avg(x) OVER (PARTITION BY series_id) c, count(*) OVER (PARTITION BY series_id) n FROM sig), a AS (SELECT a.series_id, a.n, b.t - a.t lag, round(sum(a.c * b.c), 6) s FROM m a JOIN m b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 0 AND 65 GROUP BY 1, 2, 3),
 l AS (SELECT *, lag(s) OVER w p, lead(s) OVER w q FROM a WINDOW w AS (PARTITION BY series_id ORDER BY lag)) SELECT series_id, CAST(coalesce(min(lag) FILTER (WHERE s < p AND s < q AND lag < greatest(n // 4, 3) - 1 AND n >= 4), CASE WHEN any_value(n) < 4 THEN 1 ELSE greatest(any_value(n) // 10, 1) END) AS BIGINT) "delay" FROM l GROUP BY 1""")
def auto_delay(spark, sf_dir):
    return sections.auto_delay(src.events_by_user(spark, sf_dir))


# --- intermittency ------------------------------------------------------------------------------------------------------------------


def histogram_sql(of: str, key: str, value: str) -> str:
    return f"""hs AS (SELECT {key}, count(*) n, min({value})::DOUBLE lo, max({value})::DOUBLE hi, quantile_cont({value}::DOUBLE, 0.25) q1, quantile_cont({value}::DOUBLE, 0.75) q3 FROM {of} GROUP BY 1),
 hb AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE least(greatest(CASE WHEN q3 > q1 THEN ceil((hi - lo) / (2 * (q3 - q1) / cbrt(n))) ELSE ceil(sqrt(n)) END, 1), 512) END nb, CASE WHEN hi > lo THEN lo ELSE lo - CASE WHEN lo <> 0 THEN abs(lo) / 2 ELSE 0.5 END END f, CASE WHEN hi > lo THEN hi ELSE hi + CASE WHEN lo <> 0 THEN abs(lo) / 2 ELSE 0.5 END END g FROM hs),
 hc AS (SELECT {key}, least(floor(({value} - f) / (g - f) * nb), nb - 1) bin, count(*) c FROM {of} JOIN hb USING ({key}) GROUP BY 1, 2)
 SELECT {key}, CAST(r.b AS INT) bin, round(f + (g - f) * r.b / nb, 6) lo, round(f + (g - f) * (r.b + 1) / nb, 6) hi, round(coalesce(c, 0) / n, 6) mass FROM hb JOIN range(0, 512) r(b) ON r.b < nb LEFT JOIN hc USING ({key}) WHERE coalesce(hc.bin, r.b) = r.b"""


def _histogram(of: str, key: str, value: str) -> str:
    return histogram_sql(of, key, value).replace(f"LEFT JOIN hc USING ({key}) WHERE coalesce(hc.bin, r.b) = r.b", f"LEFT JOIN hc ON hc.{key} = hb.{key} AND hc.bin = r.b").replace(f"SELECT {key}, CAST(r.b AS INT)", f"SELECT hb.{key}, CAST(r.b AS INT)")


@query(f"{PERIOD}, ll AS (SELECT series_id, length FROM rn WHERE laminar), {_histogram('ll', 'series_id', 'length')}")
def laminar_histogram(spark, sf_dir):
    return rounded(intermittency.binned_distribution(intermittency.run_lengths(period_mask(spark, sf_dir)), "length"))


@query(f"o AS (SELECT o_orderpriority run_id, o_totalprice AS value FROM orders WHERE o_totalprice > 0), {_histogram('o', 'run_id', 'value')}")
def order_value_histogram(spark, sf_dir):
    return rounded(intermittency.binned_distribution(order_values(spark, sf_dir), "value", "run_id"))


@query(f"{PERIOD}, pl AS (SELECT 'pool' series_id, length FROM rn WHERE laminar) SELECT series_id, length, count(*) n, round(count(*) / sum(count(*)) OVER (), 6) p FROM pl GROUP BY 1, 2")
def pooled_laminar_distribution(spark, sf_dir):
    lengths = intermittency.pooled_lengths(intermittency.run_lengths(period_mask(spark, sf_dir)))
    return rounded(intermittency.length_distribution(lengths))


def order_sizes(spark, sf_dir) -> DataFrame:
    """Lines an order, and quantities, as integer observations by line status."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_returnflag").alias("run_id"), F.col("l_quantity").alias("value"))


ZETA = "(list_sum(list_transform(range(0, 24), lambda j: pow({q} + j, -{a}))) + pow({q} + 24, 1 - {a}) / ({a} - 1) + 0.5 * pow({q} + 24, -{a}) + {a} * pow({q} + 24, -{a} - 1) / 12 - {a} * ({a} + 1) * ({a} + 2) * pow({q} + 24, -{a} - 3) / 720)"


@query(f"""RECURSIVE o AS (SELECT l_returnflag run_id, l_quantity AS value FROM lineitem), d AS (SELECT run_id, value, count(*) c FROM o GROUP BY 1, 2),
 tl AS (SELECT run_id, value, c, sum(c) OVER w n, sum(c * ln(value)) OVER w / sum(c) OVER w m FROM d WINDOW w AS (PARTITION BY run_id ORDER BY value DESC)),
 gs(run_id, x, n, m, i, lo, hi) AS (SELECT run_id, value, n, m, 0, CAST(1.0001 AS DOUBLE), CAST(20 AS DOUBLE) FROM tl WHERE n >= 10 AND m - ln(value) > 1e-12 UNION ALL
  SELECT run_id, x, n, m, i + 1, CASE WHEN fa < fb THEN lo ELSE a END, CASE WHEN fa < fb THEN b ELSE hi END FROM
   (SELECT *, a * m + ln({ZETA.format(q="x", a="a")}) fa, b * m + ln({ZETA.format(q="x", a="b")}) fb FROM (SELECT *, hi - {GOLDEN} * (hi - lo) a, lo + {GOLDEN} * (hi - lo) b FROM gs WHERE i < 60))),
 ft AS (SELECT run_id, x, n, (lo + hi) / 2 alpha FROM gs WHERE i = 60),
 kk AS (SELECT ft.run_id, x, alpha, ft.n, max(abs((ft.n - tl.n + c) / ft.n - (1 - {ZETA.format(q="(tl.value + 1)", a="alpha")} / {ZETA.format(q="x", a="alpha")}))) ks FROM ft JOIN tl ON tl.run_id = ft.run_id AND tl.value >= x GROUP BY 1, 2, 3, 4)
 SELECT run_id, x x_min, round(alpha, 4) alpha, round(ks, 4) ks, CAST(n AS BIGINT) n_tail FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ks, x) r FROM kk) WHERE r = 1""")
def power_law_fit_discrete(spark, sf_dir):
    return rounded(intermittency.fit_power_law_discrete(order_sizes(spark, sf_dir)), 4)


@query()
def power_law_vs_exponential_discrete(spark, sf_dir):
    return rounded(intermittency.compare_power_law_exponential(order_sizes(spark, sf_dir), discrete=True))


@query()
def power_law_bootstrap_discrete(spark, sf_dir):
    lengths = intermittency.pooled_lengths(intermittency.run_lengths(period_mask(spark, sf_dir)))
    return rounded(intermittency.power_law_bootstrap(lengths.select(F.col("series_id").alias("run_id"), F.col("length").cast("double").alias("value")), 10, discrete=True))


@query(f"""{PEAKS}, hl AS (SELECT p.series_id, p.t, p.x, max(s.t) b FROM pk p LEFT JOIN sig s ON s.series_id = p.series_id AND s.t < p.t AND s.x > p.x GROUP BY 1, 2, 3), hr AS (SELECT p.series_id, p.t, min(s.t) e FROM pk p LEFT JOIN sig s ON s.series_id = p.series_id AND s.t > p.t AND s.x > p.x GROUP BY 1, 2),
 pr AS (SELECT hl.series_id, hl.t, hl.x, hl.x - greatest(min(s.x) FILTER (WHERE s.t <= hl.t), min(s.x) FILTER (WHERE s.t >= hl.t)) prom FROM hl JOIN hr USING (series_id, t) JOIN sig s ON s.series_id = hl.series_id AND s.t > coalesce(b, -1) AND s.t < coalesce(e, 1000000000) GROUP BY 1, 2, 3)
 SELECT series_id, CAST(t AS BIGINT) t, x, round(prom, 6) prominence FROM pr WHERE prom >= 50""")
def prominent_extrema(spark, sf_dir):
    return rounded(intermittency.spaced_extrema(src.events_by_user(spark, sf_dir), prominence=50.0))


@query()
def spaced_extrema(spark, sf_dir):
    return rounded(intermittency.spaced_extrema(src.events_by_user(spark, sf_dir), distance=4))


@query()
def intermittency_summary(spark, sf_dir):
    return rounded(intermittency.summary(src.events_by_user(spark, sf_dir), period_mask(spark, sf_dir), 3))


@query()
def return_map_reconstruction(spark, sf_dir):
    signals = src.events_by_user(spark, sf_dir)
    quality = sections.section_quality(sections.section(signals), signals)
    channel = intermittency.tangent_channel(intermittency.extrema_return_map(signals), 10)
    return rounded(quality.select("series_id", F.col("n").alias("crossings"), "label").join(channel, "series_id", "left"))
