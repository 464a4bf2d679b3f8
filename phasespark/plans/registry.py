"""Named queries over the driver's tables, with the DuckDB SQL that must give the same rows.

Real results are rounded to six places on both sides, so that the order of a sum doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasespark.operators import chaos, correlation, entropy, intermittency, lattice, multifractal, ordinal, recurrence, sections, sweeps
from phasespark.operators.embedding import average_mutual_information, cao, embed, false_nearest_neighbors, optimal_delay, optimal_dimension, select_dimension_cao
from phasespark.sources import signals as src
from phasespark.sources import simulate
from phasespark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "rqa_events_by_user"
HEADLINE = ["permutation_entropy", "sample_entropy", "rqa_events_by_user", "correlation_integral", "average_mutual_information", "multifractal_spectrum", "laminar_period", "power_law_fit"]

SIG = """sig AS (SELECT CAST(user_id AS VARCHAR) series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x
  FROM events WHERE value IS NOT NULL)"""
ORD = """ord AS (SELECT CAST(o_custkey AS VARCHAR) series_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t,
  o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL)"""
DAY = """days AS (SELECT CAST(l_shipdate AS DATE) AS dt, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) v FROM lineitem GROUP BY 1),
  day AS (SELECT '0' series_id, row_number() OVER (ORDER BY dt) - 1 AS t, v AS x FROM days)"""
LOG = """RECURSIVE walk(param_id, a, k, x) AS (SELECT k, 1.5 + 0.05 * k, 0, CAST(0.1 AS DOUBLE) FROM range(10) r(k)
  UNION ALL SELECT param_id, a, k + 1, 1.0 - a * x * x FROM walk WHERE k < {n})"""


def emb(d: int, tau: int = 1, of: str = "sig") -> str:
    """SQL of delay vectors ``pts``."""
    cols = ", ".join(f"lead(x, {j * tau}) OVER w AS p{j}" for j in range(d))
    return f"pts AS (SELECT * FROM (SELECT series_id, t, {cols} FROM {of} WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE p{d - 1} IS NOT NULL)"


def cheb(d: int) -> str:
    return "greatest(" + ", ".join(f"abs(a.p{j} - b.p{j})" for j in range(d)) + ")" if d > 1 else "abs(a.p0 - b.p0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {sql}" if not sql.lstrip().startswith(("SELECT", "WITH")) else sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Real columns rounded; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- sources and embedding --------------------------------------------------------------------------------------------------------


@query(f"{SIG} SELECT series_id, t, x FROM sig")
def signals_events_by_user(spark, sf_dir):
    return src.events_by_user(spark, sf_dir)


@query(f"{DAY} SELECT series_id, t, x FROM day")
def signals_daily_revenue(spark, sf_dir):
    return src.daily_revenue(spark, sf_dir)


@query(f"{SIG}, {emb(3, 2)} SELECT * FROM pts")
def delay_embedding(spark, sf_dir):
    return embed(src.events_by_user(spark, sf_dir), 3, 2)


AMI = f"""{SIG}, b AS (SELECT series_id, t, count(*) OVER s n, min(x) OVER s lo, max(x) OVER s hi, x FROM sig WINDOW s AS (PARTITION BY series_id)),
 c AS (SELECT series_id, t, CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi + 1e-10 * (hi - lo)) - lo) * 8), 7) ELSE 0 END AS b FROM b),
 j AS (SELECT c.series_id, d.t - c.t tau, c.b b, d.b e, count(*) c FROM c JOIN c d ON c.series_id = d.series_id AND d.t - c.t BETWEEN 1 AND 6 GROUP BY ALL),
 m AS (SELECT *, sum(c) OVER (PARTITION BY series_id, tau) n, sum(c) OVER (PARTITION BY series_id, tau, b) u, sum(c) OVER (PARTITION BY series_id, tau, e) v FROM j),
 g AS (SELECT DISTINCT series_id, tau FROM sig, range(1, 7) r(tau)),
 ami AS (SELECT g.series_id, CAST(g.tau AS INT) tau, greatest(coalesce(sum(c / n * ln(c * n / (u * v))), 0), 0) ami FROM g LEFT JOIN m USING (series_id, tau) GROUP BY ALL)"""


@query(f"{AMI} SELECT series_id, tau, round(ami, 6) + 0.0 ami FROM ami")
def mutual_information(spark, sf_dir):
    return rounded(average_mutual_information(src.events_by_user(spark, sf_dir), 6, 8))


QUERIES["average_mutual_information"], ORACLE_SQL["average_mutual_information"] = QUERIES.pop("mutual_information"), ORACLE_SQL.pop("mutual_information")


@query(f"""{AMI}, l AS (SELECT series_id, tau, ami, lag(ami) OVER w p, lead(ami) OVER w q FROM (SELECT series_id, tau, round(ami, 9) ami FROM ami) WINDOW w AS (PARTITION BY series_id ORDER BY tau))
 SELECT series_id, coalesce(min(tau) FILTER (WHERE ami < p AND ami <= q), 1) tau FROM l GROUP BY series_id""")
def ami_delay(spark, sf_dir):
    return optimal_delay(rounded(average_mutual_information(src.events_by_user(spark, sf_dir), 6, 8), 9))


def nearest_sql(d: int, metric: str) -> str:
    dist = cheb(d) if metric == "chebyshev" else "sqrt(" + " + ".join(f"(a.p{j} - b.p{j}) * (a.p{j} - b.p{j})" for j in range(d)) + ")"
    e = emb(d + 1, 1, "ord").replace("pts AS", f"pts{d} AS")
    return f"""{e}, nn{d} AS (SELECT * FROM (SELECT a.series_id, a.t, {dist} dist, abs(a.p{d} - b.p{d}) nxt,
      row_number() OVER (PARTITION BY a.series_id, a.t ORDER BY {dist}, b.t) r FROM pts{d} a JOIN pts{d} b ON a.series_id = b.series_id AND a.t <> b.t) WHERE r = 1)"""


CAO = f"""{ORD}, {", ".join(nearest_sql(d, "chebyshev") for d in (1, 2, 3))},
 e AS ({" UNION ALL ".join(f"SELECT series_id, {d} d, avg(CASE WHEN dist > 0 THEN greatest(dist, nxt) / dist ELSE 1 END) e, avg(nxt) s FROM nn{d} GROUP BY 1" for d in (1, 2, 3))}),
 c AS (SELECT series_id, d, lead(e) OVER w / e e1, lead(s) OVER w / nullif(s, 0) e2 FROM e WINDOW w AS (PARTITION BY series_id ORDER BY d)),
 cao AS (SELECT series_id, d, e1, e2 FROM c WHERE d < 3)"""


@query(f"{CAO} SELECT series_id, d, round(e1, 6) + 0.0 e1, round(e2, 6) + 0.0 e2 FROM cao")
def cao_dimension(spark, sf_dir):
    return rounded(cao(src.orders_by_customer(spark, sf_dir), 1, 3))


@query(f"""{CAO}, r AS (SELECT series_id, d, round(e1, 9) e1 FROM cao), st AS (SELECT *, abs(lead(e1) OVER (PARTITION BY series_id ORDER BY d) - e1) st FROM r),
 p AS (SELECT *, count(e1) OVER w n, min(e1) OVER w lo, max(e1) OVER w hi FROM st WINDOW w AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
 SELECT series_id, CAST(greatest(least(coalesce(min(d) FILTER (WHERE n = 2 AND lo >= 0.5 AND hi <= 1.5 AND (hi - lo <= 0.15 OR st <= 0.1)), min(d) FILTER (WHERE e1 >= 0.5),
  min(d) FILTER (WHERE e1 IS NOT NULL AND abs(e1 - 1) = g), max(d) + 1), max(d) + 1), 1) AS INT) dimension
 FROM (SELECT *, min(abs(e1 - 1)) OVER (PARTITION BY series_id) g FROM p) GROUP BY 1""")
def select_dimension(spark, sf_dir):
    e1 = rounded(cao(src.orders_by_customer(spark, sf_dir), 1, 3), 9)
    return select_dimension_cao(e1.select("series_id", "d", "e1"), 0.5, 1.5, 0.1, 2, 1)


@query(f"""{CAO}, r AS (SELECT series_id, d, round(e1, 9) e1 FROM cao) SELECT series_id, CAST(coalesce(min(d) FILTER (WHERE e1 > 0.95), 3) AS INT) dimension FROM r GROUP BY 1""")
def optimal_dimension_legacy(spark, sf_dir):
    return optimal_dimension(src.orders_by_customer(spark, sf_dir), 1, 3, "cao_legacy")


@query(f"""{CAO}, r AS (SELECT series_id, d, round(e1, 9) e1 FROM cao), m AS (SELECT *, min(abs(e1 - 1)) OVER (PARTITION BY series_id) g FROM r WHERE d >= 2),
 f AS (SELECT series_id, coalesce(min(d) FILTER (WHERE e1 >= 0.95), min(d) FILTER (WHERE abs(e1 - 1) = g)) f FROM m GROUP BY 1)
 SELECT series_id, CAST(greatest(least(coalesce(f, l + 1), 3), 2) AS INT) dimension FROM (SELECT series_id, max(d) l FROM r GROUP BY 1) LEFT JOIN f USING (series_id)""")
def optimal_dimension_cao(spark, sf_dir):
    return optimal_dimension(src.orders_by_customer(spark, sf_dir), 1, 3, "cao")


@query(f"""{ORD}, {", ".join(nearest_sql(d, "euclidean") for d in (1, 2))}, sg AS (SELECT series_id, stddev_pop(x) s FROM ord GROUP BY 1),
 u AS ({" UNION ALL ".join(f"SELECT series_id, {d} d, dist, nxt FROM nn{d}" for d in (1, 2))}),
 f AS (SELECT series_id, d, nxt > 15 * dist a, sqrt(dist * dist + nxt * nxt) > 2 * s b FROM u JOIN sg USING (series_id) WHERE dist > 0)
 SELECT series_id, d, round(avg(a::INT), 6) f1, round(avg(b::INT), 6) f2, round(avg((a OR b)::INT), 6) f3 FROM f GROUP BY 1, 2""")
def false_neighbors(spark, sf_dir):
    return rounded(false_nearest_neighbors(src.orders_by_customer(spark, sf_dir), 1, 2))


# --- ordinal patterns and entropies ---------------------------------------------------------------------------------------------------


def lehmer_sql(d: int) -> str:
    """The Lehmer code from the sorted list of (value, index)."""
    from math import factorial

    pts = emb(d)
    arr = "list_sort([" + ", ".join(f"{{'v': p{j}, 'i': {j}}}" for j in range(d)) + "])"
    digits = " + ".join(f"{factorial(d - 1 - r)} * (" + (" + ".join(f"(s[{k + 1}].i < s[{r + 1}].i)::INT" for k in range(r + 1, d)) or "0") + ")" for r in range(d))
    return f"{SIG}, {pts}, srt AS (SELECT series_id, t, {arr} s FROM pts), pat AS (SELECT series_id, t, ({digits})::INT lehmer FROM srt), cnt AS (SELECT series_id, lehmer, count(*) n FROM pat GROUP BY 1, 2), prob AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id) p FROM cnt)"


@query(f"{lehmer_sql(3)} SELECT series_id, t, lehmer FROM pat")
def ordinal_patterns(spark, sf_dir):
    return ordinal.patterns(src.events_by_user(spark, sf_dir), 3)


@query(f"{lehmer_sql(4)} SELECT series_id, t, list_transform(s, lambda e: e.i) AS places FROM srt")
def ordinal_orders(spark, sf_dir):
    found = ordinal.patterns(src.events_by_user(spark, sf_dir), 4)
    return found.select("series_id", "t", ordinal.order_of(F.col("lehmer"), 4).alias("places"))


@query(f"{lehmer_sql(4)} SELECT series_id, lehmer, n, round(p, 6) p FROM prob")
def ordinal_distribution(spark, sf_dir):
    return rounded(ordinal.distribution(src.events_by_user(spark, sf_dir), 4))


@query(f"{lehmer_sql(4)} SELECT series_id, round(-sum(p * ln(p)) / ln(24), 6) + 0.0 entropy FROM prob GROUP BY 1")
def permutation_entropy(spark, sf_dir):
    return rounded(ordinal.permutation_entropy(src.events_by_user(spark, sf_dir), 4))


@query(f"""{lehmer_sql(3)}, q AS (SELECT series_id, k, p FROM (SELECT DISTINCT series_id FROM prob) CROSS JOIN range(6) r(k) LEFT JOIN (SELECT series_id, lehmer k, p FROM prob) USING (series_id, k)),
 z AS (SELECT series_id, coalesce(p, 0) p, 1.0 / 6 u FROM q), s AS (SELECT series_id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) h,
 sum(CASE WHEN p > 0 THEN p * ln(p / ((p + u) / 2)) ELSE 0 END + u * ln(u / ((p + u) / 2))) / 2 js FROM z GROUP BY 1)
 SELECT series_id, round(h / ln(6), 6) + 0.0 entropy, round(js / (-0.5 * (7.0 / 6 * ln(7) - 2 * ln(12) + ln(6))) * h / ln(6), 6) + 0.0 complexity FROM s""")
def complexity_entropy(spark, sf_dir):
    return rounded(ordinal.complexity_entropy(src.events_by_user(spark, sf_dir), 3))


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {lehmer_sql(d)} SELECT series_id, {d} d, round(-sum(p * ln(p)) / ln({f}), 6) + 0.0 entropy FROM prob GROUP BY 1)" for d, f in ((3, 6), (4, 24), (5, 120), (6, 720), (7, 5040))))
def permutation_entropy_sweep(spark, sf_dir):
    return rounded(ordinal.entropy_sweep(src.events_by_user(spark, sf_dir)))


SAMPEN = """CASE WHEN a IS NULL THEN 'Infinity'::DOUBLE WHEN b = 0 THEN 'NaN'::DOUBLE WHEN a = 0 THEN 'Infinity'::DOUBLE ELSE round(-ln(a / b), 6) + 0.0 END"""


@query(f"""{SIG}, {emb(3)}, r AS (SELECT series_id, 0.2 * stddev_samp(x) r FROM sig GROUP BY 1),
 h AS (SELECT a.series_id, count(*) FILTER (WHERE {cheb(3)} < r) a, count(*) FILTER (WHERE {cheb(2)} < r) b FROM pts a JOIN pts b ON a.series_id = b.series_id AND b.t > a.t JOIN r ON r.series_id = a.series_id GROUP BY 1)
 SELECT series_id, {SAMPEN} entropy FROM r LEFT JOIN h USING (series_id)""")
def sample_entropy(spark, sf_dir):
    return rounded(entropy.sample_entropy(src.events_by_user(spark, sf_dir)))


def phi_sql(m: int) -> str:
    return f"""{emb(m).replace("pts AS", f"pt{m} AS")}, c{m} AS (SELECT a.series_id, a.t, count(*) c FROM pt{m} a JOIN pt{m} b ON a.series_id = b.series_id JOIN r ON r.series_id = a.series_id WHERE {cheb(m)} <= r GROUP BY 1, 2),
 f{m} AS (SELECT series_id, avg(ln(c / (n - {m - 1}))) phi FROM c{m} JOIN r USING (series_id) GROUP BY 1)"""


@query(f"""{SIG}, r AS (SELECT series_id, 0.2 * stddev_samp(x) r, count(*) n FROM sig GROUP BY 1), {phi_sql(2)}, {phi_sql(3)}
 SELECT f2.series_id, round(f2.phi - f3.phi, 6) + 0.0 entropy FROM f2 JOIN f3 USING (series_id)""")
def approximate_entropy(spark, sf_dir):
    return rounded(entropy.approximate_entropy(src.events_by_user(spark, sf_dir)))


def fuzzy_sql(m: int) -> str:
    mean = lambda s: "(" + " + ".join(f"{s}.p{j}" for j in range(m)) + f") / {m}"
    gap = "greatest(" + ", ".join(f"abs((a.p{j} - {mean('a')}) - (b.p{j} - {mean('b')}))" for j in range(m)) + ")"
    return f"sum(exp(-pow({gap} / r, 2)))"


@query(f"""{SIG}, {emb(3)}, r AS (SELECT series_id, 0.2 * stddev_samp(x) r FROM sig GROUP BY 1),
 h AS (SELECT a.series_id, {fuzzy_sql(3)} a, {fuzzy_sql(2)} b FROM pts a JOIN pts b ON a.series_id = b.series_id AND b.t > a.t JOIN r ON r.series_id = a.series_id GROUP BY 1)
 SELECT series_id, round(-ln(a / b), 6) + 0.0 entropy FROM h""")
def fuzzy_entropy(spark, sf_dir):
    return rounded(entropy.fuzzy_entropy(src.events_by_user(spark, sf_dir)))


@query(f"""{SIG}, r AS (SELECT series_id, 0.15 * stddev_samp(x) r, count(*) n FROM sig GROUP BY 1),
 cg AS (SELECT series_id, scale, t // scale k, avg(x) x FROM sig JOIN r USING (series_id), range(1, 4) s(scale) WHERE (t // scale + 1) * scale <= n GROUP BY 1, 2, 3),
 pts AS (SELECT * FROM (SELECT series_id, scale, k t, x p0, lead(x, 1) OVER w p1, lead(x, 2) OVER w p2 FROM cg WINDOW w AS (PARTITION BY series_id, scale ORDER BY k)) WHERE p2 IS NOT NULL),
 h AS (SELECT a.series_id, a.scale, count(*) FILTER (WHERE {cheb(3)} < r) a, count(*) FILTER (WHERE {cheb(2)} < r) b FROM pts a JOIN pts b ON a.series_id = b.series_id AND a.scale = b.scale AND b.t > a.t JOIN r ON r.series_id = a.series_id GROUP BY 1, 2),
 i AS (SELECT DISTINCT series_id, scale FROM cg)
 SELECT series_id, CAST(scale AS INT) scale, {SAMPEN} entropy FROM i LEFT JOIN h USING (series_id, scale)""")
def multiscale_entropy(spark, sf_dir):
    return rounded(entropy.multiscale_entropy(src.events_by_user(spark, sf_dir), [1, 2, 3]))


# --- recurrence and correlation -----------------------------------------------------------------------------------------------------

EUC2 = "sqrt((a.p0 - b.p0) * (a.p0 - b.p0) + (a.p1 - b.p1) * (a.p1 - b.p1))"
REC = f"""{SIG}, {emb(2)}, d AS (SELECT a.series_id, a.t i, b.t j, {EUC2} d FROM pts a JOIN pts b ON a.series_id = b.series_id AND b.t > a.t),
 e AS (SELECT series_id, quantile_cont(d, 0.1) eps FROM (SELECT series_id, d FROM d WHERE d > 0 UNION ALL SELECT series_id, d FROM d WHERE d > 0) GROUP BY 1),
 rec AS (SELECT series_id, i, j FROM d JOIN e USING (series_id) WHERE d <= eps),
 dl AS (SELECT series_id, count(*) len FROM (SELECT series_id, j - i k, i - row_number() OVER (PARTITION BY series_id, j - i ORDER BY i) g FROM rec) GROUP BY series_id, k, g HAVING count(*) >= 2),
 fm AS (SELECT series_id, i, j FROM rec UNION ALL SELECT series_id, j, i FROM rec UNION ALL SELECT series_id, t, t FROM pts),
 vl AS (SELECT series_id, count(*) len FROM (SELECT series_id, j, i - row_number() OVER (PARTITION BY series_id, j ORDER BY i) g FROM fm) GROUP BY series_id, j, g HAVING count(*) >= 2)"""


@query(f"{REC} SELECT series_id, i, j FROM rec")
def recurrence_points(spark, sf_dir):
    return recurrence.recurrences(embed(src.events_by_user(spark, sf_dir), 2, 1), percentile=10)


@query(f"""{REC}, n AS (SELECT series_id, count(*) n FROM pts GROUP BY 1), u AS (SELECT series_id, count(*) u FROM rec GROUP BY 1),
 dd AS (SELECT series_id, sum(len) dp, count(*) dn, max(len) lmax FROM dl GROUP BY 1), vv AS (SELECT series_id, sum(len) vp, count(*) vn FROM vl GROUP BY 1),
 h AS (SELECT series_id, -sum(p * ln(p)) entr FROM (SELECT series_id, count(*) / sum(count(*)) OVER (PARTITION BY series_id) p FROM dl GROUP BY series_id, len) GROUP BY 1),
 a AS (SELECT n.series_id, n, coalesce(u, 0) u, coalesce(dp, 0) dp, coalesce(dn, 0) dn, coalesce(lmax, 0) lmax, coalesce(vp, 0) vp, coalesce(vn, 0) vn, coalesce(entr, 0) entr
   FROM n LEFT JOIN u USING (series_id) LEFT JOIN dd USING (series_id) LEFT JOIN vv USING (series_id) LEFT JOIN h USING (series_id))
 SELECT series_id, n, round((2 * u + n) / (n * n), 6) rr, CASE WHEN u > 0 THEN round(dp / u, 6) ELSE 0.0 END det, round(vp / (2 * u + n), 6) lam, CASE WHEN dn > 0 THEN round(dp / dn, 6) ELSE 0.0 END l,
   CASE WHEN vn > 0 THEN round(vp / vn, 6) ELSE 0.0 END tt, round(entr, 6) + 0.0 entr, CAST(lmax AS BIGINT) lmax FROM a""")
def rqa_events_by_user(spark, sf_dir):
    return rounded(recurrence.rqa(embed(src.events_by_user(spark, sf_dir), 2, 1), percentile=10))


@query(f"{REC} SELECT series_id, len AS length, count(*) n FROM dl GROUP BY 1, 2")
def rqa_line_histogram(spark, sf_dir):
    return recurrence.line_histogram(embed(src.events_by_user(spark, sf_dir), 2, 1), percentile=10)


@query(f"{REC} SELECT series_id, len AS length, count(*) n FROM vl GROUP BY 1, 2")
def laminar_lengths(spark, sf_dir):
    return recurrence.laminar_lengths(embed(src.events_by_user(spark, sf_dir), 2, 1), percentile=10)


@query(f"{REC}, ins AS (SELECT series_id, i t FROM fm GROUP BY 1, 2 HAVING count(*) >= 1) SELECT series_id, eps FROM e".replace(", ins AS (SELECT series_id, i t FROM fm GROUP BY 1, 2 HAVING count(*) >= 1)", "").replace("SELECT series_id, eps", "SELECT series_id, round(eps, 6) eps"))
def recurrence_threshold(spark, sf_dir):
    return rounded(recurrence.thresholds(embed(src.events_by_user(spark, sf_dir), 2, 1), 10))


RADII = [5.0, 10.0, 20.0, 40.0, 80.0, 160.0]


@query(f"""{SIG}, {emb(3)}, n AS (SELECT series_id, count(*) n FROM pts GROUP BY 1), d AS (SELECT a.series_id, {cheb(3)} d FROM pts a JOIN pts b ON a.series_id = b.series_id AND b.t > a.t + 1),
 g AS (SELECT series_id, n, k, r FROM n, (SELECT unnest(range(0, {len(RADII)})) k, unnest({RADII}) r))
 SELECT g.series_id, CAST(k AS INT) k, r, round(count(d) FILTER (WHERE d < r) / any_value(greatest(n - 2, 0) * (greatest(n - 2, 0) + 1) / 2), 6) c FROM g LEFT JOIN d USING (series_id) GROUP BY 1, 2, 3""")
def correlation_integral(spark, sf_dir):
    return rounded(correlation.correlation_integral(embed(src.events_by_user(spark, sf_dir), 3, 1), RADII, theiler=1))


def flattest_sql(rows: str, value: str, width: str, name: str) -> str:
    """The flattest run of ``width`` rows of ``rows`` (series_id, u, m, value)."""
    return f"""{name}_w AS (SELECT DISTINCT series_id, u s, m, {width} width FROM {rows}), {name}_s AS (SELECT a.series_id, s, width, stddev_pop({value}) sd, quantile_cont({value}, 0.5) mid
   FROM {name}_w a JOIN {rows} b ON a.series_id = b.series_id AND b.u BETWEEN s AND s + width - 1 WHERE s + width <= a.m GROUP BY 1, 2, 3),
 {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(sd, 12), s) rk FROM {name}_s) WHERE rk = 1)"""


def dimension_sql(pairs: str, n_r: int) -> str:
    """``d2`` and ``dtt`` from CTEs ``pts`` and d (series_id, d): the distances of all pairs."""
    return f"""{pairs}, bx AS (SELECT series_id, count(*) n, greatest(max(p0) - min(p0), max(p1) - min(p1)) hi FROM pts GROUP BY 1 HAVING count(*) > 1 AND hi > 0),
 rd AS (SELECT series_id, n, k, CASE WHEN k = {n_r - 1} THEN hi ELSE exp(ln(hi / n) + (ln(hi) - ln(hi / n)) * k / {n_r - 1}.0) END r FROM bx, range({n_r}) g(k)),
 cv AS (SELECT rd.series_id, k, r, count(d) / (n * (n - 1) / 2) c, 1 / sqrt(n * (n - 1) / 2) fl FROM rd LEFT JOIN d ON d.series_id = rd.series_id AND d < r GROUP BY rd.series_id, k, r, n),
 lg AS (SELECT series_id, k, ln(r) x, ln(c) y, count(*) OVER (PARTITION BY series_id) n FROM cv WHERE c > fl),
 sl AS (SELECT *, (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) slope FROM lg WHERE n >= 3 WINDOW w AS (PARTITION BY series_id ORDER BY k)),
 sp AS (SELECT *, (max(x) OVER p - min(x) OVER p) / (n - 1) sp FROM sl WINDOW p AS (PARTITION BY series_id)),
 us AS (SELECT *, sum((slope >= sp)::INT) OVER (PARTITION BY series_id) good FROM sp),
 tk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY k) - 1 u, count(*) OVER (PARTITION BY series_id) m FROM us WHERE slope >= sp OR good < 3),
 {flattest_sql("tk", "slope", "greatest(m // 4, 3)", "bst")},
 fr AS (SELECT tk.*, s, width, abs(slope - mid) >= greatest(3 * sd, sp) far FROM tk JOIN bst USING (series_id)),
 rg AS (SELECT *, max(u) FILTER (WHERE far AND u < s) OVER (PARTITION BY series_id) lo, min(u) FILTER (WHERE far AND u >= s + width) OVER (PARTITION BY series_id) hi FROM fr),
 d2 AS (SELECT series_id, regr_slope(y, x) d2, sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / regr_sxx(y, x) / nullif(count(*) - 2, 0)) se FROM rg WHERE u > coalesce(lo, -1) AND u < coalesce(hi, m) GROUP BY 1 HAVING count(*) >= 3),
 t0 AS (SELECT series_id, k, r, c, fl, count(*) OVER (PARTITION BY series_id) n, ln(lead(r) OVER w) - ln(r) dx, lead(c) OVER w c1 FROM cv WHERE c > fl WINDOW w AS (PARTITION BY series_id ORDER BY k)),
 t1 AS (SELECT *, (ln(c1) - ln(c)) / dx a FROM t0 WHERE n >= 3),
 t2 AS (SELECT series_id, coalesce(quantile_cont(a, 0.5) FILTER (WHERE a > 0.01 AND c < 0.1), quantile_cont(a, 0.5) FILTER (WHERE a > 0.01), 1) sl, arg_min(c, k) c0 FROM t1 GROUP BY 1),
 t3 AS (SELECT t1.*, c / (c0 / sl + coalesce(sum(CASE WHEN abs(a) > 1e-12 THEN (c1 - c) / a ELSE c * dx END) OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) dd FROM t1 JOIN t2 USING (series_id)),
 t4 AS (SELECT *, sum((c > 5 * fl AND c < 0.1)::INT) OVER (PARTITION BY series_id) >= 4 enough FROM t3),
 t5 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY k) - 1 u, count(*) OVER (PARTITION BY series_id) m FROM t4 WHERE CASE WHEN enough THEN c > 5 * fl AND c < 0.1 ELSE c > 2 * fl AND c < 0.3 END),
 t6 AS (SELECT * FROM t5 WHERE m >= 3), {flattest_sql("t6", "dd", "least(m, greatest(m // 2, 4))", "dtt")}"""


@query(f"""{dimension_sql(f"{SIG}, {emb(2)}, d AS (SELECT a.series_id, {cheb(2)} d FROM pts a JOIN pts b ON a.series_id = b.series_id AND b.t > a.t)", 30)}
 SELECT i.series_id, round(d2, 6) + 0.0 d2, round(CASE WHEN d2 IS NULL THEN NULL ELSE coalesce(se, 0) END, 6) + 0.0 stderr, round(mid, 6) + 0.0 d_tt FROM (SELECT DISTINCT series_id FROM pts) i LEFT JOIN d2 USING (series_id) LEFT JOIN dtt USING (series_id)""")
def correlation_dimension(spark, sf_dir):
    return rounded(correlation.correlation_dimension(embed(src.events_by_user(spark, sf_dir), 2, 1), 30))


@query(f"{SIG}, m AS (SELECT series_id, avg(x) m FROM sig GROUP BY 1), c AS (SELECT s.series_id, t, x - m c FROM sig s JOIN m USING (series_id)), l AS (SELECT *, lead(c) OVER (PARTITION BY series_id ORDER BY t) d FROM c) SELECT series_id, coalesce(abs(sum(c * d) / nullif(sum(c * c), 0)) < 0.2, false) map_like FROM l GROUP BY 1")
def map_like(spark, sf_dir):
    return sections.is_map_like(src.events_by_user(spark, sf_dir))


# --- multifractals ------------------------------------------------------------------------------------------------------------------

FIELD = """pp AS (SELECT 0 AS f, l_partkey % 64 y, (l_suppkey * 13 + l_orderkey) % 64 x, l_quantity m FROM lineitem), fld AS (SELECT f field_id, y, x, sum(m) mass FROM pp GROUP BY 1, 2, 3),
 shp AS (SELECT field_id, max(y) + 1 ny, max(x) + 1 nx FROM fld GROUP BY 1),
 bx AS (SELECT field_id, box, y // box v, x // box u, sum(mass) m FROM fld JOIN shp USING (field_id), (SELECT unnest([2, 4, 8, 16]) box) WHERE (y // box + 1) * box <= ny AND (x // box + 1) * box <= nx GROUP BY 1, 2, 3, 4 HAVING sum(mass) > 0),
 pr AS (SELECT field_id, box, m / sum(m) OVER (PARTITION BY field_id, box) p FROM bx),
 mo AS (SELECT field_id, box, q, ln(box) lb, ln(sum(pow(p, q))) lz, sum(pow(p, q) * ln(p)) / sum(pow(p, q)) an, sum(p * ln(p)) sh FROM pr, (SELECT unnest([-2.0, 0.0, 1.0, 2.0, 4.0]::DOUBLE[]) q) GROUP BY 1, 2, 3)"""


def quantity_field(spark, sf_dir) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 64).alias("y"), ((F.col("l_suppkey") * 13 + F.col("l_orderkey")) % 64).alias("x")).agg(F.sum("l_quantity").alias("mass"))
    return cells.select(F.lit(0).alias("field_id"), "y", "x", "mass")


QS = [-2.0, 0.0, 1.0, 2.0, 4.0]


@query(f"{FIELD} SELECT field_id, CAST(box AS INT) box, q, round(lb, 6) ln_scale, round(lz, 6) + 0.0 log_z, round(an, 6) alpha_num, round(q * an - lz, 6) + 0.0 f_num FROM mo")
def multifractal_moments(spark, sf_dir):
    return rounded(multifractal.moments(quantity_field(spark, sf_dir), [2, 4, 8, 16], QS).drop("shannon"))


@query(f"""{FIELD} SELECT field_id, q, round(regr_slope(lz, lb), 6) + 0.0 tau, round(CASE WHEN q = 1 THEN regr_slope(sh, lb) ELSE regr_slope(lz, lb) / nullif(q - 1, 0) END, 6) + 0.0 d_q,
 round(regr_slope(an, lb), 6) alpha, round(regr_slope(q * an - lz, lb), 6) + 0.0 f_alpha, round(coalesce(CASE WHEN q = 1 THEN regr_r2(sh, lb) ELSE regr_r2(lz, lb) END, 1), 6) r2 FROM mo GROUP BY 1, 2""")
def multifractal_spectrum(spark, sf_dir):
    return rounded(multifractal.spectrum(quantity_field(spark, sf_dir), [2, 4, 8, 16], QS))


# --- sections and series operations ---------------------------------------------------------------------------------------------------


@query(f"""{SIG}, m AS (SELECT series_id, t, x, x - avg(x) OVER (PARTITION BY series_id) s FROM sig), l AS (SELECT series_id, t, s, lead(s) OVER w s1, lead(x, 1) OVER w u0, lead(x, 2) OVER w u1, lead(x, 2) OVER w v0, lead(x, 3) OVER w v1 FROM m WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 c AS (SELECT series_id, t + s / (s - s1) AS tt, u0 + s / (s - s1) * (u1 - u0) u, v0 + s / (s - s1) * (v1 - v0) v FROM l WHERE s <= 0 AND s1 > 0)
 SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY tt) - 1 AS k, round(tt, 6) AS "time", round(u, 6) + 0.0 u, round(v, 6) + 0.0 v FROM c""")
def poincare_crossings(spark, sf_dir):
    return rounded(sections.crossings(src.events_by_user(spark, sf_dir)))


@query(f"{SIG}, m AS (SELECT series_id, t, x - avg(x) OVER (PARTITION BY series_id) c FROM sig) SELECT a.series_id, CAST(b.t - a.t AS INT) lag, round(avg(a.c * b.c), 4) + 0.0 acov FROM m a JOIN m b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 0 AND 5 GROUP BY 1, 2")
def autocovariance(spark, sf_dir):
    return rounded(sections.autocovariance(src.events_by_user(spark, sf_dir), 5), 4)


@query(f"""{SIG}, m AS (SELECT series_id, t, x - avg(x) OVER (PARTITION BY series_id) c, count(*) OVER (PARTITION BY series_id) n FROM sig)
 SELECT series_id, CAST(k AS INT) k, round(pow(sum(c * cos(2 * pi() * ((k * t) % n) / n)), 2) + pow(sum(c * sin(2 * pi() * ((k * t) % n) / n)), 2), 3) power FROM m, range(1, 5) r(k) WHERE 2 * k <= n GROUP BY 1, 2""")
def fourier_power(spark, sf_dir):
    return rounded(sections.spectrum(src.events_by_user(spark, sf_dir), 4), 3)


@query(f"{SIG} SELECT series_id, t, x FROM sig WHERE t % 7 = 0")
def decimate_stride(spark, sf_dir):
    return sections.decimate_stride(src.events_by_user(spark, sf_dir), 7)


@query(f"""{SIG}, r AS (SELECT series_id, t, x, row_number() OVER (PARTITION BY series_id, t // 10 ORDER BY x, t) a, row_number() OVER (PARTITION BY series_id, t // 10 ORDER BY x DESC, t) b FROM sig)
 SELECT series_id, t, x FROM r WHERE a = 1 OR b = 1""")
def decimate_min_max(spark, sf_dir):
    return sections.decimate_min_max(src.events_by_user(spark, sf_dir), 10)


@query(f"""{SIG}, g AS (SELECT series_id, t, x > 50 o, t - row_number() OVER (PARTITION BY series_id, x > 50 ORDER BY t) i FROM sig)
 SELECT series_id, t, o AND count(*) OVER (PARTITION BY series_id, o, i) >= 3 AS sustained FROM g""")
def sustained_mask(spark, sf_dir):
    return sections.sustained(src.events_by_user(spark, sf_dir), 50.0, 3)


@query(f"""{SIG}, g AS (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) i FROM sig WHERE abs(x - 60) <= 40), f AS (SELECT series_id, min(t) AS start, count(*) AS length FROM g GROUP BY series_id, i)
 SELECT series_id, start, length FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY length DESC, start) r FROM f) WHERE r = 1""")
def longest_plateau(spark, sf_dir):
    return sections.longest_plateau(src.events_by_user(spark, sf_dir), 60.0, 40.0)


# --- intermittency ------------------------------------------------------------------------------------------------------------------

PERIOD = f"""{SIG}, gp AS (SELECT series_id, t, x, abs(x - lag(x, 3) OVER (PARTITION BY series_id ORDER BY t)) g FROM sig), ep AS (SELECT series_id, quantile_cont(g, 0.4) e FROM gp WHERE g > 0 GROUP BY 1),
 msk AS (SELECT gp.series_id, t, x, coalesce(g <= coalesce(e, 0), false) laminar FROM gp LEFT JOIN ep USING (series_id)),
 isl AS (SELECT series_id, t, laminar, t - row_number() OVER (PARTITION BY series_id, laminar ORDER BY t) i FROM msk), rn AS (SELECT series_id, laminar, min(t) AS start, count(*) AS length FROM isl GROUP BY series_id, laminar, i)"""


def period_mask(spark, sf_dir) -> DataFrame:
    return intermittency.laminar_by_period(src.events_by_user(spark, sf_dir), 3, 40)


@query(f"{PERIOD} SELECT series_id, t, laminar FROM msk")
def laminar_period(spark, sf_dir):
    return period_mask(spark, sf_dir)


@query(f"""{SIG}, s AS (SELECT series_id, t, CASE WHEN count(*) OVER w = 4 THEN stddev_pop(x) OVER w END s FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
 e AS (SELECT series_id, quantile_cont(s, 0.3) e FROM s WHERE s > 0 GROUP BY 1), l AS (SELECT s.series_id, t, coalesce(s <= coalesce(e, 0), false) low FROM s LEFT JOIN e USING (series_id))
 SELECT series_id, t, bool_or(low) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) laminar FROM l""")
def laminar_variance(spark, sf_dir):
    return intermittency.laminar_by_variance(src.events_by_user(spark, sf_dir), 4, 30)


@query(f"""{REC}, vr AS (SELECT series_id, min(i) lo, max(i) hi FROM (SELECT series_id, j, i, i - row_number() OVER (PARTITION BY series_id, j ORDER BY i) g FROM fm) GROUP BY series_id, j, g HAVING count(*) >= 2),
 inn AS (SELECT DISTINCT series_id, unnest(range(lo, hi + 1)) t FROM vr) SELECT p.series_id, p.t, inn.t IS NOT NULL laminar FROM pts p LEFT JOIN inn ON inn.series_id = p.series_id AND inn.t = p.t""")
def laminar_recurrence(spark, sf_dir):
    return intermittency.laminar_by_recurrence(embed(src.events_by_user(spark, sf_dir), 2, 1), percentile=10)


@query(f"{PERIOD} SELECT series_id, start, length FROM rn WHERE laminar")
def laminar_runs(spark, sf_dir):
    return intermittency.run_lengths(period_mask(spark, sf_dir))


@query(f"{PERIOD} SELECT series_id, length, count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY series_id), 6) p FROM rn WHERE laminar GROUP BY 1, 2")
def laminar_distribution(spark, sf_dir):
    return rounded(intermittency.length_distribution(intermittency.run_lengths(period_mask(spark, sf_dir))))


@query(f"""{PERIOD}, l AS (SELECT series_id, length, sum(laminar::INT) a, sum((NOT laminar)::INT) b FROM rn GROUP BY 1, 2),
 c AS (SELECT series_id, sum(a) OVER w / nullif(sum(a) OVER p, 0) fa, sum(b) OVER w / nullif(sum(b) OVER p, 0) fb FROM l WINDOW w AS (PARTITION BY series_id ORDER BY length), p AS (PARTITION BY series_id))
 SELECT series_id, round(max(abs(fa - fb)), 6) ks FROM c GROUP BY 1""")
def laminar_burst_symmetry(spark, sf_dir):
    return rounded(intermittency.laminar_burst_symmetry(period_mask(spark, sf_dir)).select("series_id", "ks"))


@query(f"{PERIOD} SELECT series_id run_id, abs(x) AS value FROM msk WHERE NOT laminar AND x <> 0")
def burst_amplitudes(spark, sf_dir):
    return intermittency.burst_amplitudes(src.events_by_user(spark, sf_dir), period_mask(spark, sf_dir))


@query(f"""{PERIOD}, en AS (SELECT series_id, x FROM (SELECT *, lag(laminar) OVER (PARTITION BY series_id ORDER BY t) b FROM msk) WHERE laminar AND NOT b),
 mm AS (SELECT series_id, x, avg(x) OVER (PARTITION BY series_id ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) m FROM en), f AS (SELECT series_id, count(*) n, regr_slope(m, x) s FROM mm GROUP BY 1)
 SELECT series_id, n, round(s, 6) + 0.0 slope, round((2 * s - 1) / nullif(1 - s, 0), 4) + 0.0 alpha FROM f""")
def reinjection(spark, sf_dir):
    out = intermittency.reinjection(src.events_by_user(spark, sf_dir), period_mask(spark, sf_dir))
    return rounded(out.withColumn("alpha", F.round("alpha", 4)))


ORDERS = "o AS (SELECT o_orderpriority run_id, o_totalprice AS value FROM orders WHERE o_totalprice > 0)"


def order_values(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_totalprice").alias("value")).filter("value > 0")


def account_values(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3).alias("run_id"), F.col("s_acctbal").alias("value")).filter("value > 0")


PLAW = """o AS (SELECT s_nationkey % 3 run_id, s_acctbal AS value FROM supplier WHERE s_acctbal > 0), d AS (SELECT run_id, value, count(*) c FROM o GROUP BY 1, 2),
 tl AS (SELECT run_id, value, c, sum(c) OVER w n, sum(c * ln(value)) OVER w s FROM d WINDOW w AS (PARTITION BY run_id ORDER BY value DESC)),
 cd AS (SELECT run_id, value x_min, n n_tail, 1 + n / (s - n * ln(value)) alpha FROM tl WHERE n >= 10 AND s - n * ln(value) > 1e-12),
 kk AS (SELECT cd.run_id, x_min, n_tail, alpha, max(abs((n_tail - n + c) / n_tail - (1 - pow(value / x_min, 1 - alpha)))) ks FROM cd JOIN tl ON tl.run_id = cd.run_id AND tl.value >= x_min GROUP BY 1, 2, 3, 4),
 ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ks, x_min) r FROM kk) WHERE r = 1)"""


@query(f"{PLAW} SELECT run_id, x_min, round(alpha, 6) alpha, round(ks, 6) ks, CAST(n_tail AS BIGINT) n_tail FROM ft")
def power_law_fit(spark, sf_dir):
    return rounded(intermittency.fit_power_law(account_values(spark, sf_dir)))


@query(f"""{PLAW.replace("SELECT s_nationkey % 3 run_id, s_acctbal AS value FROM supplier WHERE s_acctbal > 0", "SELECT o_orderpriority run_id, o_totalprice AS value FROM orders WHERE o_totalprice > 0")}
 SELECT run_id, x_min, round(alpha, 6) alpha, round(ks, 6) ks, CAST(n_tail AS BIGINT) n_tail FROM ft""")
def power_law_fit_orders(spark, sf_dir):
    prices = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_totalprice").alias("value"))
    return rounded(intermittency.fit_power_law(prices))


@query(f"""{PERIOD}, {PLAW.replace("SELECT s_nationkey % 3 run_id, s_acctbal AS value FROM supplier WHERE s_acctbal > 0", "SELECT series_id run_id, abs(x) AS value FROM msk WHERE NOT laminar AND x <> 0")}
 SELECT run_id, x_min, round(alpha, 6) alpha, round(ks, 6) ks, CAST(n_tail AS BIGINT) n_tail FROM ft""")
def burst_amplitude_fit(spark, sf_dir):
    signals = src.events_by_user(spark, sf_dir)
    return rounded(intermittency.fit_power_law(intermittency.burst_amplitudes(signals, period_mask(spark, sf_dir))))


@query(f"""{PLAW}, tt AS (SELECT o.run_id, value, x_min, alpha, avg(value - x_min) OVER (PARTITION BY o.run_id) sc FROM o JOIN ft ON ft.run_id = o.run_id AND value >= x_min),
 lr AS (SELECT run_id, (ln((alpha - 1) / x_min) - alpha * ln(value / x_min)) - (-ln(sc) - (value - x_min) / sc) r FROM tt) SELECT run_id, round(sum(r) / (sqrt(count(*)) * stddev_samp(r)), 5) z FROM lr GROUP BY 1""")
def power_law_vs_exponential(spark, sf_dir):
    return rounded(intermittency.compare_power_law_exponential(account_values(spark, sf_dir)).select("run_id", "z"), 5)


@query(f"{ORDERS} SELECT run_id, min(value) x_min, round(avg(value) - min(value), 4) scale, count(*) n FROM o GROUP BY 1")
def exponential_fit(spark, sf_dir):
    return rounded(intermittency.fit_exponential(order_values(spark, sf_dir)), 4)


@query()
def power_law_bootstrap(spark, sf_dir):
    return rounded(intermittency.power_law_bootstrap(account_values(spark, sf_dir), n_bootstrap=10))


@query("""p AS (SELECT s_nationkey % 3 run_id, s_acctbal / 1000 e, 1 + s_suppkey % 17 l FROM supplier WHERE s_acctbal > 0),
 f AS (SELECT run_id, regr_slope(ln(l), ln(e)) beta, sum(l / e) / sum(1 / (e * e)) c, regr_slope(l, -ln(e)) s, regr_intercept(l, -ln(e)) b FROM p GROUP BY 1)
 SELECT p.run_id, round(beta, 6) beta, round(c, 6) inverse_coefficient, round(s, 6) log_slope, round(sum(pow(l - c / e, 2)), 3) inverse_residual, round(sum(pow(l - b + s * ln(e), 2)), 3) log_residual FROM p JOIN f USING (run_id) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY p.run_id, beta, c, s"))
def laminar_scaling(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    points = rows.select((F.col("s_nationkey") % 3).alias("run_id"), (F.col("s_acctbal") / 1000).alias("eps"), (1 + F.col("s_suppkey") % 17).cast("double").alias("length"))
    out = rounded(intermittency.mean_laminar_scaling(points))
    return out.withColumns({c: F.round(c, 3) for c in ("inverse_residual", "log_residual")})


PEAKS = f"""{SIG}, v AS (SELECT series_id, t, x, (lag(x) OVER w IS NULL OR lag(x) OVER w <> x)::INT n FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY t)), fl AS (SELECT *, sum(n) OVER (PARTITION BY series_id ORDER BY t) g FROM v),
 pl AS (SELECT series_id, g, min(t) lo, max(t) hi, min(x) x FROM fl GROUP BY 1, 2), nb AS (SELECT *, lag(x) OVER w l, lead(x) OVER w r FROM pl WINDOW w AS (PARTITION BY series_id ORDER BY lo)), pk AS (SELECT series_id, (lo + hi) // 2 t, x FROM nb WHERE x > l AND x > r),
 rm AS (SELECT series_id, row_number() OVER w - 1 AS k, x, lead(x) OVER w y FROM pk WINDOW w AS (PARTITION BY series_id ORDER BY t))"""


@query(f"{PEAKS} SELECT series_id, CAST(t AS BIGINT) t, x FROM pk")
def extrema(spark, sf_dir):
    return intermittency.extrema(src.events_by_user(spark, sf_dir))


@query(f"{PEAKS} SELECT series_id, k, x, y FROM rm WHERE y IS NOT NULL")
def extrema_return_map(spark, sf_dir):
    return intermittency.extrema_return_map(src.events_by_user(spark, sf_dir))


@query(f"""{PEAKS}, g AS (SELECT *, abs(y - x) gap FROM rm WHERE y IS NOT NULL), q AS (SELECT series_id, quantile_cont(gap, 0.2) q FROM g GROUP BY 1), h AS (SELECT g.*, q, row_number() OVER (PARTITION BY g.series_id ORDER BY gap, k) r FROM g JOIN q USING (series_id))
 SELECT series_id, count(*) n, round(regr_slope(y, x), 5) + 0.0 slope, round(regr_intercept(y, x), 4) + 0.0 intercept FROM h WHERE gap <= q OR r <= 3 GROUP BY 1""")
def tangent_channel(spark, sf_dir):
    out = intermittency.tangent_channel(intermittency.extrema_return_map(src.events_by_user(spark, sf_dir)), 20)
    return out.select("series_id", "n", (F.round("slope", 5) + 0.0).alias("slope"), (F.round("intercept", 4) + 0.0).alias("intercept"))


@query(f"{SIG} SELECT * FROM (SELECT series_id, t, x, lead(x, 2) OVER (PARTITION BY series_id ORDER BY t) y FROM sig) WHERE y IS NOT NULL")
def return_map(spark, sf_dir):
    return intermittency.return_map(src.events_by_user(spark, sf_dir), 2)


# --- simulation and sweeps ------------------------------------------------------------------------------------------------------------


def logistic_grid(spark) -> DataFrame:
    return spark.range(10).select(F.col("id").alias("param_id"), (1.5 + 0.05 * F.col("id")).alias("a"))


@query(f"{LOG.format(n=60)} SELECT CAST(param_id AS BIGINT) param_id, CAST(k - 21 AS BIGINT) t, x p0 FROM walk WHERE k > 20")
def bifurcation_logistic(spark, sf_dir):
    return simulate.trajectories(logistic_grid(spark), "logistic", 40, 20)


@query(f"{LOG.format(n=59)} SELECT CAST(param_id AS BIGINT) param_id, round(avg(ln(abs(-2.0 * a * x))), 6) lyapunov FROM walk WHERE k >= 10 GROUP BY 1")
def lyapunov_sweep(spark, sf_dir):
    return rounded(chaos.lyapunov_logistic(logistic_grid(spark), 50, 10))


@query("""RECURSIVE w(param_id, k, x, y) AS (SELECT k, 0, CAST(0.1 AS DOUBLE), CAST(0.2 AS DOUBLE) FROM range(8) r(k) UNION ALL
 SELECT param_id, k + 1, (1.0 - (0.8 + 0.05 * param_id) * x * x) + 0.1 * (y - x), (1.0 - (0.8 + 0.05 * param_id) * y * y) + 0.1 * (x - y) FROM w WHERE k < 40)
 SELECT CAST(param_id AS BIGINT) param_id, round(avg(abs(x - y)), 6) + 0.0 asymmetry FROM w WHERE k > 10 GROUP BY 1""")
def coupled_logistic_phase(spark, sf_dir):
    params = spark.range(8).select(F.col("id").alias("param_id"), (0.8 + 0.05 * F.col("id")).alias("A"), F.lit(0.1).alias("D"))
    return rounded(simulate.trajectories(params, "coupled_logistic", 30, 10).groupBy("param_id").agg(F.avg(F.abs(F.col("p0") - F.col("p1"))).alias("asymmetry")))


@query("""RECURSIVE w(param_id, k, x) AS (SELECT k, 0, CAST(0.1 AS DOUBLE) FROM range(12) r(k) UNION ALL SELECT param_id, k + 1, x + 0.02 * param_id + 0.1 * sin(2 * pi() * x) FROM w WHERE k < 60)
 SELECT CAST(a.param_id AS BIGINT) param_id, round((b.x - a.x) / 50, 6) + 0.0 rho FROM w a JOIN w b USING (param_id) WHERE a.k = 10 AND b.k = 60""")
def rotation_number_sweep(spark, sf_dir):
    params = spark.range(12).select(F.col("id").alias("param_id"), F.lit(0.1).alias("A"), (0.02 * F.col("id")).alias("D"))
    return rounded(chaos.rotation_number(params, 50, 10))


@query("""RECURSIVE w(k, x, y) AS (SELECT 0, CAST(0.1 AS DOUBLE), CAST(0.1 AS DOUBLE) UNION ALL SELECT k + 1, 1.0 - 1.4 * x * x + y, 0.3 * x FROM w WHERE k < 100) SELECT CAST(0 AS BIGINT) param_id, CAST(k - 1 AS BIGINT) t, x p0, y p1 FROM w WHERE k > 0""")
def henon_trajectory(spark, sf_dir):
    return simulate.trajectories(spark.range(1).select(F.col("id").alias("param_id")), "henon", 100)


@query("""RECURSIVE w(k, x, y) AS (SELECT 0, CAST(0.217 AS DOUBLE), CAST(0.01 AS DOUBLE) UNION ALL SELECT k + 1, 4.0 * x * (1.0 - x), 4.0 * 0.499 * (1.0 - 2.0 * x) * y / (1.0 + y * y) FROM w WHERE k < 100) SELECT CAST(0 AS BIGINT) param_id, CAST(k - 1 AS BIGINT) t, x p0, y p1 FROM w WHERE k > 0""")
def on_off_skew_trajectory(spark, sf_dir):
    return simulate.trajectories(spark.range(1).select(F.col("id").alias("param_id")), "on_off_skew", 100)


def _one(spark) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("param_id"))


@query()
def on_off_runs(spark, sf_dir):
    return simulate.on_off(spark.range(4).select(F.col("id").alias("param_id"), F.col("id").alias("seed")), 200)


@query()
def lyapunov_spectrum_delayed(spark, sf_dir):
    return rounded(chaos.lyapunov_spectrum(simulate.grid(spark, D=[1.3, 1.4, 1.5, 1.6]), "delayed_logistic", 400, 100))


@query()
def lyapunov_spectrum_lorenz(spark, sf_dir):
    return rounded(chaos.lyapunov_spectrum(_one(spark), "lorenz", 1500, 300, 5))


@query()
def alignment_indices(spark, sf_dir):
    return rounded(chaos.alignment(_one(spark), "standard", 50, 10))


@query(f"""{SIG}, w AS (SELECT series_id, t, sum(x * cos((t + 1) * 1.1)) OVER s p, sum(x * sin((t + 1) * 1.1)) OVER s q FROM sig WINDOW s AS (PARTITION BY series_id ORDER BY t)),
 c AS (SELECT series_id, t, p - avg(p) OVER s p, q - avg(q) OVER s q FROM w WINDOW s AS (PARTITION BY series_id)), a AS (SELECT a.series_id, b.t - a.t lag, avg(a.p * b.p + a.q * b.q) v FROM c a JOIN c b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 0 AND 5 GROUP BY 1, 2),
 d AS (SELECT series_id, lag, 2 * (max(v) FILTER (WHERE lag = 0) OVER (PARTITION BY series_id) - v) d FROM a) SELECT series_id, CAST(1.1 AS DOUBLE) c, round(corr(lag, d), 5) + 0.0 k FROM d GROUP BY 1""")
def zero_one_series(spark, sf_dir):
    return rounded(chaos.zero_one(src.events_by_user(spark, sf_dir), [1.1], 6), 5)


def ring(spark, sf_dir) -> DataFrame:
    """Embedding vectors as lattice states: one run, a vector as the sites of a time."""
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("run_id"), F.col("vec_id").alias("t"), F.posexplode("embedding").alias("site", "v"))
    return rows.select("run_id", "t", "site", F.col("v").cast("double").alias("x"))


RING = "st AS (SELECT 0 run_id, vec_id t, CAST(i AS INT) site, CAST(embedding[i + 1] AS DOUBLE) x FROM embeddings, range(0, 64) r(i))"


@query("""f AS (SELECT vec_id, i, 1.0 - 1.7 * pow(CAST(embedding[i + 1] AS DOUBLE), 2) f, 1.0 - 1.7 * pow(CAST(embedding[(i + 63) % 64 + 1] AS DOUBLE), 2) l,
 1.0 - 1.7 * pow(CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE), 2) r FROM embeddings, range(0, 64) r(i)) SELECT 0 run_id, vec_id + 1 t, CAST(i AS INT) site, round(f + 0.2 * (l + r - 2 * f), 6) + 0.0 x FROM f""")
def cml_step(spark, sf_dir):
    f = lambda x: lattice.model_c(x, 1.7)
    return rounded(lattice.cml_step(ring(spark, sf_dir), f, f, 0.4))


@query(f"{RING}, f AS (SELECT *, 1.0 - 1.7 * x * x f FROM st) SELECT run_id, t + 1 t, site, round(0.8 * f + 0.2 * avg(f) OVER (PARTITION BY t), 6) + 0.0 x FROM f")
def gcm_step(spark, sf_dir):
    return rounded(lattice.gcm_step(ring(spark, sf_dir), 1.7, 0.2))


@query(f"{RING}, c AS (SELECT t, site, x - avg(x) OVER () c FROM st), l AS (SELECT CAST(lag AS INT) lag, avg(a.c * b.c) v FROM c a JOIN c b ON a.t = b.t, range(0, 6) r(lag) WHERE b.site = (a.site + lag) % 64 GROUP BY 1) SELECT 0 run_id, lag, round(v / max(v) FILTER (WHERE lag = 0) OVER (), 6) + 0.0 c FROM l")
def spatial_autocorrelation(spark, sf_dir):
    return rounded(lattice.spatial_autocorrelation(ring(spark, sf_dir), 5))


@query("SELECT 0 run_id, vec_id t, CAST(i AS INT) site, abs(CAST(embedding[i + 1] AS DOUBLE) - CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE)) > 0.1 burst FROM embeddings, range(0, 64) r(i)")
def burst_mask(spark, sf_dir):
    return lattice.burst_mask(ring(spark, sf_dir), 0.1)


@query(f"{RING}, o AS (SELECT *, coalesce((x - lag(x) OVER (PARTITION BY t ORDER BY x, site) > 0.01)::INT, 0) n FROM st) SELECT run_id, t, site, CAST(sum(n) OVER (PARTITION BY t ORDER BY x, site) AS BIGINT) label FROM o")
def cluster_labels(spark, sf_dir):
    return sections.cluster_labels(ring(spark, sf_dir), 0.01)


@query(f"{RING}, s AS (SELECT run_id, t, site, -2.0 * 1.7 * x s FROM st) SELECT run_id, t, CAST((site + k + 64) % 64 AS INT) i, site j, round(CASE WHEN k = 0 THEN 0.6 ELSE 0.2 END * s, 6) + 0.0 v FROM s, (SELECT unnest([-1, 0, 1]) k) WHERE (site + k + 64) % 64 < 8 AND site < 8")
def jacobian_block(spark, sf_dir):
    return rounded(lattice.jacobian_block(ring(spark, sf_dir), 1.7, 0.4, 8))


@query()
def comoving_spectrum(spark, sf_dir):
    return rounded(lattice.comoving_exponent(simulate.grid(spark, a=[1.88], eps=[0.45]), 100, [0.0, 0.25, 0.5], 200, 100))


@query("""g AS (SELECT s_suppkey / 10.0 q, s_acctbal AS value FROM supplier), p AS (SELECT DISTINCT p_size / 7.0 p FROM part)
 SELECT round(p, 6) p, round(q, 6) q, value FROM (SELECT p, q, value, row_number() OVER (PARTITION BY p ORDER BY abs(q - p), q) r FROM p, g) WHERE r = 1""")
def nearest_parameter(spark, sf_dir):
    grid = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") / 10.0).alias("q"), F.col("s_acctbal").alias("value"))
    return rounded(sections.nearest_parameter(table(spark, sf_dir, "part").select((F.col("p_size") / 7.0).alias("p")).distinct(), grid))


# --- sweeps and composites ------------------------------------------------------------------------------------------------------------


@query(f"""{LOG.format(n=120)}, sig AS (SELECT param_id, k - 21 t, x FROM walk WHERE k > 20), pts AS (SELECT * FROM (SELECT param_id, x p0, lead(x) OVER w p1, lead(x, 2) OVER w p2 FROM sig WINDOW w AS (PARTITION BY param_id ORDER BY t)) WHERE p2 IS NOT NULL),
 pat AS (SELECT param_id, list_sort([{{'v': p0, 'i': 0}}, {{'v': p1, 'i': 1}}, {{'v': p2, 'i': 2}}]) s FROM pts), c AS (SELECT param_id, s[1].i * 9 + s[2].i * 3 + s[3].i k, count(*) n FROM pat GROUP BY 1, 2), p AS (SELECT param_id, n / sum(n) OVER (PARTITION BY param_id) p FROM c)
 SELECT CAST(param_id AS BIGINT) param_id, 1.5 + 0.05 * param_id::DOUBLE a, round(-sum(p * ln(p)) / ln(6), 6) + 0.0 entropy FROM p GROUP BY param_id""")
def permutation_entropy_of_logistic(spark, sf_dir):
    out = sweeps.sweep(logistic_grid(spark), "logistic", 100, 20, lambda s: ordinal.permutation_entropy(s, 3))
    return rounded(out)


@query()
def rqa_of_delayed_logistic(spark, sf_dir):
    return rounded(sweeps.sweep(simulate.grid(spark, D=[1.3, 1.5]), "delayed_logistic", 150, 100, lambda s: recurrence.rqa(embed(s, 2, 1), percentile=5)))


@query("""RECURSIVE w(param_id, k, x) AS (SELECT k, 0, CAST(0 AS DOUBLE) FROM range(4) r(k) UNION ALL SELECT param_id, k + 1, x + 0.01 * (param_id + 1) + 1.0 * x * x FROM w WHERE k < 200 AND abs(x) < 1)
 SELECT CAST(param_id AS BIGINT) param_id, CAST(min(k) FILTER (WHERE abs(x) >= 1) AS BIGINT) length FROM w GROUP BY param_id""")
def escape_lengths(spark, sf_dir):
    params = spark.range(4).select(F.col("id").alias("param_id"), (0.01 * (F.col("id") + 1)).alias("eps"), F.lit(0.0).alias("modulo"))
    return sweeps.escape_lengths(params, "type_i", 1.0)


@query(f"""{SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 r, count(*) OVER (PARTITION BY series_id) n FROM sig)
 SELECT series_id, t, x FROM r WHERE n <= 10 OR r = 0 OR (r * 9) // greatest(n - 1, 1) > ((r - 1) * 9) // greatest(n - 1, 1)""")
def even_sample(spark, sf_dir):
    return sweeps.even_sample(src.events_by_user(spark, sf_dir), "t", 10)


@query(f"""{SIG}, r AS (SELECT * FROM (SELECT series_id, t, x, lead(x) OVER (PARTITION BY series_id ORDER BY t) y FROM sig) WHERE y IS NOT NULL)
 SELECT series_id, t, x x0, x y0, x x1, y y1 FROM r UNION ALL SELECT series_id, t, x, y, y, y FROM r""")
def cobweb(spark, sf_dir):
    return sweeps.cobweb(src.events_by_user(spark, sf_dir))


@query(f"{SIG}, m AS (SELECT *, min(x) OVER w lo, max(x) OVER w hi FROM sig WINDOW w AS (PARTITION BY series_id)) SELECT series_id, t, round(coalesce((x - lo) / nullif(hi - lo, 0), 0.5), 6) x FROM m")
def min_max_normalised(spark, sf_dir):
    return rounded(sweeps.min_max_normalised(src.events_by_user(spark, sf_dir), ["x"]))


@query()
def robust_dimension(spark, sf_dir):
    signal = sweeps.series_of(_one(spark), "henon", 700, 100)
    return rounded(sweeps.robust_dimension(signal, (2, 3, 4, 5), n_r=30, segments=3, min_segment=200, min_vectors=150))


@query(f"{RING}, p AS (SELECT t f, CAST(x * 1000 AS BIGINT) u, site v FROM st), g AS (SELECT f, (u - min(u) OVER w) / nullif(max(u) OVER w - min(u) OVER w, 0) a, (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) b FROM p WINDOW w AS (PARTITION BY f)) SELECT f field_id, CAST(least(floor(coalesce(b, 0.5) * 8), 7) AS BIGINT) y, CAST(least(floor(coalesce(a, 0.5) * 8), 7) AS BIGINT) x, CAST(count(*) AS DOUBLE) mass FROM g GROUP BY ALL")
def gridded_points(spark, sf_dir):
    points = ring(spark, sf_dir).select(F.col("t").alias("field_id"), F.round(F.col("x") * 1000).cast("long").alias("u"), F.col("site").alias("v"))
    return multifractal.gridded(points, "u", "v", 8)


from phasespark.plans import systems  # noqa: E402, F401  registers the queries of simulated systems and of the composites
