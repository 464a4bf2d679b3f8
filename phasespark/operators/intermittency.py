"""Laminar phases, their length statistics, return maps and reinjection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasespark.operators.embedding import SPAN, consecutive, in_block, in_time_blocks, lagged
from phasespark.operators.fourier import arrays
from phasespark.operators.percentiles import percentile_of
from phasespark.sources.shared import settled


def positive_percentile(values: DataFrame, column: str, percentile: float) -> DataFrame:
    """(series_id, eps): the exact percentile of the positive values."""
    return percentile_of(values.filter(F.col(column) > 0), column, percentile, "eps")


def laminar_by_period(signals: DataFrame, period: int, percentile: float = 5.0, span: int = SPAN) -> DataFrame:
    """(series_id, t, laminar): |x(t) - x(t - period)| at or under its percentile; the first ``period`` samples aren't laminar."""
    rows = in_time_blocks(signals.select("series_id", "t", "x"), before=period, span=span)
    gap = rows.withColumn("gap", F.abs(F.col("x") - F.lag("x", period).over(in_block()))).filter("_own").select("series_id", "t", "gap")
    eps = positive_percentile(gap, "gap", percentile)
    return gap.join(eps, "series_id", "left").select("series_id", "t", F.coalesce(F.col("gap") <= F.coalesce("eps", F.lit(0.0)), F.lit(False)).alias("laminar"))


def laminar_by_variance(signals: DataFrame, window: int, percentile: float = 5.0, span: int = SPAN) -> DataFrame:
    """(series_id, t, laminar): samples of any window of ``window`` whose deviation is at or under its percentile."""
    ahead = in_block().rowsBetween(0, window - 1)
    rows = in_time_blocks(signals.select("series_id", "t", "x"), after=window - 1, span=span)
    spread = rows.withColumn("s", F.when(F.count("x").over(ahead) == window, F.stddev_pop("x").over(ahead))).filter("_own").select("series_id", "t", "s")
    eps = positive_percentile(spread, "s", percentile)
    low = spread.join(eps, "series_id", "left").select("series_id", "t", F.coalesce(F.col("s") <= F.coalesce("eps", F.lit(0.0)), F.lit(False)).alias("low"))
    low = in_time_blocks(low, before=window - 1, span=span).withColumn("laminar", F.max("low").over(in_block().rowsBetween(1 - window, 0)))
    return low.filter("_own").select("series_id", "t", "laminar")


def laminar_by_recurrence(points: DataFrame, v_min: int = 2, **parameters) -> DataFrame:
    """(series_id, t, laminar): samples within a vertical line of at least ``v_min``. Series within one block are marked in one tile."""
    from phasespark.operators.recurrence import BLOCK, by_length, recurrences, short_columns, vertical_lines

    def mark(t: np.ndarray, first: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
        first, length = first[length >= v_min], length[length >= v_min]
        inside = np.bincount(first, minlength=len(t) + 1) - np.bincount(first + length, minlength=len(t) + 1)
        return {"t": t, "laminar": np.cumsum(inside)[:-1] > 0}

    short, long = by_length(points, parameters.get("block", BLOCK))
    found = short_columns(short, mark, "t long, laminar boolean", **parameters)
    if long.isEmpty():
        return found
    lines = vertical_lines(recurrences(long, **parameters), long, v_min)
    inside = lines.select("series_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("t")).distinct()
    marked = long.select("series_id", "t").join(inside.withColumn("laminar", F.lit(True)), ["series_id", "t"], "left")
    return found.unionByName(marked.select("series_id", "t", F.coalesce("laminar", F.lit(False)).alias("laminar")))


def run_lengths(mask: DataFrame, laminar: bool = True, drop_final_censored: bool = False) -> DataFrame:
    """(series_id, start, length) of the runs of a mask; optionally without the run that the series' end cuts off."""
    out = consecutive(mask.filter(F.col("laminar") == laminar), ["series_id"])
    if drop_final_censored:
        end = mask.groupBy("series_id").agg(F.max("t").alias("end"))
        out = out.join(end, "series_id").filter(F.col("start") + F.col("length") - 1 < F.col("end")).drop("end")
    return out


def length_distribution(lengths: DataFrame) -> DataFrame:
    """(series_id, length, n, p)."""
    counts = lengths.groupBy("series_id", "length").agg(F.count("*").alias("n"))
    total = counts.groupBy("series_id").agg(F.sum("n").alias("total"))
    return counts.join(total, "series_id").select("series_id", "length", "n", (F.col("n") / F.col("total")).alias("p"))


def pooled_lengths(lengths: DataFrame, pool=None) -> DataFrame:
    """(series_id, start, length) with the runs of many series as those of one: all of them, or those with the same ``pool`` column."""
    return lengths.withColumn("series_id", F.lit("pool") if pool is None else pool)


def binned_distribution(values: DataFrame, value: str, key: str = "series_id", max_bins: int = 512) -> DataFrame:
    """(key, bin, lo, hi, mass) over Freedman-Diaconis bins of each key's values; without quartile range, as many as the root of their number.

    Over ``max_bins`` they become that many, of equal ratio if the values span over six decades. Equal values share one bin around them.
    The last bin holds its upper edge; empty bins have rows.
    """
    stats = values.groupBy(key).agg(F.count(value).alias("n"), F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"), F.percentile(value, [0.25, 0.75]).alias("q"))
    iqr, span = F.col("q")[1] - F.col("q")[0], F.col("most") - F.col("least")
    wanted = F.when(iqr > 0, F.ceil(span / (2 * iqr / F.cbrt(F.col("n").cast("double"))))).otherwise(F.ceil(F.sqrt("n")))
    ratio = (wanted > max_bins) & (F.col("least") > 0) & (F.col("most") / F.col("least") > 1e6)
    stats = stats.filter("n > 0").withColumn("bins", F.when(span == 0, 1).otherwise(F.least(F.greatest(wanted, F.lit(1)), F.lit(max_bins))).cast("int")).withColumn("ratio", ratio)
    half = F.when(F.col("least") != 0, F.abs("least") * 0.5).otherwise(0.5)
    stats = stats.withColumn("from", F.when(span == 0, F.col("least") - half).otherwise(F.col("least"))).withColumn("to", F.when(span == 0, F.col("most") + half).otherwise(F.col("most"))).drop("q")
    share = lambda x: F.when(F.col("ratio"), F.log(x / F.col("from")) / F.log(F.col("to") / F.col("from"))).otherwise((x - F.col("from")) / (F.col("to") - F.col("from")))
    edge = lambda k: F.when(F.col("ratio"), F.col("from") * F.pow(F.col("to") / F.col("from"), k / F.col("bins"))).otherwise(F.col("from") + (F.col("to") - F.col("from")) * k / F.col("bins"))
    placed = values.join(stats, key).select(key, F.least(F.floor(share(F.col(value)) * F.col("bins")), F.col("bins") - 1).cast("int").alias("bin"))
    counts = placed.groupBy(key, "bin").agg(F.count("*").alias("c"))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    rows = grid.join(counts, [key, "bin"], "left")
    return rows.select(key, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), (F.coalesce("c", F.lit(0)) / F.col("n")).alias("mass"))


#: Distinct values of a block, and values of a run up to which all are knots.
VALUES, KNOTS = 4096, 4096
#: Distances that lie this near to each other are all looked at exactly.
NEAR = 1e-12


def _value_blocks(observations: DataFrame) -> DataFrame:
    """(run_id, block, own): the distinct positive values of a run in blocks of ``VALUES``, ascending, as structs of the value, its count c,
    and over all values from it on their number n and sum of logarithms s. One sorted window, then a row a block."""
    values = observations.filter("value > 0").groupBy("run_id", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("c"))
    return _blocks_of_counts(values)


def _blocks_of_counts(values: DataFrame) -> DataFrame:
    down = Window.partitionBy("run_id").orderBy(F.desc("value"))
    tails = values.select("run_id", "value", "c", F.sum("c").over(down).alias("n"), F.sum(F.col("c") * F.log("value")).over(down).alias("s"), F.row_number().over(down).alias("k"))
    packed = tails.repartition("run_id", F.floor((F.col("k") - 1) / VALUES)).groupBy("run_id", F.floor((F.col("k") - 1) / VALUES).alias("block"))
    return packed.agg(F.sort_array(F.collect_list(F.struct("value", "c", "n", "s"))).alias("own"))


def _cdf(values: np.ndarray, low: np.ndarray, alpha: np.ndarray, discrete: bool) -> np.ndarray:
    """The share of each power law (a row) at or under each value (a column)."""
    if discrete:
        return 1 - zeta(alpha[:, None], values[None, :] + 1) / zeta(alpha, low)[:, None]
    return 1 - (values[None, :] / low[:, None]) ** (1 - alpha[:, None])


def _bounds(low, n_tail, alpha, knots, above, discrete: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance that tails may have from their laws, from some of the values and the numbers ``above`` them.

    At a knot the distance is known. Between two, the shares of the tail and of the law both lie between theirs at the knots.
    """
    inside = knots[None, :] >= low[:, None]
    with np.errstate(all="ignore"):
        model = np.where(inside, _cdf(knots, low, alpha, discrete), 0.0)
    tail = np.where(inside, 1 - above[None, :] / n_tail[:, None], 0.0)
    least = np.where(inside, np.abs(tail - model), 0.0).max(axis=1)
    before = np.zeros((len(low), 1))
    most = np.maximum(tail - np.hstack([before, model[:, :-1]]), model - np.hstack([before, tail[:, :-1]]))
    return least, np.maximum(np.where(inside, most, 0.0).max(axis=1), least)


def _structs(column: pa.Array, *names: str) -> list[list[np.ndarray]]:
    """The lists of structs of a column, as arrays of their fields."""
    offsets, fields = np.asarray(column.offsets), [np.asarray(column.values.field(n)) for n in names]
    return [[f[a:b] for f in fields] for a, b in zip(offsets, offsets[1:], strict=False)]


def _kept(run: pa.Array, row: list[int], found: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    """Rows of arrays, each with the run of its batch row."""
    series = run.take(pa.array(np.repeat(row, [len(f[0]) for f in found]).astype(np.int64), pa.int64()))
    columns = [pa.array(np.concatenate([f[j] for f in found]) if found else [], k) for j, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([series, *columns], names=["run_id", *names])


def _fit_blocks(blocks: DataFrame, min_tail: int, discrete: bool) -> DataFrame:
    """(run_id, x_min, alpha, ks, n_tail) from ``_value_blocks``.

    Each value is a candidate. Of a run of over ``KNOTS`` values the knots lie the closer the higher they are, so that every tail has about as
    many of them, and a candidate's distance at them bounds its own. Some candidates of each block give a bound for the whole run first; the
    others meet few knots, then more, while they are under it. Only those left meet the whole tail, block by block, the most likely one before
    the others. Where all values of a run are knots, none has to.
    """
    kind = blocks.schema["run_id"].dataType.simpleString()
    sizes = blocks.groupBy("run_id").agg(F.sum(F.size("own")).alias("m"))
    rank = lambda i: F.col("block") * VALUES + F.size("own") - i  # noqa: E731  of a value, from the highest
    step = lambda i: F.when(F.col("m") <= KNOTS, 1).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(rank(i) * 16.0 / KNOTS, F.lit(1.0)))))).cast("long")
    some = F.filter("own", lambda x, i: rank(i) % step(i) == 0)
    knots = blocks.join(sizes, "run_id").select("run_id", F.inline(some))
    knots = knots.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("value", (F.col("n") - F.col("c")).alias("above")))).alias("knots"))
    knots = knots.join(sizes, "run_id").select("run_id", "knots", (F.size("knots") == F.col("m")).alias("whole"))
    dealt = blocks.join(knots, "run_id")

    def candidates(value: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        mean = s / n
        ok = (n >= min_tail) & (mean - np.log(value) > 1e-12)
        return value[ok], n[ok], mean[ok]

    def exponents(mean: np.ndarray, low: np.ndarray) -> np.ndarray:
        return discrete_alphas(mean, low) if discrete else 1 + 1 / (mean - np.log(low))

    def together(own: list[tuple]) -> Iterator[np.ndarray]:
        """The exponents of the candidates of many short runs at once."""
        first, size = 0, 0
        for i, (low, _, _) in enumerate(own):
            size += len(low)
            if size >= 1 << 14 or i == len(own) - 1:
                part = own[first : i + 1]
                alpha = exponents(np.concatenate([mean for _, _, mean in part]), np.concatenate([low for low, _, _ in part]))
                yield from np.split(alpha, np.cumsum([len(low) for low, _, _ in part])[:-1])
                first, size = i + 1, 0

    def bounds(low, n, alpha, at, above, stride: int) -> tuple[np.ndarray, np.ndarray]:
        some = np.unique(np.r_[np.arange(0, len(at), stride), len(at) - 1])
        parts = [_bounds(low[p], n[p], alpha[p], at[some], above[some], discrete) for p in np.array_split(np.arange(len(low)), max(1, len(low) * len(some) >> 20))]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def promise(batches):
        """The least of the greatest distances of a few candidates of each block."""
        for batch in batches:
            row, found = [], []
            for i, ((value, n, s), (at, above)) in enumerate(zip(_structs(batch.column("own"), "value", "n", "s"), _structs(batch.column("knots"), "value", "above"), strict=True)):
                low, n, mean = (x[::64] for x in candidates(value, n, s))
                if len(low):
                    alpha = exponents(mean, low)
                    best = np.argsort(bounds(low, n, alpha, at, above, 16)[0])[:2]
                    row.append(i)
                    found.append((bounds(low[best], n[best], alpha[best], at, above, 1)[1].min(keepdims=True),))
            yield _kept(batch.column("run_id"), row, found, ["most"], [pa.float64()])

    spread = dealt.filter("not whole").repartition("run_id", "block")
    most = settled(spread.select("run_id", "own", "knots").mapInArrow(promise, f"run_id {kind}, most double").groupBy("run_id").agg(F.min("most").alias("most")))
    dealt = dealt.join(most, "run_id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    # many short runs are few bytes but much work: their number of tasks is given
    dealt = dealt.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run_id", "block")

    def bound(batches):
        for batch in batches:
            row, found, whole, most = [], [], batch.column("whole").to_pylist(), batch.column("most").to_pylist()
            own = [candidates(*b) for b in _structs(batch.column("own"), "value", "n", "s")]
            for i, ((low, n, _), alpha, (at, above)) in enumerate(zip(own, together(own), _structs(batch.column("knots"), "value", "above"), strict=True)):
                if not len(low):
                    continue
                lower, upper = np.zeros(len(low)), np.full(len(low), np.inf)
                keep = np.arange(len(low))
                for stride in (64, 16, 4, 1) if len(at) > 64 else (1,):
                    lower[keep], upper[keep] = bounds(low[keep], n[keep], alpha[keep], at, above, stride)
                    keep = keep[lower[keep] <= min(upper[keep].min(), most[i]) + NEAR]
                    if not len(keep):
                        break
                if not len(keep):
                    continue
                if whole[i]:  # all values of the run were knots: distances are exact, and the first of the least is the block's
                    keep = keep[[int(lower[keep].argmin())]]
                    upper[keep] = lower[keep]
                row.append(i)
                found.append((low[keep], n[keep], alpha[keep], lower[keep], upper[keep], np.full(len(keep), whole[i])))
            yield _kept(batch.column("run_id"), row, found, ["x_min", "n_tail", "alpha", "lower", "upper", "exact"], [pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()])

    bounded = settled(dealt.select("run_id", "own", "knots", "whole", "most").mapInArrow(bound, f"run_id {kind}, x_min double, n_tail long, alpha double, lower double, upper double, exact boolean"))
    done = bounded.filter("exact").select("run_id", "x_min", "n_tail", "alpha", F.col("lower").alias("ks"))
    nearest = lambda ks: ks.groupBy("run_id").agg(F.min_by(F.struct("x_min", "alpha", "ks", "n_tail"), F.struct("ks", "x_min")).alias("b")).select("run_id", "b.x_min", "b.alpha", "b.ks", "b.n_tail")
    bounded = bounded.filter("not exact")
    if bounded.isEmpty():
        return nearest(done)
    def exact(batches):
        for batch in batches:
            row, found = [], []
            for i, ((low, n, alpha), (value, count, total)) in enumerate(zip(_structs(batch.column("left"), "x_min", "n_tail", "alpha"), _structs(batch.column("own"), "value", "c", "n"), strict=True)):
                ks = np.concatenate([_bounds(low[p], n[p], alpha[p], value, total - count, discrete)[0] for p in np.array_split(np.arange(len(low)), max(1, len(low) * len(value) >> 20))])
                row.append(i)
                found.append((low, n, alpha, ks))
            yield _kept(batch.column("run_id"), row, found, ["x_min", "n_tail", "alpha", "ks"], [pa.float64(), pa.int64(), pa.float64(), pa.float64()])

    def measured(left: DataFrame) -> DataFrame:
        """Candidates with their distances over the whole tail."""
        left = left.withColumn("part", F.floor(F.row_number().over(Window.partitionBy("run_id").orderBy("x_min")) / 1024))
        left = left.groupBy("run_id", "part").agg(F.collect_list(F.struct("x_min", "n_tail", "alpha")).alias("left"), F.min("x_min").alias("low"))
        met = left.join(blocks.withColumn("high", F.element_at("own.value", -1)), "run_id").filter("high >= low").repartition("run_id", "part", "block")
        ks = met.select("run_id", "left", "own").mapInArrow(exact, f"run_id {kind}, x_min double, n_tail long, alpha double, ks double")
        return ks.groupBy("run_id", "x_min", "n_tail", "alpha").agg(F.max("ks").alias("ks"))

    likely = bounded.groupBy("run_id").agg(F.min_by(F.struct("x_min", "n_tail", "alpha"), F.struct("lower", "x_min")).alias("b")).select("run_id", "b.*")
    most = settled(measured(likely).select("run_id", F.col("ks").alias("most")))
    left = bounded.join(most, "run_id").filter(F.col("lower") <= F.col("most") + NEAR)
    return nearest(measured(left.select("run_id", "x_min", "n_tail", "alpha")).unionByName(done))


def fit_power_law(observations: DataFrame, min_tail: int = 10, discrete: bool = False) -> DataFrame:
    """(run_id, x_min, alpha, ks, n_tail): power law over real numbers, or with ``discrete`` over integers by the zeta function; x_min is the
    value with the smallest Kolmogorov-Smirnov distance.

    ``observations``: (run_id, value). Candidates without log spread are skipped; ties take the smallest x_min. See ``_fit_blocks``.
    """
    return _fit_blocks(settled(_value_blocks(observations)), min_tail, discrete)


def fit_exponential(observations: DataFrame, x_min: float | None = None) -> DataFrame:
    """(run_id, x_min, scale, n): shifted exponential; the shift is the smallest value unless given."""
    low = F.min("value") if x_min is None else F.lit(float(x_min))
    rows = observations if x_min is None else observations.filter(F.col("value") >= x_min)
    return rows.groupBy("run_id").agg(low.alias("x_min"), (F.avg("value") - low).alias("scale"), F.count("*").alias("n"))


def zeta(alpha, q, terms: int = 24) -> np.ndarray:
    """Hurwitz zeta by direct terms and the Euler-Maclaurin remainder, for arrays."""
    alpha, q = np.asarray(alpha, dtype=np.float64), np.asarray(q, dtype=np.float64)
    head = sum((q + k) ** -alpha for k in range(terms))
    a = q + terms
    rest = a ** (1 - alpha) / (alpha - 1) + 0.5 * a**-alpha + alpha * a ** (-alpha - 1) / 12
    return head + rest - alpha * (alpha + 1) * (alpha + 2) * a ** (-alpha - 3) / 720


def discrete_alphas(mean_log: np.ndarray, x_min: np.ndarray) -> np.ndarray:
    """The exponents that maximise the discrete likelihood of tails, all at once: golden-section search on its logarithm."""
    cost = lambda a: a * mean_log + np.log(zeta(a, x_min))
    lo, hi, g = np.full(len(x_min), 1.0001), np.full(len(x_min), 20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = cost(a) < cost(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def fit_power_law_discrete(observations: DataFrame, min_tail: int = 10) -> DataFrame:
    """``fit_power_law`` over integers."""
    return fit_power_law(observations, min_tail, True)


def _draw_discrete(rng: np.random.Generator, alpha: float, low: float, size: int) -> np.ndarray:
    """Integers from ``low`` on by the zeta law: the smallest x with P(X <= x) over a uniform number, by doubling and halving."""
    left = rng.random(size) * zeta(alpha, low)  # P(X > x) of the wanted x is at most this share
    near, far = np.full(size, low), np.full(size, low)
    while (over := zeta(alpha, far + 1) > left).any():
        near, far = np.where(over, far + 1, near), np.where(over, 2 * far + 1, far)
    while (near < far).any():
        middle = np.floor((near + far) / 2)
        over = zeta(alpha, middle + 1) > left
        near, far = np.where(over, middle + 1, near), np.where(over, far, middle)
    return near


#: Values that a task draws at a time for a resample's tail.
DRAWS = 1 << 16


def _resamples(blocks: DataFrame, fit: DataFrame, n_bootstrap: int, seed: int, discrete: bool) -> DataFrame:
    """(run_id, boot, value, c): resamples of the runs of ``blocks`` as counts.

    A resample has as many values as its run. Each comes from the fitted tail with the tail's share, or else is one of the run's values under
    it. How many come from the tail and from each block of values is drawn first, once a resample; then each block draws the counts of its
    values by themselves, and the tail is drawn in pieces of ``DRAWS``.
    """
    run_kind = blocks.schema["run_id"].dataType.simpleString()
    own = blocks.join(fit, "run_id").withColumn("under", F.filter("own", lambda x: x["value"] < F.col("x_min")))
    own = own.withColumn("u", F.aggregate("under", F.lit(0).cast("long"), lambda acc, x: acc + x["c"]))
    shape = own.groupBy("run_id", "x_min", "alpha", "n_tail").agg(F.sort_array(F.collect_list(F.struct("block", "u"))).alias("parts"))
    key = F.xxhash64(F.col("run_id").cast("string"))
    asked = shape.select("run_id", "x_min", "alpha", "n_tail", "parts", F.pmod(key, F.lit(1 << 62)).alias("key"), F.explode(F.sequence(F.lit(1), F.lit(n_bootstrap))).alias("boot"))

    def deal(batches):
        for batch in batches:
            rows = []
            for run, low, alpha, n_tail, parts, key, boot in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                u = np.array([p["u"] for p in parts], dtype=np.int64)
                rng = np.random.default_rng([seed, key, boot])
                n = n_tail + int(u.sum())
                tail = int(rng.binomial(n, n_tail / n)) if u.sum() else n
                rows += [(run, boot, -1 - k, low, alpha, min(DRAWS, tail - k * DRAWS)) for k in range(-(-tail // DRAWS))]
                if u.sum():
                    rows += [(run, boot, p["block"], low, alpha, int(k)) for p, k in zip(parts, rng.multinomial(n - tail, u / u.sum()), strict=True) if k]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("run_id").type, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["run_id", "boot", "block", "x_min", "alpha", "k"])

    drawn = asked.repartition("run_id", "boot").mapInArrow(deal, f"run_id {run_kind}, boot int, block long, x_min double, alpha double, k long")
    pieces = drawn.join(own.select("run_id", "block", "under"), ["run_id", "block"], "left").repartition("run_id", "boot", "block")
    pieces = pieces.select("run_id", "boot", "block", "x_min", "alpha", "k", F.pmod(key, F.lit(1 << 62)).alias("key"), F.coalesce(F.col("under.value"), F.array().cast("array<double>")).alias("v"), F.coalesce(F.col("under.c"), F.array().cast("array<long>")).alias("c"))

    def draw(batches):
        for batch in batches:
            plain = {c: batch.column(c).to_pylist() for c in ("boot", "block", "x_min", "alpha", "k", "key")}
            values, counts = (arrays(batch.column(c)) for c in ("v", "c"))
            row, found = [], []
            for i, (boot, block, low, alpha, k, key) in enumerate(zip(*plain.values(), strict=True)):
                rng = np.random.default_rng([seed, key, boot, block + (1 << 40)])
                if block < 0:
                    x = _draw_discrete(rng, alpha, low, k) if discrete else low * (1 - rng.random(k)) ** (-1 / (alpha - 1))
                    v, c = np.unique(x, return_counts=True)
                else:
                    c = rng.multinomial(k, counts[i] / counts[i].sum())
                    v, c = values[i][c > 0], c[c > 0]
                row.append(i)
                found.append((np.full(len(v), boot), v, c))
            yield _kept(batch.column("run_id"), row, found, ["boot", "value", "c"], [pa.int32(), pa.float64(), pa.int64()])

    return pieces.mapInArrow(draw, f"run_id {run_kind}, boot int, value double, c long")


def power_law_bootstrap(observations: DataFrame, n_bootstrap: int = 100, min_tail: int = 10, confidence: float = 0.95, seed: int = 0, discrete: bool = False) -> DataFrame:
    """(run_id, alpha, x_min, ks, p_value, lower, upper): goodness of fit and exponent interval by resampling.

    Resamples are drawn and fitted as counts of distinct values, block by block: neither a run nor a resample has to fit a task. Draws depend
    on the seed, the run, the resample and the block only. Runs without a fit have nulls.
    """
    blocks = settled(_value_blocks(observations))
    fit = settled(_fit_blocks(blocks, min_tail, discrete))
    again = _resamples(blocks, fit.select("run_id", "x_min", "alpha", "n_tail"), n_bootstrap, seed, discrete)
    again = again.groupBy(F.struct("run_id", "boot").alias("run_id"), "value").agg(F.sum("c").alias("c"))
    fits = _fit_blocks(settled(_blocks_of_counts(again.select(F.to_json("run_id").alias("run_id"), "value", "c"))), min_tail, discrete)
    kind = observations.schema["run_id"].dataType.simpleString()
    fits = fits.select(F.from_json("run_id", f"run_id {kind}, boot int").alias("r"), "alpha", "ks").select("r.run_id", "alpha", "ks")
    tails = F.percentile("alpha", [(1 - confidence) / 2, (1 + confidence) / 2])
    joined = fits.join(fit.select("run_id", F.col("ks").alias("own")), "run_id").groupBy("run_id").agg(tails.alias("q"), F.avg((F.col("ks") >= F.col("own")).cast("double")).alias("p_value"))
    rows = observations.select("run_id").distinct().join(fit, "run_id", "left").join(joined, "run_id", "left")
    return rows.select("run_id", "alpha", "x_min", "ks", "p_value", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))


def compare_power_law_exponential(observations: DataFrame, min_tail: int = 10, discrete: bool = False) -> DataFrame:
    """(run_id, z, p): the normalised log-likelihood ratio of the power law and the exponential over the power law's tail, and how often
    chance alone gives one as large; positive z speaks for the power law."""
    fit = fit_power_law(observations, min_tail, discrete)
    log_norm = F.log((F.col("alpha") - 1) / F.col("x_min")) + F.col("alpha") * F.log("x_min")
    if discrete:
        log_norm = -F.arrow_udf(lambda a, q: pa.array(np.log(zeta(a.to_numpy(), q.to_numpy()))), "double")("alpha", "x_min")
    fit = fit.withColumn("norm", log_norm)
    tail = observations.join(fit, "run_id").filter("value >= x_min")
    scale = observations.join(fit, "run_id").filter("value >= x_min").groupBy("run_id").agg(F.avg(F.col("value") - F.col("x_min")).alias("scale"))
    power = F.col("norm") - F.col("alpha") * F.log("value")
    expo = -F.log("scale") - (F.col("value") - F.col("x_min")) / F.col("scale")
    ratio = tail.join(scale, "run_id").select("run_id", (power - expo).alias("r"))
    z = ratio.groupBy("run_id").agg(F.try_divide(F.sum("r"), F.sqrt(F.count("*")) * F.stddev_samp("r")).alias("z"))
    return z.select("run_id", "z", _two_sided(F.col("z")).alias("p"))


def _two_sided(z):
    """The chance of a normal deviate of at least this size."""
    erfc = np.vectorize(math.erfc, otypes=[float])
    return F.arrow_udf(lambda c: pa.array(erfc(np.abs(c.to_numpy(zero_copy_only=False)) / math.sqrt(2.0)), from_pandas=True), "double")(z)


def mean_laminar_scaling(points: DataFrame) -> DataFrame:
    """(run_id, beta, inverse_coefficient, inverse_residual, log_slope, log_residual) of mean lengths against eps.

    ``points``: (run_id, eps, length). A power law, a line through the origin in 1/eps, and a line in ln 1/eps.
    """
    e, y = F.col("eps"), F.col("length")
    ok = points.filter("eps > 0 and length > 0")
    fits = ok.groupBy("run_id").agg(
        F.regr_slope(F.log(y), F.log(e)).alias("beta"),
        (F.sum(y / e) / F.sum(1 / (e * e))).alias("inverse_coefficient"),
        F.regr_slope(y, -F.log(e)).alias("log_slope"),
        F.regr_intercept(y, -F.log(e)).alias("_b"),
    )
    j = ok.join(fits, "run_id")
    r1 = y - F.col("inverse_coefficient") / e
    r2 = y - F.col("_b") + F.col("log_slope") * F.log(e)
    return j.groupBy("run_id", "beta", "inverse_coefficient", "log_slope").agg(F.sum(r1 * r1).alias("inverse_residual"), F.sum(r2 * r2).alias("log_residual"))


def reinjection(signals: DataFrame, mask: DataFrame) -> DataFrame:
    """(series_id, n, slope, alpha): entry points into laminar runs, their running mean M(x) against x, and (2m - 1)/(1 - m)."""
    rows = in_time_blocks(signals.select("series_id", "t", "x").join(mask, ["series_id", "t"]), before=1)
    entries = rows.withColumn("before", F.lag("laminar").over(in_block())).filter("_own and laminar and not before")
    up = Window.partitionBy("series_id").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    m = entries.select("series_id", "x", F.avg("x").over(up).alias("m"))
    fit = m.groupBy("series_id").agg(F.count("*").alias("n"), F.regr_slope("m", "x").alias("slope"))
    return fit.select("series_id", "n", "slope", F.try_divide(2 * F.col("slope") - 1, 1 - F.col("slope")).alias("alpha"))


def burst_amplitudes(signals: DataFrame, mask: DataFrame) -> DataFrame:
    """(run_id, value): absolute values outside laminar runs, zeros left out."""
    return signals.join(mask.filter("not laminar"), ["series_id", "t"]).select(F.col("series_id").alias("run_id"), F.abs("x").alias("value")).filter("value > 0")


def laminar_burst_symmetry(mask: DataFrame) -> DataFrame:
    """(series_id, ks, p): two-sample Kolmogorov-Smirnov distance of laminar and burst run lengths, and its chance by the limit law."""
    both = run_lengths(mask, True).withColumn("k", F.lit(1)).unionByName(run_lengths(mask, False).withColumn("k", F.lit(0)))
    at = both.groupBy("series_id", "length").agg(F.sum("k").alias("a"), F.sum(1 - F.col("k")).alias("b"))
    up, whole = Window.partitionBy("series_id").orderBy("length"), Window.partitionBy("series_id")
    share = lambda c: F.try_divide(F.sum(c).over(up).cast("double"), F.sum(c).over(whole).cast("double"))
    gap = at.select("series_id", F.abs(share("a") - share("b")).alias("gap"), F.sum("a").over(whole).alias("n"), F.sum("b").over(whole).alias("m"))
    out = gap.groupBy("series_id").agg(F.max("gap").alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))
    x = F.col("ks") * F.col("ks") * F.col("n") * F.col("m") / F.greatest(F.col("n") + F.col("m"), F.lit(1))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x))
    return out.select("series_id", "ks", F.when(F.col("ks").isNotNull(), F.when(x < 0.04, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))).alias("p"))


def extrema(signals: DataFrame, kind: str = "max", span: int = SPAN) -> DataFrame:
    """(series_id, t, x) of local extrema; a plateau counts once, at its middle (rounded down)."""
    v = F.col("x") if kind == "max" else -F.col("x")
    rows = in_time_blocks(signals.select("series_id", "t", "x", v.alias("v")), before=1, after=1, span=span)
    rows = rows.withColumns({"l": F.lag("v").over(in_block()), "r": F.lead("v").over(in_block())}).filter("_own")
    peaks = rows.filter("v > l and v > r").select("series_id", "t", "x")
    # the first sample of a plateau that rises to it, the last of one that falls from it
    level = rows.filter("v = l or v = r").select("series_id", "x", "t", F.coalesce(F.col("v") > F.col("l"), F.lit(False)).alias("rises"), F.coalesce(F.col("v") > F.col("r"), F.lit(False)).alias("falls"))
    flat = consecutive(level, ["series_id", "x"], ("rises", "falls"), span).filter("rises and falls")
    return peaks.unionByName(flat.select("series_id", (F.col("start") + F.floor((F.col("length") - 1) / 2)).alias("t"), "x"))


def return_map(signals: DataFrame, lag: int = 1) -> DataFrame:
    """(series_id, t, x, y): each value with the one ``lag`` later."""
    return lagged(signals, [0, lag]).toDF("series_id", "t", "x", "y")


def spaced(peaks: DataFrame, distance: int, span: int = SPAN) -> DataFrame:
    """The rows of ``peaks`` (series_id, t, v) that stay when the highest, of equal ones the latest, removes those less than ``distance`` away,
    and so on with the rest.

    In rounds: what no undecided peak near it tops stays, and what is near a peak that stays goes. A round is a window over time blocks; there
    are as many as peaks in the longest rising row of near peaks.
    """
    near = in_block().rangeBetween(1 - distance, distance - 1)
    open_, kept = settled(peaks.select("series_id", "t", "v")), None
    while not open_.isEmpty():
        rows = in_time_blocks(open_, before=2 * distance, after=2 * distance, span=span)
        rows = rows.withColumn("_top", F.max(F.struct("v", "t")).over(near)["t"] == F.col("t"))
        rows = settled(rows.withColumn("_near", F.max("_top").over(near)).filter("_own").select("series_id", "t", "v", "_top", "_near"))
        stay = rows.filter("_top").select("series_id", "t", "v")
        kept = stay if kept is None else kept.unionByName(stay)
        open_ = rows.filter("not _near").select("series_id", "t", "v")
    return open_ if kept is None else kept


def _reach_left(v: np.ndarray, at: np.ndarray, low: np.ndarray | None = None, tops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``at``: the last one before it with a higher value than ``tops`` there (-1: none), and the least of ``low`` between.

    All places at once: ranges of halving length are skipped while nothing in them is higher.
    """
    low, tops = (v if low is None else low), (v[at] if tops is None else tops)
    highs, lows = [v], [low]
    while 2 << (len(highs) - 1) <= len(v):
        half = 1 << (len(highs) - 1)
        highs.append(np.maximum(highs[-1][:-half], highs[-1][half:]))
        lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
    place, least = at.copy(), np.full(len(at), np.inf)
    for level in range(len(highs) - 1, -1, -1):
        for _ in range(2):  # the longest ranges may be skipped twice
            start = place - (1 << level)
            ok = start >= 0
            ok[ok] = highs[level][start[ok]] <= tops[ok]
            least[ok] = np.minimum(least[ok], lows[level][start[ok]])
            place = np.where(ok, start, place)
    return place - 1, least


def _records(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seen from the end: the values higher than all after them, and the least after each."""
    back = v[::-1]
    before = np.r_[-np.inf, np.maximum.accumulate(back)[:-1]]
    at = np.flatnonzero(back > before)
    return back[at], np.r_[np.inf, np.minimum.accumulate(back)[:-1]][at]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in values])], pa.int32()), pa.array(np.concatenate(values) if values else [], pa.float64()))


#: What is known of a peak within its block.
PEAK = ("at", "v", "left", "right", "left_open", "right_open")


def prominences(signals: DataFrame, peaks: DataFrame, span: int = SPAN) -> DataFrame:
    """(series_id, t, v, prominence) for ``peaks`` (series_id, t, v) of signals (series_id, t, v): the rise over the higher of the two lowest
    points between a peak and the next higher sample on either side, or the end of the series.

    A time block is one array and gives a summary: its range, and from either end the values that top all before them with the least before
    each. A peak whose higher sample lies beyond its block looks for the block by the ranges alone, and for the place by that block's summary.
    """
    cells = signals.select("series_id", "t", "v").join(peaks.select("series_id", "t", F.lit(True).alias("_peak")), ["series_id", "t"], "left")
    blocks = cells.groupBy("series_id", F.floor(F.col("t") / span).alias("block")).agg(F.sort_array(F.collect_list(F.struct("t", "v", F.col("_peak").isNotNull().alias("p")))).alias("b"))
    blocks = blocks.select("series_id", "block", F.col("b.v").alias("v"), F.col("b.t")[0].alias("first"), F.expr("transform(filter(sequence(0, size(b) - 1), i -> b[i].p), i -> double(i))").alias("at"))

    def summary(batches):
        for batch in batches:
            values, places = arrays(batch.column("v")), arrays(batch.column("at"))
            found = {c: [] for c in PEAK}
            ends = {c: [] for c in ("lv", "ll", "rv", "rl")}
            for v, at in zip(values, places, strict=True):
                at = at.astype(np.int64)
                before, left = _reach_left(v, at)
                after, right = _reach_left(v[::-1], len(v) - 1 - at)
                for c, x in zip(found, (at, v[at], np.minimum(left, v[at]), np.minimum(right, v[at]), before < 0, after < 0), strict=True):
                    found[c].append(x.astype(np.float64))
                for c, x in zip(ends, (*_records(v), *_records(v[::-1])), strict=True):
                    ends[c].append(x)
            high, low = ([float(f(v)) for v in values] for f in (np.max, np.min))
            columns = [batch.column("series_id"), batch.column("block"), batch.column("first"), pa.array(high, pa.float64()), pa.array(low, pa.float64()), *map(_lists, found.values()), *map(_lists, ends.values())]
            yield pa.RecordBatch.from_arrays(columns, names=["series_id", "block", "first", "high", "low", *found, *ends])

    kind = signals.schema["series_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<double>" for c in (*PEAK, "lv", "ll", "rv", "rl"))
    # seen from its right end a block is met by peaks after it (lv, ll), from its left end by those before it (rv, rl)
    found = settled(blocks.mapInArrow(summary, f"series_id {kind}, block long, first long, high double, low double, {lists}"))
    rows = found.select("series_id", "block", "first", F.inline(F.arrays_zip(*PEAK))).toDF("series_id", "block", "first", *PEAK)
    rows = rows.withColumn("t", (F.col("first") + F.col("at")).cast("long"))
    chain = found.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("block", "high", "low"))).alias("c"))
    chain = chain.select("series_id", F.col("c.block").alias("blocks"), F.col("c.high").alias("highs"), F.col("c.low").alias("lows"))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def beyond(block: pa.Array, tops: pa.Array, blocks: pa.Array, highs: pa.Array, lows: pa.Array, backward: pa.Array) -> pa.Array:
        """The block with a higher sample (-1: none) and the least of those between."""
        out = []
        for b, top, every, high, low, back in zip(block.to_pylist(), np.asarray(tops), arrays(blocks), arrays(highs), arrays(lows), backward.to_pylist(), strict=True):
            at = int(np.searchsorted(every, b))
            if back:
                at, high, low = len(every) - 1 - at, high[::-1], low[::-1]
            place, least = _reach_left(high, np.array([at]), low, np.array([top]))
            place = int(place[0])
            out += [float(every[len(every) - 1 - place if back else place]) if place >= 0 else -1.0, float(least[0])]
        return pa.ListArray.from_arrays(pa.array(range(0, len(out) + 1, 2), pa.int32()), pa.array(out, pa.float64()))

    for side, back, tops, lows in (("left", False, "lv", "ll"), ("right", True, "rv", "rl")):
        asked = rows.filter(F.col(f"{side}_open") > 0).select("series_id", "block", "t", "v").join(chain, "series_id")
        asked = asked.select("series_id", "t", "v", beyond("block", "v", "blocks", "highs", "lows", F.lit(back)).alias("_b"))
        asked = asked.select("series_id", "t", "v", F.col("_b")[0].cast("long").alias("block"), F.col("_b")[1].alias("_between"))
        ends = found.select("series_id", "block", F.arrays_zip(F.col(tops).alias("top"), F.col(lows).alias("low")).alias("_r"))
        asked = asked.join(ends, ["series_id", "block"], "left")
        inside = F.get(F.filter("_r", lambda r: r["top"] > F.col("v")), F.lit(0))["low"]
        further = asked.select("series_id", "t", F.least("_between", F.coalesce(inside, F.lit(float("inf")))).alias("_further"))
        rows = rows.join(further, ["series_id", "t"], "left").withColumn(side, F.least(side, F.coalesce("_further", F.lit(float("inf"))))).drop("_further")
    return rows.select("series_id", "t", "v", (F.col("v") - F.greatest("left", "right")).alias("prominence"))


def spaced_extrema(signals: DataFrame, kind: str = "max", prominence: float | None = None, distance: int | None = None, span: int = SPAN) -> DataFrame:
    """(series_id, t, x, prominence) of local extrema that stand ``distance`` apart at least, higher ones first and later ones among equals,
    and then those that rise by ``prominence`` over the higher of the two lowest points towards a higher sample on either side."""
    if distance is not None and distance < 1 or prominence is not None and prominence < 0:
        raise ValueError("distance must be at least 1, prominence not negative")
    sign = 1.0 if kind == "max" else -1.0
    peaks = extrema(signals, kind, span).select("series_id", "t", (sign * F.col("x")).alias("v"))
    if distance is not None and distance > 1:
        peaks = spaced(peaks, distance, span)
    rows = prominences(signals.select("series_id", "t", (sign * F.col("x")).alias("v")), peaks, span)
    return rows.filter(F.col("prominence") >= (prominence or 0.0)).select("series_id", "t", (sign * F.col("v") + 0.0).alias("x"), "prominence")


def extrema_return_map(signals: DataFrame, kind: str = "max", prominence: float | None = None, distance: int | None = None) -> DataFrame:
    """(series_id, k, x, y): successive extrema, if asked only prominent or distant ones."""
    by = Window.partitionBy("series_id").orderBy("t")
    found = extrema(signals, kind) if prominence is None and distance is None else spaced_extrema(signals, kind, prominence, distance)
    peaks = found.select("series_id", (F.row_number().over(by) - 1).cast("long").alias("k"), "x", F.lead("x").over(by).alias("y"))
    return peaks.filter("y is not null")


def tangent_channel(points: DataFrame, percentile: float = 10.0, min_points: int = 3) -> DataFrame:
    """(series_id, n, slope, intercept): the line through the points of a return map nearest to the diagonal.

    Near means within the percentile of |y - x|, or among the ``min_points`` nearest where that gives fewer.
    """
    gap = points.withColumn("gap", F.abs(F.col("y") - F.col("x")))
    limit = percentile_of(gap, "gap", percentile, "limit")
    ranked = gap.join(limit, "series_id").withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy("gap", "k")))
    kept = ranked.filter((F.col("gap") <= F.col("limit")) | (F.col("r") <= min_points))
    return kept.groupBy("series_id").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def summary(signals: DataFrame, mask: DataFrame, min_tail: int = 10, channel_percentile: float = 10.0) -> DataFrame:
    """One row a series of a signal and its laminar mask: share and lengths of laminar runs, the power law of the lengths and its match
    against an exponential, reinjection, the bursts' power law, the symmetry of runs and the return map's tangent channel.

    What a series is too short for is null. No kind of intermittency is named.
    """
    runs = run_lengths(mask)
    lengths = runs.select(F.col("series_id").alias("run_id"), F.col("length").cast("double").alias("value"))
    bursts = burst_amplitudes(signals, mask)
    out = mask.groupBy("series_id").agg(F.avg(F.col("laminar").cast("double")).alias("laminar_share"))
    parts = [
        runs.groupBy("series_id").agg(F.count("*").alias("n_runs"), F.avg("length").alias("mean_length")),
        fit_power_law_discrete(lengths, min_tail).select(F.col("run_id").alias("series_id"), F.col("alpha").alias("length_alpha"), F.col("x_min").alias("length_x_min"), F.col("ks").alias("length_ks")),
        compare_power_law_exponential(lengths, min_tail, True).select(F.col("run_id").alias("series_id"), F.col("z").alias("length_z"), F.col("p").alias("length_p")),
        reinjection(signals, mask).select("series_id", F.col("slope").alias("reinjection_slope"), F.col("alpha").alias("reinjection_alpha")),
        fit_power_law(bursts, min_tail).select(F.col("run_id").alias("series_id"), F.col("alpha").alias("burst_alpha"), F.col("x_min").alias("burst_x_min")),
        laminar_burst_symmetry(mask).select("series_id", F.col("ks").alias("symmetry_ks"), F.col("p").alias("symmetry_p")),
        tangent_channel(extrema_return_map(signals), channel_percentile).select("series_id", F.col("slope").alias("channel_slope"), F.col("intercept").alias("channel_intercept")),
    ]
    for part in parts:
        out = out.join(part, "series_id", "left")
    return out
