"""Level-crossing sections, decimation and other operations on whole series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasespark.operators import fourier
from phasespark.operators.embedding import SPAN, consecutive, in_block, in_time_blocks


def crossings(signals: DataFrame, fs: float = 1.0, direction: str = "up", delay: int = 1) -> DataFrame:
    """(series_id, k, time, u, v): crossings of the series' mean, in seconds by linear interpolation, with the value ``delay`` and twice
    ``delay`` samples later, interpolated likewise.

    direction: up, down or both. A crossing lies between two samples, the first at or under the mean (up) and the second over it.
    """
    s = in_time_blocks(centred(signals), after=2 * delay + 1)
    nxt = lambda c, k=1: F.lead(c, k).over(in_block())
    rows = s.select("series_id", "t", "_own", F.col("c").alias("s"), nxt("c").alias("s1"), *(nxt("x", k * delay + j).alias(f"x{k}{j}") for k in (1, 2) for j in (0, 1)))
    rows = rows.filter("_own")
    up, down = (F.col("s") <= 0) & (F.col("s1") > 0), (F.col("s") >= 0) & (F.col("s1") < 0)
    hit = {"up": up, "down": down, "both": up | down}[direction]
    a = F.col("s") / (F.col("s") - F.col("s1"))
    at = lambda k: F.col(f"x{k}0") + a * (F.col(f"x{k}1") - F.col(f"x{k}0"))
    found = rows.filter(hit).select("series_id", ((F.col("t") + a) / fs).alias("time"), at(1).alias("u"), at(2).alias("v"))
    order = Window.partitionBy("series_id").orderBy("time")
    return found.select("series_id", (F.row_number().over(order) - 1).cast("long").alias("k"), "time", "u", "v")


def centred(signals: DataFrame) -> DataFrame:
    """signals with c, the deviation from the mean of the series: an aggregate and a join, no window over a whole series."""
    mean = signals.groupBy("series_id").agg(F.avg("x").alias("_mean"))
    return signals.select("series_id", "t", "x").join(mean, "series_id").select("series_id", "t", "x", (F.col("x") - F.col("_mean")).alias("c"))


def _gradient(c: str) -> Column:
    """Central differences by time step, one-sided at the ends; within a time block, where two more samples stand at either end."""
    nxt, last = F.lead(c).over(in_block()), F.lag(c).over(in_block())
    return F.coalesce((nxt - last) / 2, nxt - F.col(c), F.col(c) - last)


def section(signals: DataFrame, fs: float = 1.0, delay: int | None = None, level: float | None = None, direction: str = "up", interpolation: bool = True) -> DataFrame:
    """(series_id, k, time, value, d1, d2, past, future): crossings of ``level`` (else the series' mean) with three planes' coordinates:
    value and first derivative, first and second derivative, and the samples ``delay`` before and after (null beyond the series).

    direction: up, down or both. Without ``interpolation`` a crossing stands at the sample before it. Without ``delay`` it is that of
    ``auto_delay``. Samples within 1e-12 of the level count as on it; series of fewer than three samples have no crossings.
    """
    if fs <= 0 or direction not in ("up", "down", "both"):
        raise ValueError("fs must be positive and direction up, down or both")
    stats = signals.groupBy("series_id").agg(F.avg("x").alias("mean"), F.count("*").alias("n")).filter("n >= 3")
    stats = stats.join(auto_delay(signals, 64), "series_id") if not delay or delay <= 0 else stats.withColumn("delay", F.lit(delay))
    rows = signals.join(stats, "series_id").withColumn("s", F.col("x") - (F.col("mean") if level is None else F.lit(float(level))))
    dt = 1.0 / fs
    rows = in_time_blocks(rows, before=3, after=4).withColumn("d1", _gradient("x") / dt).withColumn("d2", _gradient("d1") / dt)
    rows = rows.withColumns({f"{c}_next": F.lead(c).over(in_block()) for c in ("s", "x", "d1", "d2")}).filter("_own")
    tiny = 1e-12
    up, down = (F.col("s") <= tiny) & (F.col("s_next") > tiny), (F.col("s") >= -tiny) & (F.col("s_next") < -tiny)
    hit = rows.filter({"up": up, "down": down, "both": up | down}[direction])
    if interpolation:
        hit = hit.filter(F.abs(F.col("s_next") - F.col("s")) > tiny)
    a = -F.col("s") / (F.col("s_next") - F.col("s")) if interpolation else F.lit(0.0)
    at = lambda c: F.col(c) + a * (F.col(f"{c}_next") - F.col(c))
    found = hit.select("series_id", "t", ((F.col("t") + a) / fs).alias("time"), at("x").alias("value"), at("d1").alias("d1"), at("d2").alias("d2"), "n", "delay")
    sample = lambda name: signals.select("series_id", F.col("t").alias("at"), F.col("x").alias(name))
    both = (F.col("t") >= F.col("delay")) & (F.col("t") + F.col("delay") < F.col("n"))
    found = found.withColumn("at", F.when(both, F.col("t") - F.col("delay"))).join(sample("past"), ["series_id", "at"], "left")
    found = found.withColumn("at", F.when(both, F.col("t") + F.col("delay"))).join(sample("future"), ["series_id", "at"], "left")
    k = (F.row_number().over(Window.partitionBy("series_id").orderBy("time")) - 1).cast("long")
    return found.select("series_id", k.alias("k"), "time", "value", "d1", "d2", "past", "future")


def spectral_peak_ratio(signals: DataFrame) -> DataFrame:
    """(series_id, ratio): the largest Fourier amplitude over the second largest; null for under four samples or a constant."""
    n = signals.groupBy("series_id").agg(F.count("*").alias("n"))
    # the two largest of parts of the spectrum first, so that a long one isn't sorted in one task
    part, whole = Window.partitionBy("series_id", "part").orderBy(F.desc("power"), "k"), Window.partitionBy("series_id").orderBy(F.desc("power"), "k")
    ranked = spectrum(signals).withColumn("part", F.col("k") % 64).withColumn("r", F.row_number().over(part)).filter("r <= 2").withColumn("r", F.row_number().over(whole))
    top = ranked.groupBy("series_id").agg(F.max(F.when(F.col("r") == 1, F.col("power"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("power"))).alias("b"))
    ratio = F.when((F.col("n") >= 4) & (F.col("a") > 0), F.when(F.col("b") > 0, F.sqrt(F.col("a") / F.col("b"))).otherwise(float("inf")))
    return n.join(top, "series_id", "left").select("series_id", ratio.alias("ratio"))


def dominant_period(signals: DataFrame) -> DataFrame:
    """(series_id, period): samples a turn of the strongest frequency, at least 1. The highest frequency of an even series has no mirror
    image and counts half."""
    n = signals.groupBy("series_id").agg(F.count("*").alias("n"))
    rows = n.join(spectrum(signals), "series_id", "left")
    power = F.when(F.col("k") * 2 == F.col("n"), F.col("power") / 2).otherwise(F.col("power"))
    best = rows.groupBy("series_id", "n").agg(F.min_by("k", F.struct(-F.coalesce(power, F.lit(0.0)), F.col("k"))).alias("k"))
    return best.select("series_id", F.greatest(F.coalesce(F.bround(F.col("n") / F.col("k")), F.lit(1)), F.lit(1)).cast("long").alias("period"))


# The labels of a section's regularity, and the bounds of variation and spectral ratio between them.
QUALITY = (("highly_periodic", 0.05, 5.0), ("periodic", 0.2, 3.0), ("quasi_periodic", 0.6, 1.5))


def section_quality(found: DataFrame, signals: DataFrame) -> DataFrame:
    """(series_id, n, mean_period, cv, ratio, label) for every series: variation of the intervals between crossings, spectral ratio and what
    both say. Fewer than three crossings: insufficient_data, and no figures."""
    gap = found.withColumn("gap", F.col("time") - F.lag("time").over(Window.partitionBy("series_id").orderBy("k")))
    stats = gap.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    rows = signals.select("series_id").distinct().join(stats, "series_id", "left").join(spectral_peak_ratio(signals), "series_id", "left")
    few = F.coalesce(F.col("n") < 3, F.lit(True))
    rows = rows.withColumn("cv", F.when(~few & (F.col("mean") > 0), F.col("sd") / F.col("mean"))).withColumn("ratio", F.when(~few, F.col("ratio")))
    label = F.when(few, "insufficient_data").when(F.col("cv").isNull() | F.col("ratio").isNull(), "indeterminate")
    for name, most, least in QUALITY:
        label = label.when((F.col("cv") < most) & (F.col("ratio") >= least), name)
    return rows.select("series_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(~few, F.col("mean")).alias("mean_period"), "cv", "ratio", label.otherwise("chaotic").alias("label"))


def autocovariance(signals: DataFrame, max_lag: int, span: int = SPAN) -> DataFrame:
    """(series_id, lag, acov): unbiased, for lags 0..max_lag. A time block with the ``max_lag`` samples after it is one array; its products
    are summed in numpy, many lags by a transform."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def products(c: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for x, own in zip(fourier.arrays(c), n.to_pylist(), strict=True):
            lags = min(max_lag, len(x) - 1) + 1
            if lags <= 64:
                sums = [float(x[:own][: len(x) - k] @ x[k : k + own]) for k in range(lags)]
            else:
                size = 1 << (len(x) + own).bit_length()
                sums = np.fft.irfft(np.conj(np.fft.rfft(x[:own], size)) * np.fft.rfft(x, size), size)[:lags].tolist()
            out.append(sums)
        return pa.array(out, pa.list_(pa.float64()))

    rows = in_time_blocks(centred(signals), after=max_lag, span=span)
    blocks = rows.groupBy("series_id", "_block").agg(F.sort_array(F.collect_list(F.struct("t", "c"))).alias("b"), F.sum(F.col("_own").cast("int")).alias("n"))
    terms = blocks.select("series_id", "n", F.size("b").alias("m"), F.posexplode(products(F.col("b.c"), F.col("n"))).alias("lag", "s"))
    terms = terms.groupBy("series_id", "lag").agg(F.sum("s").alias("s"), F.sum(F.least("n", F.col("m") - F.col("lag"))).alias("k"))
    return terms.select("series_id", "lag", (F.col("s") / F.col("k")).alias("acov"))


def auto_delay(signals: DataFrame, max_lag: int = 64) -> DataFrame:
    """(series_id, delay): the first strict local minimum of the autocorrelation (sums, not means) within a quarter of the series and
    ``max_lag``, else a tenth of the series, at least 1; 1 for under four samples."""
    by = Window.partitionBy("series_id").orderBy("lag")
    n = signals.groupBy("series_id").agg(F.count("*").alias("n"))
    sums = autocovariance(signals, max_lag + 1).join(n, "series_id").withColumn("sum", F.col("acov") * (F.col("n") - F.col("lag")))
    low = sums.withColumn("low", (F.col("sum") < F.lag("sum").over(by)) & (F.col("sum") < F.lead("sum").over(by)))
    limit = F.greatest(F.floor(F.col("n") / 4), F.lit(3)) - 1
    first = low.filter((F.col("lag") < limit) & (F.col("n") >= 4)).groupBy("series_id").agg(F.min(F.when(F.col("low"), F.col("lag"))).alias("lag"))
    tenth = F.when(F.col("n") < 4, F.lit(1)).otherwise(F.greatest(F.floor(F.col("n") / 10), F.lit(1)))
    return n.join(first, "series_id", "left").select("series_id", F.coalesce("lag", tenth).cast("long").alias("delay"))


def spectrum(signals: DataFrame, max_frequency: int | None = None) -> DataFrame:
    """(series_id, k, power): discrete Fourier power at frequencies 1..max_frequency cycles a series, or all up to half a cycle a sample."""
    found = fourier.transform(centred(signals).select("series_id", "t", F.col("c").alias("x"))).filter("k > 0 and k * 2 <= n")
    found = found if max_frequency is None else found.filter(F.col("k") <= max_frequency)
    return found.select("series_id", F.col("k").cast("int").alias("k"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def is_map_like(signals: DataFrame) -> DataFrame:
    """(series_id, map_like): lag-1 autocorrelation under 0.2 in absolute value."""
    c = in_time_blocks(centred(signals), after=1).withColumn("d", F.lead("c").over(in_block())).filter("_own")
    r = F.try_divide(F.sum(F.col("c") * F.col("d")), F.sum(F.col("c") * F.col("c")))
    return c.groupBy("series_id").agg(F.coalesce(F.abs(r) < 0.2, F.lit(False)).alias("map_like"))


def decimate_stride(signals: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th sample."""
    return signals.filter(F.col("t") % step == 0)


def decimate_min_max(signals: DataFrame, bin_size: int) -> DataFrame:
    """The samples with the smallest and the largest value of each bin of ``bin_size``, earliest first among equal ones."""
    bins = signals.groupBy("series_id", F.floor(F.col("t") / bin_size).alias("bin")).agg(
        F.min_by(F.struct("t", "x"), F.struct("x", "t")).alias("lo"), F.max_by(F.struct("t", "x"), F.struct("x", -F.col("t"))).alias("hi")
    )
    return bins.select("series_id", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("p")).select("series_id", "p.t", "p.x")


def sustained(signals: DataFrame, threshold: float = 0.02, min_run: int = 4, span: int = SPAN) -> DataFrame:
    """(series_id, t, sustained): samples in runs of at least ``min_run`` values over the threshold.

    A sample is in such a run if ``min_run`` values over the threshold stand around it: no run is looked at further.
    """
    min_run = max(1, min_run)
    rows = in_time_blocks(signals.select("series_id", "t", "x"), before=min_run - 1, after=min_run - 1, span=span)
    starts = F.min((F.col("x") > threshold).cast("int")).over(in_block().rowsBetween(0, min_run - 1)) + F.when(F.count("*").over(in_block().rowsBetween(0, min_run - 1)) == min_run, 0)
    rows = rows.withColumn("_full", F.coalesce(starts, F.lit(0)))
    inside = F.max("_full").over(in_block().rowsBetween(1 - min_run, 0)) == 1
    return rows.withColumn("sustained", inside).filter("_own").select("series_id", "t", "sustained")


def longest_plateau(signals: DataFrame, target: float, tol: float) -> DataFrame:
    """(series_id, start, length) of the longest run of values within ``tol`` of the target; the first of equal ones."""
    found = consecutive(signals.filter(F.abs(F.col("x") - target) <= tol), ["series_id"])
    best = found.groupBy("series_id").agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("b"))
    return best.select("series_id", "b.start", "b.length")


def cluster_labels(states: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(run_id, t, site, label): sites whose sorted values lie within ``tol`` of a neighbour share a label."""
    by = Window.partitionBy("run_id", "t").orderBy("x", "site")
    new = F.coalesce((F.col("x") - F.lag("x").over(by) > tol).cast("int"), F.lit(0))
    return states.withColumn("new", new).select("run_id", "t", "site", F.sum("new").over(by).alias("label"))


def nearest_parameter(queries: DataFrame, grid: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """(p, q, value): for each p of ``queries`` the row of ``grid`` (q, value) with the nearest q; the smaller of two equally near.

    Both are cut into ranges of about ``range_rows`` keys. Within a range the last lower and the next higher q come from windows; only the
    ends of the ranges go to the driver, to fill in for ranges that hold no such q. A null p takes the smallest q; null q are left out.
    """
    rows = grid.groupBy("q").agg(F.min("value").alias("value")).select(F.col("q").cast("double").alias("x"), F.when(F.col("q").isNotNull(), F.struct("q", "value")).alias("g"))
    kind = rows.schema["g"].dataType
    keys = queries.select("p").distinct().withColumn("x", F.coalesce(F.col("p").cast("double"), F.lit(float("-inf"))))
    both = rows.join(keys.withColumn("asked", F.lit(True)), "x", "full").select("x", "p", "g", "asked")
    ranges = max(1, -(-both.count() // range_rows))
    cuts = both.approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("x"))) if cuts else F.lit(0)
    both = both.withColumn("range", place)
    ends = both.groupBy("range").agg(F.min("g").alias("first"), F.max("g").alias("last")).collect()
    ends = {r["range"]: r for r in ends if r["first"] is not None}
    below, above = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for k in range(1, len(cuts) + 1):
        below[k] = ends[k - 1]["last"] if k - 1 in ends else below[k - 1]
        above[-1 - k] = ends[len(cuts) + 1 - k]["first"] if len(cuts) + 1 - k in ends else above[-k]
    held = T.StructType([T.StructField(name, t, True) for name, t in (("range", T.IntegerType()), ("below", kind), ("above", kind))])
    beside = queries.sparkSession.createDataFrame([(k, below[k], above[k]) for k in range(len(cuts) + 1)], held)
    last = lambda x: F.last("g", ignorenulls=True).over(Window.partitionBy("range").orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("lo", last(F.col("x"))).withColumn("hi", last(F.col("x").desc())).filter("asked")
    both = both.join(F.broadcast(beside), "range").withColumn("lo", F.coalesce("lo", "below")).withColumn("hi", F.coalesce("hi", "above"))
    lower = F.col("hi").isNull() | (F.col("p") - F.col("lo.q") <= F.col("hi.q") - F.col("p"))
    near = both.select(F.col("p").alias("_p"), F.when(lower, F.col("lo")).otherwise(F.col("hi")).alias("n"))
    return queries.join(near, F.col("p").eqNullSafe(F.col("_p")), "left").select("p", "n.q", "n.value")
