"""Parameter sweeps and composites: a table of parameters is simulated and each run is reduced by the ordinary operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasespark.functions.maps import SYSTEMS
from phasespark.operators.correlation import band, log_curve, takens_theiler_dimension
from phasespark.operators.embedding import average_mutual_information, optimal_delay
from phasespark.operators.sections import is_map_like
from phasespark.sources.simulate import trajectories


def series_of(params: DataFrame, system: str, n: int, transient: int, coordinate: int = 0) -> DataFrame:
    """One coordinate of every row's trajectory as signals; series_id is the parameter row's number."""
    walk = trajectories(params, system, n, transient)
    return walk.select(F.col("param_id").cast("string").alias("series_id"), "t", F.col(f"p{coordinate}").alias("x"))


def sweep(params: DataFrame, system: str, n: int, transient: int, metric: Callable[[DataFrame], DataFrame], coordinate: int = 0) -> DataFrame:
    """The parameters beside what ``metric`` makes of each row's series."""
    found = metric(series_of(params, system, n, transient, coordinate)).withColumn("param_id", F.col("series_id").cast("long")).drop("series_id")
    return params.join(found, "param_id")


def escape_lengths(params: DataFrame, system: str, threshold: float, max_steps: int = 5000) -> DataFrame:
    """(param_id, length): steps until the state's size reaches ``threshold``; null if it never does within ``max_steps``.

    Columns x0.. of ``params`` are the reinjection points. Rows of a batch advance together, and those done drop out.
    """
    own = SYSTEMS[system]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            p = own.parameters({k: pdf[k].to_numpy() for k in pdf.columns}, m)
            s = [pdf[f"x{j}"].to_numpy(np.float64) if f"x{j}" in pdf else np.full(m, v) for j, v in enumerate(own.start)]
            length, at = np.full(m, -1), np.arange(m)
            for k in range(1, max_steps + 1):
                s = own.step(s, p)
                out = np.sqrt(sum(c * c for c in s)) >= threshold
                length[at[out]] = k
                s, at, p = [c[~out] for c in s], at[~out], {k: v[~out] for k, v in p.items()}
                if not len(at):
                    break
            steps = pd.Series(length, dtype="Int64").mask(length < 0)
            yield pd.DataFrame({"param_id": pdf["param_id"].to_numpy(), "length": steps})

    return params.mapInPandas(run, "param_id long, length long")


def escape_episodes(params: DataFrame, system: str, threshold: float, max_steps: int = 5000) -> DataFrame:
    """(series_id, t, x, laminar): the sizes of each row's states until they reach ``threshold``, row after row by param_id in one series,
    with a sample of 1.2 thresholds, not laminar, before the first row and after each."""
    inside = escape_lengths(params, system, threshold, max_steps).filter("length is not null").withColumnRenamed("length", "n")
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.orderBy("param_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = inside.withColumn("before", before)  # one row a reinjection
    runs = trajectories(params, system, max_steps, record_first=True, escape=threshold).join(F.broadcast(starts), "param_id").filter("t < n")
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in runs.columns if c[0] == "p" and c[1:].isdigit()), F.lit(0.0)))
    laminar = runs.select((F.col("before") + F.col("t") + 1).alias("t"), size.alias("x"), F.lit(True).alias("laminar"))
    ends = starts.select((F.col("before") + F.col("n") + 1).alias("t"), F.lit(1.2 * threshold).alias("x"), F.lit(False).alias("laminar"))
    first = params.sparkSession.range(1).select(F.col("id").alias("t"), F.lit(1.2 * threshold).alias("x"), F.lit(False).alias("laminar"))
    return laminar.unionByName(ends).unionByName(first).select(F.lit("0").alias("series_id"), F.col("t").cast("long").alias("t"), "x", "laminar")


def iterate_grid(spark, n: int, low: float, high: float, f: Callable, slope: Callable, times: int) -> DataFrame:
    """(x, y, slope): a map's iterate and its derivative, by the chain rule, on ``n`` points in equal steps."""
    rows = spark.range(n).select((F.lit(low) + F.lit(high - low) * F.col("id") / F.lit(float(n - 1))).alias("x"))
    rows = rows.select("x", F.col("x").alias("y"), F.lit(1.0).alias("slope"))
    for _ in range(times):
        rows = rows.select("x", f(F.col("y")).alias("y"), (F.col("slope") * slope(F.col("y"))).alias("slope"))
    return rows


def first_passage(runs: DataFrame, value: str, threshold: float) -> DataFrame:
    """(param_id, length): the first sample whose ``value`` is under the threshold in size, counted from 1; all samples if none is."""
    hit = F.min(F.when(F.abs(value) < threshold, F.col("t") + 1))
    return runs.groupBy("param_id").agg(F.coalesce(hit, F.count("*")).alias("length"))


def correlation_length(autocorrelation: DataFrame) -> DataFrame:
    """(run_id, crossing, decay): the lag where a normalised autocorrelation passes 1/e, between lags by a straight line; and the length
    of the exponential through the positive values before it."""
    e = float(np.exp(-1))
    by = Window.partitionBy("run_id").orderBy("lag")
    rows = autocorrelation.withColumn("before", F.lag("c").over(by))
    under = rows.filter((F.col("c") <= e) & (F.col("before") > e))
    at = under.groupBy("run_id").agg(F.min_by(F.col("lag") - 1 + (F.col("before") - e) / (F.col("before") - F.col("c")), "lag").alias("crossing"))
    head = autocorrelation.join(at, "run_id", "left").filter((F.col("c") > 0) & (F.col("lag") <= F.coalesce("crossing", "lag") + 1))
    fit = head.groupBy("run_id").agg(F.try_divide(F.lit(-1.0), F.regr_slope(F.log("c"), F.col("lag"))).alias("decay"))
    return fit.join(at, "run_id", "left").select("run_id", "crossing", "decay")


def even_sample(points: DataFrame, order: str, most: int, key: str = "series_id") -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced in ``order``, the first and the last among them."""
    by = Window.partitionBy(key)
    ranked = points.withColumn("_r", F.row_number().over(by.orderBy(order)) - 1).withColumn("_n", F.count("*").over(by))
    wanted = F.floor(F.col("_r") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    before = F.floor((F.col("_r") - 1) * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return ranked.filter((F.col("_n") <= most) | (F.col("_r") == 0) | (wanted > before)).drop("_r", "_n")


def cobweb(signals: DataFrame) -> DataFrame:
    """(series_id, t, x0, y0, x1, y1): the two segments of each step of a staircase between a curve and the diagonal."""
    nxt = F.lead("x").over(Window.partitionBy("series_id").orderBy("t"))
    rows = signals.select("series_id", "t", "x", nxt.alias("y")).filter("y is not null")
    up = F.struct(F.col("x").alias("x0"), F.col("x").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    over = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("y").alias("x1"), F.col("y").alias("y1"))
    return rows.select("series_id", "t", F.explode(F.array(up, over)).alias("s")).select("series_id", "t", "s.*")


def min_max_normalised(points: DataFrame, columns: list[str], key: str = "series_id") -> DataFrame:
    """Columns scaled to 0..1 within each key; a constant column becomes 0.5."""
    by = Window.partitionBy(key)
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(by), F.max(c).over(by) - F.min(c).over(by)), F.lit(0.5))
    return points.select(*[c for c in points.columns if c not in columns], *(unit(c).alias(c) for c in columns))


def robust_dimension(
    signals: DataFrame,
    m_values: tuple[int, ...] = (2, 3, 4, 5, 6),
    theiler: int = 0,
    n_r: int = 60,
    min_vectors: int = 500,
    slope_tol: float = 0.04,
    tau_max: int = 20,
    segments: int = 8,
    segment_m: int = 3,
    min_segment: int = 1000,
) -> DataFrame:
    """(series_id, tau, d_c, slope, saturated, label, sigma, segment_median, n_segments): Takens-Theiler dimensions over embedding
    dimensions, whether they settle, and how much they vary between segments.

    Series are z-scored. The delay is 1 for map-like series, else the first minimum of the mutual information. d_c is the mean over the
    embedding dimensions from their median on, slope that of a straight line there; fewer than three such dimensions take all, fewer than
    four in all don't settle. Embeddings of fewer than ``min_vectors`` vectors are left out. ``segments`` equal parts of a series are
    embedded in ``segment_m`` dimensions; under three usable ones, or parts shorter than ``min_segment``, give no sigma.

    All embedding dimensions and segments are series of one table, coordinates they lack being 0, so that one pass over pairs serves all.
    """
    by = Window.partitionBy("series_id")
    stats = signals.groupBy("series_id").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count("*").alias("n"))
    z = signals.join(stats, "series_id").select("series_id", "t", "n", F.coalesce(F.try_divide(F.col("x") - F.col("mean"), F.col("sd")), F.lit(0.0)).alias("x"))
    tau = optimal_delay(average_mutual_information(z.drop("n"), tau_max, 16)).join(is_map_like(z.drop("n")), "series_id").select("series_id", F.when(F.col("map_like"), 1).otherwise(F.col("tau")).alias("tau"))
    rows = z.join(tau, "series_id")
    part = F.least(F.floor(F.col("t") / F.floor(F.col("n") / segments)), F.lit(segments)).cast("int")
    whole = rows.select("series_id", "tau", F.lit(-1).alias("part"), "t", "x", F.array(*map(F.lit, m_values)).alias("ms"))
    cut = rows.filter(F.floor(F.col("n") / segments) >= min_segment).withColumn("part", part).filter(F.col("part") < segments)
    cut = cut.select("series_id", "tau", "part", "t", "x", F.array(F.lit(segment_m)).alias("ms"))
    top = max(*m_values, segment_m)
    later = F.collect_list("x").over(Window.partitionBy("series_id", "part").orderBy("t").rowsBetween(0, (top - 1) * tau_max))
    vectors = whole.unionByName(cut).withColumn("later", later).withColumn("m", F.explode("ms")).filter(F.size("later") > (F.col("m") - 1) * F.col("tau"))
    name = F.concat_ws("/", F.col("m").cast("string"), F.col("part").cast("string"), F.col("series_id"))
    coordinate = lambda j: F.when(F.col("m") > j, F.get("later", j * F.col("tau"))).otherwise(F.lit(0.0))
    points = vectors.select(name.alias("series_id"), "t", *(coordinate(j).alias(f"p{j}") for j in range(top)))
    enough = points.groupBy("series_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_vectors).select("series_id")
    found = takens_theiler_dimension(log_curve(points.join(enough, "series_id", "left_semi"), n_r, theiler))
    pieces = F.split("series_id", "/", 3)
    curve = found.select(pieces[0].cast("int").alias("m"), pieces[1].cast("int").alias("part"), pieces[2].alias("series_id"), F.col("d_tt").alias("d"))
    full = curve.filter("part < 0").withColumns({"middle": F.percentile("m", 0.5).over(by), "k": F.count("*").over(by)}).withColumn("upper", (F.col("m") >= F.col("middle")) & (F.col("k") >= 4))
    full = full.withColumn("few", F.sum(F.col("upper").cast("int")).over(by) < 3).filter("upper or few")
    fit = full.groupBy("series_id").agg(F.avg("d").alias("d_c"), F.regr_slope("d", "m").alias("slope"), F.max("k").alias("k"))
    spread = curve.filter("part >= 0").groupBy("series_id").agg(F.stddev_pop("d").alias("sigma"), F.percentile("d", 0.5).alias("segment_median"), F.count("*").alias("n_segments")).filter("n_segments >= 3")
    settled = F.coalesce((F.col("k") >= 4) & (F.abs("slope") < slope_tol), F.lit(False))
    out = tau.join(fit, "series_id", "left").join(spread, "series_id", "left").withColumn("saturated", settled)
    slope = F.when(F.col("k") >= 4, F.col("slope")).alias("slope")
    return out.select("series_id", "tau", "d_c", slope, "saturated", band(F.col("d_c"), F.col("saturated")).alias("label"), "sigma", "segment_median", F.coalesce("n_segments", F.lit(0)).alias("n_segments"))
