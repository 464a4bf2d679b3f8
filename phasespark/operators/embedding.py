"""Delay embedding, mutual information and neighbour-based choice of delay and dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasespark.operators.tiles import BLOCK, Tile, check_metric, each, tiles


#: Samples of a time block.
SPAN = 1 << 16


def in_time_blocks(signals: DataFrame, before: int = 0, after: int = 0, span: int = SPAN) -> DataFrame:
    """signals with ``_block`` and ``_own``: consecutive stretches of a series, each with copies (not its own) of the ``before`` samples
    before and the ``after`` samples after it. Windows within a block then need no other, and one long series is spread over many tasks.

    t has to count the samples of a series without gaps.
    """
    span = max(span, before, after)
    at, place = F.floor(F.col("t") / span), F.col("t") % span
    copies = F.array(F.when(place < after, at - 1), at, F.when(place >= span - before, at + 1))
    out = signals.withColumn("_block", F.explode(F.filter(copies, lambda b: b >= 0)))
    return out.withColumn("_own", F.col("_block") == at)


def in_block():
    """The window of a time block in time order."""
    return Window.partitionBy("series_id", "_block").orderBy("t")


def consecutive(cells: DataFrame, line: list[str], flags: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """(line..., start, length, flags...) of the runs of consecutive t within each line; a flag is true if it is anywhere in the run.

    Runs are found within time blocks; only those that touch the edge of a block are looked at again, by series, and joined: at most two a
    block.
    """
    cut = cells.select(*line, "t", F.floor(F.col("t") / span).alias("_block"), *flags)
    island = F.col("t") - F.row_number().over(Window.partitionBy(*line, "_block").orderBy("t"))
    ends = lambda first, last: [F.min(first).alias("start"), F.max(last).alias("_end"), *(F.max(f).alias(f) for f in flags)]
    pieces = cut.withColumn("_i", island).groupBy(*line, "_block", "_i").agg(*ends("t", "t"))
    edge = (F.col("start") % span == 0) | ((F.col("_end") + 1) % span == 0)
    by = Window.partitionBy(*line).orderBy("start")
    new = F.coalesce((F.col("start") != F.lag("_end").over(by) + 1).cast("int"), F.lit(1))
    joined = pieces.filter(edge).withColumn("_new", new).withColumn("_i", F.sum("_new").over(by)).groupBy(*line, "_i").agg(*ends("start", "_end"))
    found = pieces.filter(~edge).drop("_block", "_i").unionByName(joined.drop("_i"))
    return found.select(*line, "start", (F.col("_end") - F.col("start") + 1).alias("length"), *flags)


def lagged(signals: DataFrame, lags: list[int], whole: bool = True, span: int = SPAN) -> DataFrame:
    """signals with columns p0, p1, ... of the values ``lags`` later. Rows without all of them are dropped, or have NaN there if not ``whole``.

    One shuffle, by time blocks with the samples of the longest lag after them.
    """
    if not lags:
        raise ValueError("no lags")
    ahead = in_time_blocks(signals.select("series_id", "t", "x"), after=max(lags), span=span)
    out = ahead.select("series_id", "t", "_own", *(F.lead("x", lag).over(in_block()).alias(f"p{j}") if lag else F.col("x").alias(f"p{j}") for j, lag in enumerate(lags)))
    last = max(range(len(lags)), key=lambda j: lags[j])
    out = out.filter("_own").drop("_own")
    return out.filter(F.col(f"p{last}").isNotNull()) if whole else out.fillna(float("nan"), [f"p{j}" for j in range(len(lags))])


def embed(signals: DataFrame, d: int, tau: int) -> DataFrame:
    """Delay vectors (series_id, t, p0..p{d-1})."""
    if d < 1 or tau < 1:
        raise ValueError("d and tau must be at least 1")
    return lagged(signals, [j * tau for j in range(d)])


def average_mutual_information(signals: DataFrame, tau_max: int = 100, n_bins: int = 64, span: int = SPAN) -> DataFrame:
    """(series_id, tau, ami) in nats, from a joint histogram over equal bins of the series' range. Constant or too short series: 0.

    A time block with the ``tau_max`` samples after it is one array, whose pairs of bins are counted for all delays in numpy.
    """
    ends = signals.groupBy("series_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") + 1e-10 * (F.col("hi") - F.col("lo"))) - F.col("lo")
    own = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width * n_bins), F.lit(n_bins - 1))).otherwise(0)
    rows = in_time_blocks(signals.join(ends, "series_id").select("series_id", "t", own.cast("int").alias("b")), after=tau_max, span=span)
    blocks = rows.groupBy("series_id", "_block").agg(F.sort_array(F.collect_list(F.struct("t", "b"))).alias("a"), F.sum(F.col("_own").cast("int")).alias("n"))
    blocks = blocks.select("series_id", F.col("a.b").alias("b"), "n")

    def count(batches):
        for batch in batches:
            values, offsets = np.asarray(batch.column("b").values), np.asarray(batch.column("b").offsets)
            row, out = [], []
            for i, n in enumerate(batch.column("n").to_pylist()):
                b = values[offsets[i] : offsets[i + 1]].astype(np.int64)
                for tau in range(1, min(tau_max, len(b) - 1) + 1):
                    c = np.bincount(b[:n][: len(b) - tau] * n_bins + b[tau : tau + n], minlength=n_bins * n_bins)
                    used = np.flatnonzero(c)
                    out.append(np.stack([np.full(len(used), tau), used // n_bins, used % n_bins, c[used]]))
                    row.append(np.full(len(used), i))
            found = np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)
            series = batch.column("series_id").take(pa.array(np.concatenate(row) if row else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([series, *(pa.array(c, k) for c, k in zip(found, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True))], names=["series_id", "tau", "b", "later", "c"])

    kind = signals.schema["series_id"].dataType.simpleString()
    joint = blocks.mapInArrow(count, f"series_id {kind}, tau int, b int, later int, c long").groupBy("series_id", "tau", "b", "later").agg(F.sum("c").alias("c"))
    by = Window.partitionBy("series_id", "tau")
    n = F.sum("c").over(by)
    mine, theirs = F.sum("c").over(Window.partitionBy("series_id", "tau", "b")), F.sum("c").over(Window.partitionBy("series_id", "tau", "later"))
    terms = joint.select("series_id", "tau", (F.col("c") / n * F.log(F.col("c") * n / (mine * theirs))).alias("term"))
    found = terms.groupBy("series_id", "tau").agg(F.sum("term").alias("ami"))
    grid = ends.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(tau_max))).alias("tau"))
    return grid.join(found, ["series_id", "tau"], "left").select("series_id", "tau", F.greatest(F.coalesce("ami", F.lit(0.0)), F.lit(0.0)).alias("ami"))


def optimal_delay(ami: DataFrame) -> DataFrame:
    """(series_id, tau): the first local minimum of the mutual information, else 1."""
    by = Window.partitionBy("series_id").orderBy("tau")
    low = ami.withColumn("low", (F.col("ami") < F.lag("ami").over(by)) & (F.col("ami") <= F.lead("ami").over(by)))
    return low.groupBy("series_id").agg(F.coalesce(F.min(F.when(F.col("low"), F.col("tau"))), F.lit(1)).alias("tau"))


def nearest(signals: DataFrame, d_max: int, tau: int, theiler: int, metric: str, block: int = BLOCK) -> DataFrame:
    """(series_id, d, t, dist, gap) for d = 1..d_max: the distance of each delay vector to its nearest one among those that go on for another
    coordinate, and how far apart the two are in that. Ties: the earliest neighbour.

    One pass over the tiles serves all dimensions: distances grow coordinate by coordinate. A tile gives each of its points its nearest in
    the tile, the least of them is the nearest in the series.
    """
    if d_max < 1 or tau < 1:
        raise ValueError("d_max and tau must be at least 1")
    check_metric(metric)
    points = lagged(signals, [j * tau for j in range(d_max + 1)], whole=False)

    def kernel(tile: Tile) -> dict[str, np.ndarray]:
        apart = np.abs(tile.tb[None, :] - tile.ta[:, None]) > theiler
        out, so_far = [], None
        for d in range(1, d_max + 1):
            gap = tile.gaps(d - 1)
            gap = gap if metric == "chebyshev" else gap * gap
            so_far = gap if so_far is None else np.maximum(so_far, gap) if metric == "chebyshev" else so_far + gap
            dist = np.sqrt(so_far) if metric == "euclidean" else so_far
            here, there = ~np.isnan(tile.a[d]), ~np.isnan(tile.b[d])  # those that have the next coordinate
            dist = np.where(apart & here[:, None] & there[None, :], dist, np.inf)
            for times, mine, others, other_times, m in ((tile.ta, tile.a[d], tile.b[d], tile.tb, dist), (tile.tb, tile.b[d], tile.a[d], tile.ta, dist.T))[: 1 if tile.same else 2]:
                if m.size:
                    best = m.argmin(axis=1)
                    value = m[np.arange(len(best)), best]
                    ok = np.isfinite(value)
                    out.append((np.full(ok.sum(), d), times[ok], value[ok], other_times[best[ok]], np.abs(mine[ok] - others[best[ok]])))
        names = ("d", "t", "dist", "other", "gap")
        return {n: np.concatenate([o[j] for o in out]) if out else np.empty(0) for j, n in enumerate(names)}

    if metric not in ("chebyshev", "euclidean"):
        raise ValueError("the metric is chebyshev or euclidean")
    found = each(tiles(points, block=block), kernel, "d int, t long, dist double, other long, gap double")
    return found.groupBy("series_id", "d", "t").agg(F.min(F.struct("dist", "other", "gap")).alias("b")).select("series_id", "d", "t", "b.dist", "b.gap")


def cao(signals: DataFrame, tau: int, d_max: int = 15, theiler: int = 0) -> DataFrame:
    """(series_id, d, e1, e2) for d = 1..d_max-1: ratios of mean growths to the nearest Chebyshev neighbour; a zero distance counts 1."""
    further = F.greatest("dist", "gap")
    levels = nearest(signals, d_max, tau, theiler, "chebyshev").groupBy("series_id", "d").agg(
        F.avg(F.when(F.col("dist") > 0, F.try_divide(further, F.col("dist"))).otherwise(1.0)).alias("e"), F.avg("gap").alias("s")
    )
    by = Window.partitionBy("series_id").orderBy("d")
    out = levels.select("series_id", "d", F.try_divide(F.lead("e").over(by), F.col("e")).alias("e1"), F.try_divide(F.lead("s").over(by), F.col("s")).alias("e2"))
    return out.filter(F.col("d") < d_max)


def false_nearest_neighbors(signals: DataFrame, tau: int, d_max: int = 15, r_tol: float = 15.0, a_tol: float = 2.0, theiler: int = 0) -> DataFrame:
    """(series_id, d, f1, f2, f3): shares of neighbours that are false by distance growth, by size against the series, and by either."""
    sigma = signals.groupBy("series_id").agg(F.stddev_pop("x").alias("sigma"))
    n = nearest(signals, d_max, tau, theiler, "euclidean").join(sigma, "series_id").filter("dist > 0")
    grows = F.col("gap") > r_tol * F.col("dist")
    far = F.sqrt(F.col("dist") * F.col("dist") + F.col("gap") * F.col("gap")) > a_tol * F.col("sigma")
    share = lambda c: F.avg(c.cast("double"))
    return n.groupBy("series_id", "d").agg(share(grows).alias("f1"), share(far).alias("f2"), share(grows | far).alias("f3"))


def smoothed(rows: DataFrame, value: str, window: int) -> DataFrame:
    """``value`` as the centred mean of ``window`` neighbours by d, the ends repeated outwards; a window of 1 or less changes nothing."""
    if window <= 1:
        return rows
    left = window // 2
    by = Window.partitionBy("series_id")
    inner = by.orderBy("d").rowsBetween(-left, window - 1 - left)
    place, n = F.row_number().over(by.orderBy("d")) - 1, F.count("*").over(by)
    ends = F.min_by(value, "d").over(by) * F.greatest(F.lit(left) - place, F.lit(0)) + F.max_by(value, "d").over(by) * F.greatest(place + window - left - n, F.lit(0))
    return rows.withColumn(value, (F.sum(value).over(inner) + ends) / window)


def select_dimension_cao(
    e1: DataFrame, lower: float = 0.95, upper: float = 1.05, tol: float = 0.02, span: int = 3, min_dim: int = 2, window: int = 1, max_dim: int | None = None
) -> DataFrame:
    """(series_id, dimension) from curves (series_id, d, e1), d from 1: the onset of the first plateau of ``span`` values between ``lower``
    and ``upper`` that range over 1.5 ``tol`` at most or step by ``tol`` at most; else the first value over ``lower``; else the d whose value
    is nearest to 1; else one more than the last d. It is kept between ``min_dim`` and ``max_dim``."""
    span, lower, upper = max(2, span), min(lower, upper), max(lower, upper)
    rows = smoothed(e1, "e1", window).withColumn("e1", F.when(F.isnan("e1") | (F.abs("e1") == float("inf")), None).otherwise(F.col("e1")))
    order = Window.partitionBy("series_id").orderBy("d")
    ahead = order.rowsBetween(0, span - 1)
    rows = rows.withColumn("step", F.abs(F.lead("e1").over(order) - F.col("e1")))
    whole = rows.withColumns({"n": F.count("e1").over(ahead), "lo": F.min("e1").over(ahead), "hi": F.max("e1").over(ahead), "jump": F.max("step").over(order.rowsBetween(0, span - 2))})
    flat = (F.col("n") == span) & (F.col("lo") >= lower) & (F.col("hi") <= upper) & ((F.col("hi") - F.col("lo") <= 1.5 * tol) | (F.col("jump") <= tol))
    allowed = (F.col("d") >= min_dim) & F.col("e1").isNotNull()
    onset = F.min(F.when(flat & allowed, F.col("d")))
    over = F.min(F.when(allowed & (F.col("e1") >= lower), F.col("d")))
    nearest = F.min_by(F.when(allowed, F.col("d")), F.when(allowed, F.struct(F.abs(F.col("e1") - 1.0), F.col("d"))))
    found = whole.groupBy("series_id").agg(F.coalesce(onset, over, nearest, F.max("d") + 1).alias("found"), (F.max("d") + 1).alias("last"))
    most = F.col("last") if max_dim is None else F.lit(max_dim)
    return found.select("series_id", F.greatest(F.least("found", most), F.lit(min_dim)).cast("int").alias("dimension"))


def optimal_dimension(signals: DataFrame, tau: int, d_max: int = 15, method: str = "cao", theiler: int = 0) -> DataFrame:
    """(series_id, dimension): by the plateau of Cao's ratios (cao), their first value over 0.95 (cao_legacy) or the first share of false
    neighbours under 0.01 (fnn); ``d_max`` if the last two find none."""
    if d_max < (1 if method == "fnn" else 2):
        raise ValueError("d_max is too small")
    if method == "cao":
        return select_dimension_cao(cao(signals, tau, d_max, theiler).select("series_id", "d", "e1"), min_dim=2, max_dim=d_max)
    if method not in ("cao_legacy", "fnn"):
        raise ValueError(f"unknown method {method}")
    rows, good = (cao(signals, tau, d_max, theiler), F.col("e1") > 0.95) if method == "cao_legacy" else (false_nearest_neighbors(signals, tau, d_max, theiler=theiler), F.col("f3") < 0.01)
    return rows.groupBy("series_id").agg(F.coalesce(F.min(F.when(good, F.col("d"))), F.lit(d_max)).cast("int").alias("dimension"))
