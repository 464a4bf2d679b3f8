"""Template-matching entropies as kernels over tiles of pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasespark.operators.embedding import embed, lagged
from phasespark.operators.tiles import BLOCK, Tile, each, tiles
from phasespark.sources.shared import settled


def tolerance(signals: DataFrame, share: float, r: float | None) -> DataFrame:
    """(series_id, n, r): r as given, else ``share`` of the sample standard deviation."""
    own = F.lit(float(r)) if r is not None else share * F.stddev_samp("x")
    return signals.groupBy("series_id").agg(F.count("*").alias("n"), own.alias("r"))


def _matches(points: DataFrame, r_of: DataFrame, m: int, block: int) -> DataFrame:
    """(series_id, a, b): pairs of templates strictly within r over m + 1 and over m samples, for series (series_id, n, r). Pairs out of r are
    mostly never met."""

    def kernel(tile: Tile) -> dict[str, np.ndarray]:
        r = tile.limits["r"]
        r = np.nan if r is None else r
        short = np.zeros((len(tile.ta), len(tile.tb)), dtype=bool)
        short[tile.once()] = True
        short &= tile.distances("chebyshev", m) < r
        return {"a": [np.count_nonzero(short & (tile.gaps(m) < r))], "b": [np.count_nonzero(short)]}

    longest = r_of.agg(F.max("n")).first()[0] or 0
    found = each(tiles(points, r_of.select("series_id", "r"), "r", block, longest), kernel, "a long, b long")
    return found.groupBy("series_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _entropy(m: int) -> Column:
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(F.col("a").isNull() | (F.col("n") - m < 2), inf).when(F.col("b") == 0, nan).when(F.col("a") == 0, inf).otherwise(-F.log(F.try_divide("a", "b")))


def sample_entropy(signals: DataFrame, m: int = 2, r: float | None = None, share: float = 0.2, block: int = BLOCK) -> DataFrame:
    """(series_id, entropy): -ln(A/B) over the templates of m + 1, strictly within r in the largest gap.

    No match of m: NaN; none of m + 1, or fewer than two templates: infinite.
    """
    if m < 1:
        raise ValueError("m must be at least 1")
    r_of, points = settled(tolerance(signals, share, r)), embed(signals, m + 1, 1)
    return r_of.join(_matches(points, r_of, m, block), "series_id", "left").select("series_id", _entropy(m).alias("entropy"))


def approximate_entropy(signals: DataFrame, m: int = 2, r: float | None = None, block: int = BLOCK) -> DataFrame:
    """(series_id, entropy): phi(m) - phi(m + 1), matches within or at r, each template matching itself. One pass serves both lengths."""
    if m < 1:
        raise ValueError("m must be at least 1")
    r_of = tolerance(signals, 0.2, r)
    points = lagged(signals, list(range(m + 1)), whole=False)
    points = points.filter(~F.isnan(f"p{m - 1}"))  # the last template of m has no further sample: NaN, which matches nothing

    def kernel(tile: Tile) -> dict[str, np.ndarray]:
        r = tile.limits["r"]
        r = np.nan if r is None else r
        short = tile.distances("chebyshev", m) <= r
        if tile.same:
            np.fill_diagonal(short, False)
        long = short & (tile.gaps(m) <= r)
        sides = ((tile.ta, 1),) if tile.same else ((tile.ta, 1), (tile.tb, 0))
        return {"t": np.concatenate([t for t, _ in sides]), "short": np.concatenate([short.sum(axis=x) for _, x in sides]), "long": np.concatenate([long.sum(axis=x) for _, x in sides])}

    counts = each(tiles(points, r_of.select("series_id", "n", "r"), block=block), kernel, "t long, short long, long long")
    rows = counts.groupBy("series_id", "t").agg(F.sum("short").alias("short"), F.sum("long").alias("long")).join(r_of.select("series_id", "n"), "series_id")
    k = F.col("n") - (m - 1)
    phi = [F.avg(F.log((F.col("short") + 1) / k)), F.avg(F.when(F.col("t") < k - 1, F.log(F.try_divide(F.col("long") + 1, k - 1))))]
    return rows.groupBy("series_id").agg(phi[0].alias("phi"), phi[1].alias("next")).filter("next is not null").select("series_id", (F.col("phi") - F.col("next")).alias("entropy"))


def fuzzy_entropy(signals: DataFrame, m: int = 2, r: float | None = None, exponent: float = 2.0, block: int = BLOCK) -> DataFrame:
    """(series_id, entropy): ln of the ratio of summed memberships of m and of m + 1, over the same templates; the exponent is real.

    The membership of two templates is exp(-(gap / r)^exponent), each about its own mean.
    """
    if m < 2:
        raise ValueError("m must be at least 2: a centred template of one sample is always 0")
    r_of = tolerance(signals, 0.2, r)

    def kernel(tile: Tile) -> dict[str, np.ndarray]:
        r, once, out = tile.limits["r"], tile.once(), {}
        for name, width in (("b", m), ("a", m + 1)):
            centred = [[p - sum(side[1:width], side[0]) / width for p in side[:width]] for side in (tile.a, tile.b)]
            gap = Tile(tile.ta, centred[0], tile.tb, centred[1], tile.same, {}).distances("chebyshev")[once]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[name] = [np.exp(-((gap / (np.nan if r is None else r)) ** exponent)).sum()]
        return out

    own = r_of.filter(F.col("n") - m > 1).select("series_id", "r")  # two templates at least
    found = each(tiles(embed(signals, m + 1, 1), own, block=block), kernel, "b double, a double")
    sums = found.groupBy("series_id").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    return sums.select("series_id", F.when((F.col("a") > 0) & (F.col("b") > 0), -F.log(F.try_divide("a", "b"))).otherwise(F.lit(float("nan"))).alias("entropy"))


def multiscale_entropy(signals: DataFrame, scales: list[int] | None = None, m: int = 2, r: float | None = None) -> DataFrame:
    """(series_id, scale, entropy): sample entropy of means of ``scale`` samples, with 0.15 deviations of the unscaled series throughout."""
    scales = list(scales or range(1, 21))
    r_of = tolerance(signals, 0.15, r)
    cut = signals.join(r_of.select("series_id", "n"), "series_id").select("series_id", "t", "x", "n", F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    cut = cut.withColumn("k", F.floor(F.col("t") / F.col("scale"))).filter((F.col("k") + 1) * F.col("scale") <= F.col("n"))
    coarse = cut.groupBy("series_id", "scale", "k").agg(F.avg("x").alias("x"))
    keyed = coarse.select(F.concat_ws("\x1f", "series_id", F.col("scale").cast("string")).alias("key"), "series_id", "scale", "k", "x")
    ids = keyed.select("key", "series_id", "scale").distinct().join(r_of.select("series_id", "r"), "series_id")
    coarse_n = keyed.groupBy("key").agg(F.count("*").alias("n"))
    points = embed(keyed.select(F.col("key").alias("series_id"), F.col("k").alias("t"), "x"), m + 1, 1)
    ids = settled(ids.join(coarse_n, "key"))
    hits = _matches(points, ids.select(F.col("key").alias("series_id"), "n", "r"), m, BLOCK).withColumnRenamed("series_id", "key")
    return ids.join(hits, "key", "left").select("series_id", "scale", _entropy(m).alias("entropy"))
