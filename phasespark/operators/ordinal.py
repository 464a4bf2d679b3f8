"""Ordinal patterns and what is derived from their distribution."""

from __future__ import annotations

from math import factorial, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasespark.operators.embedding import embed


def patterns(signals: DataFrame, d: int = 5, tau: int = 1) -> DataFrame:
    """(series_id, t, lehmer): the Lehmer code of each window's argsort, earlier samples first among equal ones.

    The code's digit for the k-th smallest sample is the number of later-ranked samples that stand before it; it is built from pairwise
    comparisons of columns, so the whole operator is one window and one generated projection.
    """
    if not 2 <= d <= 10:
        raise ValueError("d must be 2..10")
    points = embed(signals, d, tau)
    p = [F.col(f"p{j}") for j in range(d)]
    less = lambda i, j: (p[i] < p[j]) if i > j else (p[i] <= p[j])  # noqa: E731  sample i ranks before sample j
    code = None
    for i in range(d):
        rank = sum((F.when(less(j, i), 1).otherwise(0) for j in range(d) if j != i), F.lit(0))
        digit = sum((F.when(less(i, j), 1).otherwise(0) for j in range(i)), F.lit(0))  # earlier samples that rank later
        weight = F.element_at(F.array(*[F.lit(factorial(d - 1 - r)) for r in range(d)]), rank + 1)
        code = digit * weight if code is None else code + digit * weight
    return points.select("series_id", "t", code.cast("int").alias("lehmer"))


def order_of(lehmer: Column, d: int) -> Column:
    """The places of a window's values in ascending order, from its Lehmer code; null for what is no code of d values.

    Each digit counts among the places that are left.
    """
    if not 2 <= d <= 12:
        raise ValueError("d lies from 2 to 12")
    weights = F.array(*(F.lit(factorial(d - 1 - r)) for r in range(d)))
    none, all_ = F.array().cast("array<int>"), F.array(*map(F.lit, range(d)))

    def step(acc: Column, r: Column) -> Column:
        digit = F.pmod(F.floor(lehmer / F.get(weights, r)), F.lit(d) - r).cast("int")
        one = F.get(acc["left"], digit)
        return F.struct(F.filter(acc["left"], lambda p: p != one).alias("left"), F.concat(acc["out"], F.array(one)).alias("out"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.struct(all_.alias("left"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(lehmer.between(0, factorial(d) - 1), out)


def distribution(signals: DataFrame, d: int = 5, tau: int = 1) -> DataFrame:
    """(series_id, lehmer, n, p)."""
    counts = patterns(signals, d, tau).groupBy("series_id", "lehmer").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("series_id"))  # a join would make every pattern twice in one task
    return counts.select("series_id", "lehmer", "n", (F.col("n") / total).alias("p"))


def permutation_entropy(signals: DataFrame, d: int = 5, tau: int = 1, normalise: bool = True) -> DataFrame:
    """(series_id, entropy): Shannon entropy of the patterns in nats, over ln d! if normalised."""
    scale = log(factorial(d)) if normalise else 1.0
    return distribution(signals, d, tau).groupBy("series_id").agg((-F.sum(F.col("p") * F.log("p")) / scale).alias("entropy"))


def complexity_entropy(signals: DataFrame, d: int = 5, tau: int = 1) -> DataFrame:
    """(series_id, entropy, complexity): normalised entropy, and the Jensen-Shannon divergence from uniform times it.

    The d! - k patterns never seen add the same closed term each, so they are never rows.
    """
    n = factorial(d)
    u = 1.0 / n
    m = (F.col("p") + u) / 2
    terms = distribution(signals, d, tau).groupBy("series_id").agg(
        (-F.sum(F.col("p") * F.log("p"))).alias("h"),
        F.sum(F.col("p") * F.log(F.col("p") / m) / 2 + u * F.log(u / m) / 2).alias("js"),
        F.count("*").alias("k"),
    )
    js = F.col("js") + (n - F.col("k")) * (u * log(2) / 2)
    most = -0.5 * ((n + 1) / n * log(n + 1) - 2 * log(2 * n) + log(n))
    return terms.select("series_id", (F.col("h") / log(n)).alias("entropy"), (js / most * F.col("h") / log(n)).alias("complexity"))


def entropy_sweep(signals: DataFrame, d_values: tuple[int, ...] = (3, 4, 5, 6, 7), tau: int = 1) -> DataFrame:
    """(series_id, d, entropy) for several pattern lengths."""
    out = None
    for d in d_values:
        row = permutation_entropy(signals, d, tau).withColumn("d", F.lit(d))
        out = row if out is None else out.unionByName(row)
    return out
