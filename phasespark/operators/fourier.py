"""Discrete Fourier transforms of series of any length.

A series of up to ``WHOLE`` samples is one array and one call of numpy, many series to a batch. A longer one of n = n1 n2 samples is split in
four steps: transforms over the n1 samples that are n2 apart, turns by the twiddle factors, an exchange, and transforms over the n2 results
that belong together; no task holds more than n1 or n2 of them. Lengths without such factors go by Bluestein's chirps: a convolution over
a power of two, which has them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = 1 << 16
ROWS = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]))


def arrays(lists: pa.Array) -> list[np.ndarray]:
    """The lists of a column."""
    values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _listed(at: list[np.ndarray], values: list[np.ndarray]) -> pa.Array:
    """Rows of (i, re, im), one list for each array."""
    whole = np.concatenate(values) if values else np.empty(0, complex)
    rows = pa.StructArray.from_arrays([pa.array(np.concatenate(at) if at else [], pa.int64()), pa.array(whole.real), pa.array(whole.imag)], names=["i", "re", "im"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values])], pa.int32()), rows)


@F.arrow_udf(ROWS)
def _whole(re: pa.Array, im: pa.Array) -> pa.Array:
    found = [np.fft.fft(a + 1j * b) for a, b in zip(arrays(re), arrays(im), strict=True)]
    return _listed([np.arange(len(v)) for v in found], found)


@F.arrow_udf(ROWS)
def _first_half(re: pa.Array, im: pa.Array, place: pa.Array, n: pa.Array) -> pa.Array:
    """Transforms over samples that are n2 apart from ``place`` on, turned by the twiddle factors."""
    found = []
    for a, b, at, size in zip(arrays(re), arrays(im), place.to_pylist(), n.to_pylist(), strict=True):
        k = np.arange(len(a), dtype=np.int64)
        found.append(np.fft.fft(a + 1j * b) * np.exp(-2j * np.pi * ((k * at) % size) / size))
    return _listed([np.arange(len(v)) for v in found], found)


@F.arrow_udf(T.LongType())
def _factor(n: pa.Array, whole: pa.Array) -> pa.Array:
    """The factor of n nearest to its root, if both factors are at most ``whole``; 0 without one."""
    out = []
    for size, most in zip(n.to_pylist(), whole.to_pylist(), strict=True):
        own = next((a for a in range(math.isqrt(size), 0, -1) if size % a == 0), 1)
        out.append(own if size // own <= most else 0)
    return pa.array(out, pa.int64())


def _gathered(rows: DataFrame, keys: list[str], at: str, *kept: str) -> DataFrame:
    own = rows.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("_i"), "re", "im"))).alias("_own"), *(F.first(c).alias(c) for c in kept))
    return own.select(*keys, *kept, F.col("_own.re").alias("re"), F.col("_own.im").alias("im"))


def _split(rows: DataFrame) -> DataFrame:
    """(series_id, n, n1, t, re, im), t then being the frequency: transforms of series of n = n1 n2 samples."""
    n2 = F.expr("n div n1")
    columns = _gathered(rows.withColumns({"_b": F.col("t") % n2, "_a": F.expr("t div (n div n1)")}), ["series_id", "_b"], "_a", "n", "n1")
    half = columns.select("series_id", "n", "n1", "_b", F.inline(_first_half("re", "im", "_b", "n")))
    lines = _gathered(half, ["series_id", "i"], "_b", "n", "n1").withColumnRenamed("i", "_k")
    found = lines.select("series_id", "n", "n1", "_k", F.inline(_whole("re", "im")))
    return found.select("series_id", "n", "n1", (F.col("_k") + F.col("n1") * F.col("i")).alias("t"), "re", "im")


def _times(re: Column, im: Column, angle: Column) -> list[Column]:
    """A complex number turned by an angle."""
    return [(re * F.cos(angle) - im * F.sin(angle)).alias("re"), (re * F.sin(angle) + im * F.cos(angle)).alias("im")]


def _chirped(rows: DataFrame) -> DataFrame:
    """As ``_split``, for any n: Bluestein's convolution with a chirp, over a power of two m of at least 2 n - 1."""
    size = F.expr("shiftleft(1L, int(ceil(log2(2 * n - 1))))")
    root = F.expr("shiftleft(1L, int(ceil(log2(2 * n - 1))) div 2)")
    turn = lambda t: F.pi() * F.expr(f"({t} * {t}) % (2 * n)") / F.col("n")
    series = rows.select("series_id", "n").distinct()
    inner = lambda df: df.select("series_id", size.alias("n"), root.alias("n1"), "t", "re", "im")
    held = _split(_filled(inner(rows.select("series_id", "n", "t", *_times(F.col("re"), F.col("im"), -turn("t"))))))
    ends = series.withColumn("m", size).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    ends = ends.select("series_id", "n", F.explode(F.array_distinct(F.array(F.struct("t", F.col("t").alias("u")), F.struct((F.pmod(-F.col("t"), F.col("m"))).alias("t"), F.col("t").alias("u"))))).alias("e"))
    ends = ends.select("series_id", "n", F.col("e.t").alias("t"), F.col("e.u").alias("u"))
    chirp = _split(_filled(inner(ends.select("series_id", "n", "t", *_times(F.lit(1.0), F.lit(0.0), turn("u"))))))
    held = held.alias("a").join(chirp.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("series_id", "t")])
    x = {f"{s}{c}": F.col(f"{s}.{c}") for s in "ab" for c in ("re", "im")}
    # the inverse transform as that of the conjugate
    product = held.select("a.series_id", "a.n", "a.n1", "a.t", (x["are"] * x["bre"] - x["aim"] * x["bim"]).alias("re"), (-(x["are"] * x["bim"] + x["aim"] * x["bre"])).alias("im"))
    back = _split(product).withColumnRenamed("n", "m").join(series, "series_id").filter("t < n")
    return back.select("series_id", "n", F.lit(0).cast("long").alias("n1"), "t", *_times(F.col("re") / F.col("m"), -F.col("im") / F.col("m"), -turn("t")))


def _filled(rows: DataFrame) -> DataFrame:
    """With a row of 0 for every missing t below n."""
    whole = rows.groupBy("series_id").agg(F.first("n").alias("n"), F.first("n1").alias("n1")).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return whole.join(rows.select("series_id", "t", "re", "im"), ["series_id", "t"], "left").select("series_id", "n", "n1", "t", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))


def transform(signals: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(series_id, n, k, re, im): the discrete Fourier transform of each series (series_id, t, re, im or x), at its n frequencies.

    t counts samples from 0 without gaps. Series of over ``whole`` samples are split.
    """
    rows = signals if "re" in signals.columns else signals.withColumnsRenamed({"x": "re"}).withColumn("im", F.lit(0.0))
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    rows = rows.select("series_id", "t", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im")).join(sizes, "series_id")
    short = _gathered(rows.filter(F.col("n") <= whole), ["series_id"], "t", "n").select("series_id", "n", F.inline(_whole("re", "im")))
    long = rows.filter(F.col("n") > whole).join(sizes.filter(F.col("n") > whole).withColumn("n1", _factor("n", F.lit(whole).cast("long"))).drop("n"), "series_id")
    kept = lambda df: df.select("series_id", "n", F.col("t").alias("k"), "re", "im")
    return short.withColumnRenamed("i", "k").unionByName(kept(_split(long.filter("n1 > 0")))).unionByName(kept(_chirped(long.filter("n1 = 0").drop("n1"))))
