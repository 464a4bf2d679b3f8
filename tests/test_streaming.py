"""Streams in bits, out of order, against the batch operators over the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasespark.operators import intermittency, ordinal, recurrence
from phasespark.operators.embedding import embed
from phasespark.sources.signals import as_signals
from phasespark.streaming import signals as streaming
from phasespark.streaming.ordinal import lehmer, lehmer_codes

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("series_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("x"))
    return rows.filter("cast(series_id as int) % 3 = 0").collect()


def played(spark, tmp_path, events, operator):
    """The rows of ``operator`` over ``events`` that come in five files, each later than the last but mixed with it, and a last row to end all."""
    rng = random.Random(1)
    span = (max(e["ts"] for e in events) - min(e["ts"] for e in events)).total_seconds()
    first = min(e["ts"] for e in events)
    bits = [[] for _ in range(5)]
    for e in rng.sample(events, len(events)):
        at = (e["ts"] - first).total_seconds() / span * 4
        bits[min(4, int(at + rng.random()))].append(e)  # up to a quarter of the span too late
    schema = "series_id string, ts timestamp, seq long, x double"
    last = max(e["ts"] for e in events).replace(year=2090)
    for bit in [*bits, [("end", last, 0, 0.0)], [("end", last, 1, 0.0)]]:
        spark.createDataFrame(bit, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", f"{int(span / 3) + 1} seconds")
        query = operator(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        batches = [p["numInputRows"] for p in query.recentProgress]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sum(b > 0 for b in batches) >= 5
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("series_id <> 'end'").collect())


@pytest.fixture(scope="module")
def batch(spark, events):
    rows = spark.createDataFrame(events, "series_id string, ts timestamp, seq long, x double")
    return as_signals(rows, F.col("series_id"), [F.col("ts"), F.col("seq")], F.col("x")).cache()


def test_patterns_are_those_of_the_batch(spark, tmp_path, events, batch):
    got = played(spark, tmp_path, events, lambda s: streaming.patterns(s, 3, 2))
    assert got == sorted(tuple(r) for r in ordinal.patterns(batch, 3, 2).collect()) and got


def test_laminar_runs_are_those_of_the_batch(spark, tmp_path, events, batch):
    eps = float(np.median([e["x"] for e in events]))
    got = played(spark, tmp_path, events, lambda s: streaming.laminar_runs(s, 2, eps))
    by = intermittency.in_time_blocks(batch, before=2).withColumn("gap", F.abs(F.col("x") - F.lag("x", 2).over(intermittency.in_block()))).filter("_own")
    mask = by.select("series_id", "t", F.coalesce(F.col("gap") <= eps, F.lit(False)).alias("laminar"))
    want = intermittency.run_lengths(mask, drop_final_censored=True).select("series_id", "start", "length")
    assert got == sorted(tuple(r) for r in want.collect()) and got


def test_recurrence_counts_are_those_of_the_batch(spark, tmp_path, events, batch):
    got = played(spark, tmp_path, events, lambda s: streaming.recurrence_counts(s, 20.0, 7, 2, 1))
    points = embed(batch, 2, 1)
    near = recurrence.recurrences(points, 20.0, "chebyshev").filter("j - i <= 7").groupBy("series_id", F.col("j").alias("t")).agg(F.count("*").alias("n"))
    want = points.select("series_id", "t").join(near, ["series_id", "t"], "left").fillna(0)
    assert got == sorted(tuple(r) for r in want.collect()) and got


def test_lehmer_codes_of_many_windows():
    w = np.round(np.random.default_rng(0).normal(size=(50, 5)), 0)
    assert lehmer_codes(w).tolist() == [lehmer(r) for r in w]


@pytest.mark.parametrize("cuts", [[5], [1, 2, 3, 40], []])
def test_state_is_all_that_a_run_needs(cuts):
    """Advancing bit by bit gives the same runs as all at once."""
    x = np.round(np.random.default_rng(3).normal(size=60), 0)

    class Stream:
        columns = ["series_id"]

    found = {}
    real, streaming._run = streaming._run, lambda stream, advance, reach, schema, numbers=0: found.update(advance=advance, reach=reach, n=numbers)
    try:
        streaming.laminar_runs(Stream, 3, 0.0)
    finally:
        streaming._run = real
    out, t, tail, numbers = [], 0, np.empty(0), [0] * found["n"]
    for part in np.split(x, cuts):
        rows, numbers = found["advance"](t, tail, numbers, part)
        out += rows
        t, tail = t + len(part), np.r_[tail, part][-found["reach"] :]
    near = [t >= 3 and x[t] == x[t - 3] for t in range(60)]
    want, start = [], None
    for i, m in enumerate(near):
        if m and start is None:
            start = i
        if not m and start is not None:
            want.append((start, i - start))
            start = None
    assert out == want
