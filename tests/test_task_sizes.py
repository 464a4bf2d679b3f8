"""What a task holds doesn't grow with the table."""

from pyspark.sql import functions as F

from phasespark.operators import intermittency, ordinal, recurrence
from phasespark.sources import signals


def test_series_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(signals, "SAMPLES", 10)
    rows = spark.range(400).select((F.col("id") % 50).alias("s"), "id", F.col("id").cast("double").alias("x"))
    found = signals.as_signals(rows, F.col("s"), [F.col("id")], F.col("x"))
    assert found.rdd.getNumPartitions() == 40
    assert sorted((r["series_id"], r["t"], r["x"]) for r in found.collect()) == sorted((str(s), t, float(s + 50 * t)) for s in range(50) for t in range(8))


def test_patterns_are_made_once(spark, capsys):
    rows = spark.range(40).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), (F.col("id") * 7 % 11).cast("double").alias("x"))
    found = ordinal.distribution(rows, 3)
    found.explain()
    assert "Join" not in capsys.readouterr().out
    assert sum(r["p"] for r in found.collect()) == 1


def test_short_series_send_no_counts(spark, monkeypatch):
    rows = [(str(s), t, float((t * 37 + s * 11) % 101) + 0.01 * t) for s in range(20) for t in range(2 + 3 * s)]
    points = spark.createDataFrame(rows, "series_id string, t long, p0 double")
    passes, each = [], recurrence.each
    monkeypatch.setattr(recurrence, "each", lambda tiles, kernel, schema: passes.append(schema) or each(tiles, kernel, schema))
    eps = lambda block: {r["series_id"]: r["eps"] for r in recurrence.thresholds(points, 10, block=block).collect()}
    short = eps(64)  # one row a series, instead of one for each bin of its distances
    assert passes == ["n long, a double, b double"]
    assert short == eps(8) and len(short) == 20
    assert any("bin" in schema for schema in passes)


def test_short_series_send_no_pairs(spark, monkeypatch):
    rows = [(str(s), t, float((t * 37 + s * 11) % 23)) for s in range(3) for t in range(1 + 7 * s) if t % 9 != 4]  # with gaps in t, one series alone
    points = spark.createDataFrame(rows, "series_id string, t long, p0 double")
    found = lambda block: [sorted(map(tuple, f(points, v_min, percentile=30, theiler=theiler, block=block).collect())) for f in (recurrence.laminar_lengths, intermittency.laminar_by_recurrence) for v_min, theiler in ((1, 2), (2, 0))]
    by_tiles = found(8)
    monkeypatch.setattr(recurrence, "recurrences", lambda *_, **__: 1 / 0)
    assert found(64) == by_tiles
