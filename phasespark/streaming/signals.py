"""Operators over unbounded signals: rows arrive late and out of order, and leave in the order of their times, each once.

A stream (series_id, ts, seq, x) has a watermark on ts; seq orders rows of one time. A series' rows wait in its state until the watermark has
passed them, so that the windows of an operator are those of the whole series in time order, and equal to the batch operator's. Rows behind
the watermark are dropped, as everywhere in Structured Streaming. The state of a series is what waits, the last samples that windows reach
back to, and a few numbers.

The processors need a state store with timers: ``spark.sql.streaming.stateStore.providerClass`` has to be the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from phasespark.streaming.ordinal import lehmer_codes

#: What an operator makes of new samples: (place of the first, samples before it, numbers kept, new samples) -> (rows, numbers kept).
Advance = Callable[[int, np.ndarray, list[int], np.ndarray], tuple[list[tuple], list[int]]]


class InOrder(StatefulProcessor):
    """Hands a series' samples to ``advance`` in time order, with the ``reach`` samples before them."""

    def __init__(self, advance: Advance, reach: int, columns: list[str], numbers: int = 0):
        self.advance, self.reach, self.columns, self.numbers = advance, reach, columns, numbers

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, seq long, x double")
        self.kept = handle.getValueState("kept", "t long, tail array<double>, numbers array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        us = new["us"].to_numpy(np.int64)
        fresh = us // 1000 > timerValues.getCurrentWatermarkInMs()
        for u, s, x in zip(us[fresh].tolist(), new["seq"].to_numpy()[fresh].tolist(), new["x"].to_numpy()[fresh].tolist(), strict=True):
            self.waiting.appendValue((u, s, x))
        if fresh.any():
            self.handle.registerTimer(int(us[fresh].min() // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        ready, later = [r for r in rows if r[0] // 1000 <= passed], [tuple(r) for r in rows if r[0] // 1000 > passed]
        if not ready:
            return
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(later[0][0] // 1000))
        else:
            self.waiting.clear()
        t, tail, numbers = self.kept.get() if self.kept.exists() else (0, [], [0] * self.numbers)
        tail, x = np.asarray(tail, np.float64), np.array([r[2] for r in ready], np.float64)
        out, numbers = self.advance(int(t), tail, [int(n) for n in numbers], x)
        whole = np.r_[tail, x]
        self.kept.update((int(t) + len(x), whole[max(0, len(whole) - self.reach) :].tolist(), numbers))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["series_id", *self.columns])

    def close(self) -> None:
        pass


def _run(stream: DataFrame, advance: Advance, reach: int, schema: str, numbers: int = 0) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = stream.filter("ts is not null and x is not null").select("series_id", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"))
    processor = InOrder(advance, reach, columns, numbers)
    return rows.groupBy("series_id").transformWithStateInPandas(processor, f"series_id {stream.schema['series_id'].dataType.simpleString()}, {schema}", "Append", "EventTime")


def patterns(stream: DataFrame, d: int = 3, tau: int = 1) -> DataFrame:
    """(series_id, t, lehmer) as ``operators.ordinal.patterns``: a window is named by its first sample and leaves with its last."""
    reach = (d - 1) * tau
    if d < 2 or tau < 1:
        raise ValueError("d must be at least 2 and tau at least 1")

    def advance(t: int, tail: np.ndarray, numbers: list[int], x: np.ndarray) -> tuple[list[tuple], list[int]]:
        whole = np.r_[tail, x]
        n = len(whole) - reach
        if n <= 0:
            return [], numbers
        codes = lehmer_codes(np.stack([whole[k * tau : k * tau + n] for k in range(d)], axis=1))
        first = t - len(tail)
        return [(first + i, int(c)) for i, c in enumerate(codes)], numbers

    return _run(stream, advance, reach, "t long, lehmer int")


def laminar_runs(stream: DataFrame, period: int, eps: float) -> DataFrame:
    """(series_id, start, length) of the runs of samples within ``eps`` of the sample ``period`` before; a run leaves when it has ended."""
    if period < 1 or not eps >= 0:
        raise ValueError("period must be at least 1 and eps not negative")

    def advance(t: int, tail: np.ndarray, numbers: list[int], x: np.ndarray) -> tuple[list[tuple], list[int]]:
        whole = np.r_[tail, x]
        near = np.zeros(len(x), dtype=bool)
        known = min(len(x), max(0, len(whole) - period))  # the last samples, that have one a period before
        if known:
            near[len(x) - known :] = np.abs(whole[len(whole) - known :] - whole[len(whole) - known - period : len(whole) - period]) <= eps
        start, length = numbers
        edges = np.flatnonzero(np.diff(np.r_[length > 0, near].astype(np.int8)))
        out = []
        for e in edges.tolist():  # one step a run, not a sample
            if length:
                out.append((start, t + e - start))
                length = 0
            else:
                start, length = t + e, 1
        return out, [start, length]

    return _run(stream, advance, period, "start long, length long", 2)


def recurrence_counts(stream: DataFrame, eps: float, horizon: int, d: int = 1, tau: int = 1) -> DataFrame:
    """(series_id, t, n): for each delay vector, how many of the ``horizon`` before it lie at or under ``eps`` in the largest coordinate."""
    reach = (d - 1) * tau
    if d < 1 or tau < 1 or horizon < 1 or not eps >= 0:
        raise ValueError("d, tau and horizon must be at least 1 and eps not negative")

    def advance(t: int, tail: np.ndarray, numbers: list[int], x: np.ndarray) -> tuple[list[tuple], list[int]]:
        whole = np.r_[tail, x]
        n = len(whole) - reach
        first = t - len(tail)
        new = max(0, n - max(0, len(tail) - reach))  # vectors that end in a new sample
        if n <= 0:
            return [], numbers
        p = np.stack([whole[k * tau : k * tau + n] for k in range(d)], axis=1)
        count = np.zeros(n, dtype=np.int64)
        for lag in range(1, min(horizon, n - 1) + 1):
            count[lag:] += np.abs(p[lag:] - p[:-lag]).max(axis=1) <= eps
        return [(first + i, int(count[i])) for i in range(n - new, n)], numbers

    return _run(stream, advance, reach + horizon, "t long, n long")
