"""The sweep of permutation entropy takes every pattern length of the reference, 3 to 7."""

from collections import Counter, defaultdict
from math import factorial, log

import pyarrow.parquet as pq
import pytest

from phasespark.operators import ordinal
from phasespark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def entropy(x, d):
    counts = Counter(tuple(sorted(range(d), key=lambda j: (x[i + j], j))) for i in range(len(x) - d + 1))
    shares = [n / sum(counts.values()) for n in counts.values()]
    return -sum(p * log(p) for p in shares) / log(factorial(d))


def test_query_sweeps_all_lengths(spark):
    series = defaultdict(list)
    for e in sorted(pq.read_table(f"{SF}/events.parquet").to_pylist(), key=lambda e: (e["ts"], e["event_id"])):
        if e["value"] is not None:
            series[str(e["user_id"])].append(e["value"])
    want = {(s, d): entropy(x, d) for s, x in series.items() for d in (3, 4, 5, 6, 7) if len(x) >= d}
    found = QUERIES["permutation_entropy_sweep"](spark, SF).collect()
    assert len(found) == len(want)
    assert {(r["series_id"], r["d"]): r["entropy"] for r in found} == pytest.approx(want, abs=1e-6)


def test_short_and_constant_series(spark):
    values = {"short": [3.0, 1.0, 2.0, 2.0, 5.0], "constant": [1.0] * 9, "ties": [float(t * 5 % 7 // 2) for t in range(40)]}
    rows = spark.createDataFrame([(s, t, v) for s, x in values.items() for t, v in enumerate(x)], "series_id string, t long, x double")
    want = {(s, d): entropy(x, d) for s, x in values.items() for d in (3, 4, 5, 6, 7) if len(x) >= d}
    found = {(r["series_id"], r["d"]): r["entropy"] for r in ordinal.entropy_sweep(rows).collect()}
    assert found == pytest.approx(want)
    assert sorted(d for s, d in found if s == "short") == [3, 4, 5]
