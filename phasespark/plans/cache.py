"""Tables computed once: read if they hold the required columns, else computed and written; with a timing ledger."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def status(spark: SparkSession, path: str, required: Iterable[str] = ()) -> str:
    """missing, malformed, missing_keys, empty or ok."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        return "missing" if "PATH_NOT_FOUND" in str(e) else "malformed"
    except Exception:
        return "malformed"
    if not set(required) <= set(found.columns):
        return "missing_keys"
    return "empty" if found.isEmpty() else "ok"


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], required: Iterable[str] = (), ledger: str | None = None) -> DataFrame:
    """The table at ``path``. KeyError if what was computed lacks a required column; ``ledger`` gets a JSON line a call."""
    required, began = list(required), time.time()
    state = status(spark, path, required)
    if state != "ok":
        df = compute()
        if lacking := [c for c in required if c not in df.columns]:
            raise KeyError(f"{path} lacks {lacking}")
        df.write.mode("overwrite").parquet(path)
    if ledger:
        with open(ledger, "a", encoding="utf-8") as f:
            f.write(json.dumps({"path": path, "cache_state": "warm" if state == "ok" else "cold", "wall_time_s": time.time() - began}) + "\n")
    return spark.read.parquet(path)
