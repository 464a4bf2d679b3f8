"""Ordinal patterns over signals that arrive numbered and in order: the last samples of a series are its state.

Rows with times that may come late are for ``streaming.signals``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "series_id string, t long, lehmer int"


def lehmer(window: np.ndarray) -> int:
    """The Lehmer code of the stable argsort."""
    order = np.argsort(window, kind="stable")
    code = 0
    for r in range(len(order)):
        code = code * (len(order) - r) + int((order[r + 1 :] < order[r]).sum())
    return code


def lehmer_codes(windows: np.ndarray) -> np.ndarray:
    """The Lehmer codes of many windows, a row each."""
    order = np.argsort(windows, axis=1, kind="stable")
    code = np.zeros(len(windows), dtype=np.int64)
    for r in range(order.shape[1]):
        code = code * (order.shape[1] - r) + (order[:, r + 1 :] < order[:, r : r + 1]).sum(axis=1)
    return code


def patterns(stream: DataFrame, d: int = 3, tau: int = 1) -> DataFrame:
    """(series_id, t, lehmer) of a stream (series_id, t, x) that arrives in time order within each series.

    The state of a series is its last (d - 1) tau samples, so it is bounded. A window is named by its first sample.
    """
    keep = (d - 1) * tau

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_x = state.get if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values("t")
        t, x = np.r_[np.asarray(last_t, np.int64), rows["t"].to_numpy(np.int64)], np.r_[np.asarray(last_x, np.float64), rows["x"].to_numpy(np.float64)]
        n = max(0, len(x) - keep)
        codes = lehmer_codes(np.stack([x[k * tau : k * tau + n] for k in range(d)], axis=1))
        state.update((t[max(0, len(t) - keep) :].tolist(), x[max(0, len(x) - keep) :].tolist()))
        yield pd.DataFrame({"series_id": key[0], "t": t[:n], "lehmer": codes.astype(np.int32)})

    return stream.groupBy("series_id").applyInPandasWithState(step, OUTPUT, "t array<long>, x array<double>", "append", GroupStateTimeout.NoTimeout)
