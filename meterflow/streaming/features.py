"""Lags, rolling statistics and forward fill in a stream, with state that does not grow with the series.

A row waits in the state of its series until the watermark has passed it, as rows may come late and in any
order by up to ``late``. A timer at the earliest waiting row then closes all rows that the watermark has
passed: they are put in order, and their features come from themselves and a ring of as many rows before
them as the longest lag or window asks for. The state of a series is the waiting rows (bounded by ``late``),
the ring, the last known values and the time up to which rows are closed. What is emitted never changes and
equals ``windows.add_lags``, ``windows.add_rolling`` and ``windows.fill_forward`` over the same rows.

NULL and NaN are missing. Rows that come after their time was closed are left out, as the watermark says.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import LAGS, ROLLS, STATISTICS

#: Rows whose windows are laid out at a time.
STEP = 4096


def names(columns: Sequence[str], lags: Sequence[int], rolls: Sequence[int]) -> list[str]:
    """The new columns, in order."""
    out = [f"{c}_filled" for c in columns]
    out += [f"{c}_lag_{k}h" for c in columns for k in lags]
    return out + [f"{c}_rolling_{s}_{n}h" for c in columns for n in rolls for s in STATISTICS]


def filled(values: np.ndarray, last: float) -> np.ndarray:
    """Forward fill, beginning with ``last``."""
    both = np.r_[last, values]
    at = np.maximum.accumulate(np.where(np.isnan(both), 0, np.arange(len(both))))
    return both[at][1:]


def rolled(values: np.ndarray, back: int, n: int) -> np.ndarray:
    """Mean, sample deviation, min and max of the last ``n`` values up to each one from place ``back`` on; NaN where one is missing."""
    out = np.full((4, len(values) - back), np.nan)
    first = max(back, n - 1)  # the first row with n values
    for lo in range(first, len(values), STEP):
        hi = min(lo + STEP, len(values))
        w = np.lib.stride_tricks.sliding_window_view(values[lo - n + 1 : hi], n)
        at = slice(lo - back, hi - back)
        out[0, at] = w.mean(axis=1)
        out[1, at] = w.std(axis=1, ddof=1) if n > 1 else np.nan
        out[2, at], out[3, at] = w.min(axis=1), w.max(axis=1)
    return out


class SeriesFeatures(StatefulProcessor):
    """Input: key, ``_t`` (microseconds) and the columns; output: key, ``_t``, the columns and ``names``."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], lags: Sequence[int], rolls: Sequence[int]):
        self.keys, self.columns, self.lags, self.rolls = list(keys), list(columns), list(lags), list(rolls)
        self.back = max([*lags, *[n - 1 for n in rolls], 0])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, v array<double>")
        self.past = handle.getValueState("past", "till bigint, ring array<array<double>>, last array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.past.get()
        till = held[0] if held is not None else None
        first = None
        for frame in rows:
            # by place, as names that begin with _ are given anew: keys, event time, microseconds, values
            t = frame.iloc[:, len(self.keys) + 1].to_numpy(np.int64)
            v = frame.iloc[:, len(self.keys) + 2 :].to_numpy(np.float64)
            if till is not None:
                t, v = t[t > till], v[t > till]
            if len(t):
                self.waiting.appendList([(int(a), b) for a, b in zip(t, v.tolist())])
                first = int(t.min()) if first is None else min(first, int(t.min()))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        n = sum(r[0] <= passed for r in rows)
        if rows[n:]:
            self.handle.registerTimer(rows[n][0] // 1000)
        if not n:
            return
        if rows[n:]:
            self.waiting.put([(r[0], list(r[1])) for r in rows[n:]])
        else:
            self.waiting.clear()
        new = np.array([list(r[1]) for r in rows[:n]], np.float64)
        held = self.past.get()
        ring = np.array([list(r) for r in held[1]], np.float64).reshape(-1, len(self.columns)) if held is not None else new[:0]
        last = np.array(list(held[2]), np.float64) if held is not None else np.full(len(self.columns), np.nan)
        out, last = self.features(ring, new, last)
        whole = np.concatenate([ring, new])
        self.past.update((rows[n - 1][0], whole[len(whole) - min(self.back, len(whole)) :].tolist(), last.tolist()))
        head = dict(zip(self.keys, key)) | {"_t": np.array([r[0] for r in rows[:n]], np.int64)} | {c: new[:, i] for i, c in enumerate(self.columns)}
        yield pd.DataFrame(head | out)

    def features(self, ring: np.ndarray, new: np.ndarray, last: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The new columns of the rows ``new``, which come after ``ring``, and the last known values."""
        back, whole = len(ring), np.concatenate([ring, new])
        fills = [filled(new[:, i], last[i]) for i in range(len(self.columns))]
        out = {f"{c}_filled": f for c, f in zip(self.columns, fills)}
        for i, c in enumerate(self.columns):
            padded = np.r_[np.full(self.back, np.nan), whole[:, i]]
            for k in self.lags:
                out[f"{c}_lag_{k}h"] = padded[self.back + back - k : len(padded) - k]
        for i, c in enumerate(self.columns):
            for n in self.rolls:
                for s, x in zip(STATISTICS, rolled(whole[:, i], back, n)):
                    out[f"{c}_rolling_{s}_{n}h"] = x
        return out, np.array([f[-1] for f in fills])


def add_features(
    rows: DataFrame, columns: Sequence[str], late: str = "1 day", lags: Sequence[int] = LAGS, rolls: Sequence[int] = ROLLS, keys: Sequence[str] = ("region",), ts: str = "timestamp"
) -> DataFrame:
    """The closed rows of a stream with ``names``: time, keys, columns, fills, lags and rolling statistics."""
    spark = rows.sparkSession
    # several states a key need this provider; a query that has a checkpoint keeps its own
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = F.col(ts).cast("timestamp")
    typed = rows.select(*keys, at.alias("_at"), F.unix_micros(at).alias("_t"), *[F.col(c).cast("double").alias(c) for c in columns]).where("_at is not null")
    kinds = {f.name: f.dataType.simpleString() for f in typed.schema.fields}
    new = names(columns, lags, rolls)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _t bigint, " + ", ".join(f"`{c}` double" for c in [*columns, *new])
    out = typed.withWatermark("_at", late).groupBy(*keys).transformWithStateInPandas(SeriesFeatures(keys, columns, lags, rolls), schema, "Append", "EventTime")
    return out.select(F.timestamp_micros("_t").cast("timestamp_ntz").alias(ts), *keys, *columns, *new)
