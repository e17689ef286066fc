"""Structured-streaming forms of epoching, moving statistics and stage bouts.

The stream needs a timestamp column with a watermark; rows later than that are
dropped, as a missing epoch they count as unscored downstream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(stream: DataFrame, keys: list[str], ts: str, value: str, width: str = "30 seconds", late: str = "5 minutes", start: str | None = None) -> DataFrame:
    """``(keys, start, end, n, mean, sd, low, high)`` of every epoch; ``start`` shifts the epochs' grid."""
    w = F.window(ts, width) if start is None else F.window(ts, width, width, start)
    return _windowed(stream, keys, ts, value, w, late)


def sliding(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, step: str, late: str = "5 minutes") -> DataFrame:
    """The same in overlapping windows."""
    return _windowed(stream, keys, ts, value, F.window(ts, width, step), late)


def _windowed(stream: DataFrame, keys: list[str], ts: str, value: str, window: Column, late: str) -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(*keys, window.alias("w"))
    rows = g.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    return rows.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "sd", "low", "high")


def once(stream: DataFrame, ident: list[str], ts: str, late: str = "5 minutes") -> DataFrame:
    """Repeated deliveries dropped while the watermark remembers them."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(ident)


def bouts(stream: DataFrame, key: str, ts: str, stage: str, late: str = "5 minutes") -> DataFrame:
    """``(key, stage, first, last, n)``: a run is given out when the next one begins or when the key falls silent.

    Rows of a batch are ordered by time; one that is older than the open run's
    last row joins it only if it has its stage.
    """
    out = f"{key} string, {stage} string, first timestamp, last timestamp, n long"

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        run = list(state.get) if state.exists else None
        if state.hasTimedOut:
            if run:
                done.append((group[0], run[0], *map(pd.Timestamp, run[1:3]), run[3]))
            state.remove()
        else:
            rows = sorted((pd.Timestamp(t), s) for part in parts for t, s in zip(part[ts], part[stage]))
            for t, s in rows:
                if run and run[0] == s:
                    run[2], run[3] = max(run[2], str(t)), run[3] + 1
                elif not run or t >= pd.Timestamp(run[2]):
                    if run:
                        done.append((group[0], run[0], *map(pd.Timestamp, run[1:3]), run[3]))
                    run = [s, str(t), str(t), 1]
            if run:
                state.update(tuple(run))
                mark = state.getCurrentWatermarkMs()
                state.setTimeoutTimestamp(max(mark + 1, int(pd.Timestamp(run[2]).timestamp() * 1000) + 600_000))
        yield pd.DataFrame(done, columns=[key, stage, "first", "last", "n"])

    rows = stream.withWatermark(ts, late).select(F.col(key).cast("string").alias(key), ts, F.col(stage).cast("string").alias(stage))
    return rows.groupBy(key).applyInPandasWithState(step, out, "stage string, first string, last string, n long", "append", GroupStateTimeout.EventTimeTimeout)
