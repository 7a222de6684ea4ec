"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinworks.session import quoted


def last_values(stream: DataFrame, at: str, key: str, value: str, n: int, *, late: str = "1 day", idle_seconds: int = 30 * 86_400) -> DataFrame:
    """The last ``n`` values by event time of every key, oldest first, after each micro-batch that has the key.

    The state of a key is ``n`` times and values, whatever the rate, and goes when the
    watermark (``late`` behind) is ``idle_seconds`` past its last event; a key that comes
    back begins anew.  Events of one instant stand in the order of their values; those
    at or behind the watermark come too late and are left out.
    """
    rows = stream.withWatermark(at, late).select(quoted(key).cast("string").alias("k"), quoted(at).alias("at"), F.unix_micros(quoted(at).cast("timestamp")).alias("t"), quoted(value).cast("double").alias("v"))

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, values = map(list, state.get) if state.exists else ([], [])
        kept = list(zip(times, values))
        for p in parts:
            kept = sorted([*kept, *zip(p["t"].tolist(), p["v"].tolist())])[-n:]
        state.update(([t for t, _ in kept], [v for _, v in kept]))
        state.setTimeoutTimestamp(max(kept[-1][0] // 1000, state.getCurrentWatermarkMs()) + idle_seconds * 1000)
        yield pd.DataFrame({"k": [group[0]], "last_values": [[v for _, v in kept]]})

    done = rows.groupBy("k").applyInPandasWithState(step, "k string, last_values array<double>", "times array<bigint>, kept array<double>", "update", GroupStateTimeout.EventTimeTimeout)
    return done.withColumnRenamed("k", key)


def daily_totals(stream: DataFrame, at: str, key: str, value: str, late: str = "3 days") -> DataFrame:
    """Totals by key and day of event time, with a watermark that bounds the state."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(quoted(at), "1 day"), quoted(key))
        .agg(F.sum(quoted(value)).alias("total"), F.count(F.lit(1)).alias("n_rows"))
        .select(F.col("window.start").cast("date").alias("day"), quoted(key), "total", "n_rows")
    )
