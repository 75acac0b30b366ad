"""Debouncing of change events as a stream: a path fires once it has been quiet for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, path: str = "path", time: str = "time", delay_ms: int = 500) -> DataFrame:
    """``path, time`` of the last event of each path, ``delay_ms`` after that event came in.

    State is the latest time of a path and lives in Spark's state store, spread by path;
    it goes when the path fires. A batch's events of a path come down to the latest, and
    an event that comes while a path waits starts its delay anew. Null paths are one path; null times count as the earliest.
    """
    schema = f"path string, {time} timestamp"

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"path": [key[0]], time: [None if last is None else pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else None
        for frame in frames:
            newest = frame["micros"].max()
            if pd.notna(newest):
                last = int(newest) if last is None else max(last, int(newest))
        state.update((last,))
        state.setTimeoutDuration(delay_ms)

    keyed = events.select(F.col(path).cast("string").alias("path"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"))
    return keyed.groupBy("path").applyInPandasWithState(handle, schema, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)
