"""The daily batch as streams: run with ``availableNow`` by a scheduler, or continuously. State expires by watermark or timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unseen(events: DataFrame, key: str, at: str, days: int = 14) -> DataFrame:
    """Events whose key did not come within ``days`` before (the memory of reported keys, with its expiry)."""
    return events.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, at: str, key: str, length: str = "1 day", late: str = "7 days") -> DataFrame:
    """Events for each key and day; days later than ``late`` are closed and late rows dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fails, error = state.get if state.exists else (0, None)
    rows = pd.concat(list(batches)).sort_values("at")
    for ok, text in zip(rows["ok"], rows["error"]):
        fails = 0 if ok else fails + 1
        error = error if ok else (text or "")[:300]
    state.update((fails, error))
    yield pd.DataFrame({"source_key": [key[0]], "fail_count": [fails], "last_error": [error]})


def source_health(events: DataFrame) -> DataFrame:
    """(source_key, fail_count, last_error) after each batch of (source_key, at, ok, error): failures since the last success.

    Nothing but a success clears failures, so the state has no timeout; one by processing time would also keep a run over
    what is available from ever ending.
    """
    return events.groupBy("source_key").applyInPandasWithState(_fold, "source_key string, fail_count int, last_error string", "fail_count int, last_error string", "update", GroupStateTimeout.NoTimeout)


def write_available(df: DataFrame, path: str, checkpoint: str):
    """Append everything there is to a table and stop; exactly once by the sink's commit log."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_available(df: DataFrame, merge, checkpoint: str):
    """Hand every batch to ``merge(batch, number)`` and stop."""
    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
