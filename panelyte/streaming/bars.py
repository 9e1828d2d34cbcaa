"""Bars from a stream of events, keyed increments per micro-batch, means that carry their state on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(entity, start, open, high, low, close, n) of events (event_id, ts, event_type, value), batch or stream.

    On a stream, an hour is final once the watermark, `late` behind the newest event, has passed its end.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    return (
        events.groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("entity"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n"))
        .select("entity", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")
    )


def upsert_stream(updates: DataFrame, path: str, checkpoint: str):
    """Start a stream that appends each micro-batch to the table at path as its own folder batch=<number>.

    A batch writes its own rows only, and a repeated batch writes the same folder again; latest() gives the rows that
    count, and compact() puts them into one folder.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key of a table that upsert_stream writes; one aggregation with partial maxima."""
    values = [c for c in table.columns if c not in keys and c != "batch"]
    found = table.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("row"))
    return found.select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in values])


def compact(table: DataFrame, path: str, keys: list[str]) -> None:
    """The rows that count, as a new table at path that later batches can follow (batch -1)."""
    latest(table, keys).write.mode("overwrite").parquet(f"{path}/batch=-1")


def running_means(updates: DataFrame, half_life: float) -> DataFrame:
    """(entity, date, mean): exponential means of updates (entity, date, value), batch or stream, that go on from the state
    of earlier micro-batches. A row whose date is not after the state's last one was seen before and changes nothing.
    """
    keep = 0.5 ** (1 / half_life)

    def step(key, frames, state):
        mean, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("date")
        out = []
        for date, value in zip(rows["date"], rows["value"], strict=True):
            if last is not None and str(date) <= last:
                continue
            mean = value if mean is None else mean * keep + value * (1 - keep)
            last = str(date)
            out.append((key[0], date, mean))
        if last is not None:
            state.update((mean, last))
        yield pd.DataFrame(out, columns=["entity", "date", "mean"])

    return updates.groupBy("entity").applyInPandasWithState(step, "entity string, date date, mean double", "mean double, last string", "append", GroupStateTimeout.NoTimeout)
