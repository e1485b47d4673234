"""File events as a stream: debounce by key, then one maintenance step per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEBOUNCE_MS, POLL_MS = 500, 1000
EVENT = "path string, kind string, ts timestamp, seq long"
DEBOUNCED = "path string, kind string, first_ts timestamp, last_ts timestamp, n_events long"


def debounce_batch(events: DataFrame, gap: str = "500 milliseconds", key: str = "path") -> DataFrame:
    """One row per burst of events of a key: bursts are separated by at least the gap; the last event's kind counts."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    apart = F.lag("ts").over(w).isNull() | (F.col("ts") >= F.lag("ts").over(w) + F.expr(f"INTERVAL {gap}"))
    bursts = events.withColumn("__burst", F.sum(F.when(apart, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("kind", F.struct("ts", "seq"))
    return bursts.groupBy(key, "__burst").agg(last.alias("kind"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events")).drop("__burst")


def debounce_sessions(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds", key: str = "path") -> DataFrame:
    """The same over event time, for a stream: session windows behind a watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(key, F.session_window("ts", gap))
        .agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"))
        .drop("session_window")
    )


def debounce_processing_time(events: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Emit a path once it has been quiet for `quiet_ms` of processing time; the event with the greatest seq counts."""

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kind, _, first, last, n = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "kind": [kind], "first_ts": [pd.Timestamp(first)], "last_ts": [pd.Timestamp(last)], "n_events": [n]})
            return
        kind, seq, first, last, n = state.get if state.exists else (None, -(1 << 62), None, None, 0)
        for p in parts:
            top = p.loc[p["seq"].idxmax()]
            if top["seq"] > seq:
                kind, seq = top["kind"], int(top["seq"])
            times = [str(p["ts"].min()), str(p["ts"].max())]
            first, last, n = min(filter(None, [first, times[0]])), max(filter(None, [last, times[1]])), n + len(p)
        state.update((kind, seq, first, last, n))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"path": [], "kind": [], "first_ts": pd.to_datetime([]), "last_ts": pd.to_datetime([]), "n_events": []})

    return events.groupBy("path").applyInPandasWithState(step, DEBOUNCED, "kind string, seq long, first string, last string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, poll_ms: int = POLL_MS, once: bool = False) -> StreamingQuery:
    """Start the stream of debounced events; `apply(batch, id)` makes one maintenance step of each micro-batch."""
    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{poll_ms} milliseconds")
    return writer.start()
