"""File events against stored hashes, in keyed state of the executors.

Each file (project, path) has its own state: the hash that the index holds, and the burst of
events that is still open, with a timer on event time. A burst is over once no event has come
for the gap; then its last event counts, and a row comes out only if it changes something: a
file whose hash is the stored one is left alone, and so is the removal of a file that isn't
stored. The state lives in the stream's checkpoint, so a restart goes on from it, and the driver
holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "project string, path string, kind string, hash string, ts timestamp, seq long"
CHANGE = "project string, path string, kind string, hash string, first_ts timestamp, last_ts timestamp, n_events long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _changes(rows: list[tuple]) -> pd.DataFrame:
    names = ["project", "path", "kind", "hash", "first_ts", "last_ts", "n_events"]
    out = pd.DataFrame(rows, columns=names)
    for c in ("first_ts", "last_ts"):
        out[c] = pd.to_datetime(out[c], unit="us")
    return out


class FileState(StatefulProcessor):
    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "hash string")
        self.burst = handle.getValueState("burst", "kind string, hash string, first long, last long, n long")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """The hash that the index holds of a file."""
        self.stored.update((str(initialState["hash"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        at = events["ts"].astype("datetime64[us]").astype("int64").tolist()
        burst = self.burst.get() if self.burst.exists() else None
        before, out = burst, []
        for us, kind, value in zip(at, events["kind"], events["hash"], strict=True):
            value = None if value is None or value != value else str(value)
            if burst is not None and us >= burst[3] + self.gap_ms * 1000:
                out += self._over(key, burst)
                burst = None
            burst = (str(kind), value, us, us, 1) if burst is None else (str(kind), value, min(burst[2], us), max(burst[3], us), burst[4] + 1)
        if before is not None:
            self.handle.deleteTimer(self._timer(before))
        self.burst.update(burst)
        self.handle.registerTimer(self._timer(burst))
        yield _changes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        burst = self.burst.get() if self.burst.exists() else None
        if burst is None:
            yield _changes([])
            return
        self.burst.clear()
        yield _changes(self._over(key, burst))

    def _timer(self, burst: tuple) -> int:
        return burst[3] // 1000 + self.gap_ms

    def _over(self, key, burst: tuple) -> list[tuple]:
        """The change that a burst makes, if it makes one."""
        kind, value, first, last, n = burst
        have = self.stored.get()[0] if self.stored.exists() else None
        new = None if kind == "remove" else value
        if new == have:
            return []
        if new is None:
            self.stored.clear()
        else:
            self.stored.update((new,))
        return [(*key, "remove" if new is None else "modify" if have is not None else "create", new, first, last, n)]


def changes(events: DataFrame, stored: DataFrame, gap_ms: int = 500, late: str = "10 seconds") -> DataFrame:
    """The changes of a stream of events (EVENT) against stored hashes (project, path, hash): rows of CHANGE, one for each burst that changes its file.

    A null hash of an event that is no removal counts as a file that has vanished. Events
    later than `late` behind the newest are dropped, as the watermark says. The session's
    state store has to be RocksDB (PROVIDER).
    """
    have = stored.filter("hash IS NOT NULL").select("project", "path", "hash").dropDuplicates(["project", "path"])
    keyed = events.select("project", "path", "kind", "hash", "ts", "seq").withWatermark("ts", late).groupBy("project", "path")
    return keyed.transformWithStateInPandas(statefulProcessor=FileState(gap_ms), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime", initialState=have.groupBy("project", "path"))
