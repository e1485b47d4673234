"""Count tables of a fixed size, filled by all tasks and merged by ranges.

A task keeps dense tables and hands on their non-zero entries once, at its end. What
moves therefore grows with the input until the tables are full, and the model that
goes to the driver and to the workers is bounded by the tables' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PART = "name string, range int, at binary, value binary"
RANGES = 16


def entries(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, table in tables.items():
        at = np.flatnonzero(table).astype(np.uint32)
        if not len(at):
            continue
        cut = np.searchsorted(at, np.arange(RANGES + 1) * (len(table) // RANGES))
        full = np.flatnonzero(np.diff(cut))
        blob = lambda x: pa.array([x[cut[r] : cut[r + 1]].tobytes() for r in full], pa.binary())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(full)), pa.array(full.astype(np.int32)), blob(at), blob(table[at])], ["name", "range", "at", "value"])


def merged(parts: DataFrame, sizes: Callable[[str], tuple[int, type]]) -> dict[str, np.ndarray]:
    """The sums (or, for 64-bit masks, unions) of all tasks' tables. sizes: a table's length and type by its name."""

    def merge(t: pa.Table) -> pa.Table:
        name, r = t["name"][0].as_py(), t["range"][0].as_py()
        size, kind = sizes(name)
        own = size // RANGES
        out = np.zeros(own, kind)
        for at, value in zip(t["at"].to_pylist(), t["value"].to_pylist(), strict=True):
            k, v = np.frombuffer(at, np.uint32) - np.uint32(r * own), np.frombuffer(value, kind)
            if kind is np.uint64:
                out[k] |= v
            else:
                out[k] += v
        at = np.flatnonzero(out).astype(np.uint32)
        return pa.table({"name": pa.array([name]), "range": pa.array([r], pa.int32()), "at": pa.array([(at + np.uint32(r * own)).tobytes()], pa.binary()), "value": pa.array([out[at].tobytes()], pa.binary())})

    out: dict[str, np.ndarray] = {}
    for row in parts.groupBy("name", "range").applyInArrow(merge, PART).toLocalIterator():
        size, kind = sizes(row.name)
        table = out.setdefault(row.name, np.zeros(size, kind))
        table[np.frombuffer(bytes(row.at), np.uint32)] = np.frombuffer(bytes(row.value), kind)
    return out
