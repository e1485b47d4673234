"""A streaming data source of file events: a tree is listed again and again, and differences are rows.

    spark.dataSource.register(TreeEvents)
    spark.readStream.format("tree_events").option("root", path).load()
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "project string, path string, kind string, ts timestamp, seq long"


def snapshot(root: str) -> dict[str, tuple[str, str, int, int]]:
    """Each file's (project, path in it, size, time of change); ignored files are not there."""
    from srcatlas.sources import listing

    found, out = listing.walk(root), {}
    for path in found.files:
        try:
            s = os.stat(os.path.join(root, path))
        except OSError:
            continue
        project = listing.owner(found.projects, path)
        out[path] = (project, path[len(project) + 1 :] if project else path, s.st_size, s.st_mtime_ns)
    return out


class _Reader(SimpleDataSourceStreamReader):
    """Offsets count events. The first listing is the starting point, so a restart finds no old changes; the index is compared by hash then."""

    def __init__(self, root: str, initial: bool) -> None:
        self.root, self.seq = root, 0
        self.known = {} if initial else snapshot(root)
        self.kept: list[tuple] = []

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now, at = snapshot(self.root), datetime.now(timezone.utc)
        events = []
        for path in sorted(now.keys() | self.known.keys()):
            new, old = now.get(path), self.known.get(path)
            if new != old:
                project, own, *_ = new or old
                kind = "remove" if new is None else "create" if old is None else "modify"
                events.append((project, own, kind, at, start["seq"] + len(events) + 1))
        self.known = now
        self.kept += events
        return iter(events), {"seq": start["seq"] + len(events)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([e for e in self.kept if start["seq"] < e[4] <= end["seq"]])

    def commit(self, end: dict) -> None:
        self.kept = [e for e in self.kept if e[4] > end["seq"]]


class _Part(InputPartition):
    def __init__(self, start: int, end: int, k: int) -> None:
        self.start, self.end, self.k = start, end, k


class _Resumable(DataSourceStreamReader):
    """Offsets name listings, which are kept in a folder until they are behind: after a restart the first listing is compared with the last one that was read, so changes in between are events. The same two offsets always give the same rows."""

    def __init__(self, root: str, folder: str, initial: bool, parts: int) -> None:
        self.root, self.folder, self.initial, self.parts = root, folder, initial, parts
        os.makedirs(folder, exist_ok=True)

    def _at(self, number: int) -> str:
        return os.path.join(self.folder, f"listing-{number}.json")

    def _load(self, number: int) -> dict:
        with open(self._at(number), encoding="utf-8") as f:
            return json.load(f)

    def _keep(self, number: int, files: dict) -> None:
        """A listing counts once it is whole."""
        at = self._at(number)
        with open(f"{at}.tmp", "w", encoding="utf-8") as f:
            json.dump({"ts": datetime.now(timezone.utc).isoformat(), "files": files}, f)
        os.replace(f"{at}.tmp", at)

    def _last(self) -> int:
        return max((int(n[8:-5]) for n in os.listdir(self.folder) if n.startswith("listing-") and n.endswith(".json")), default=-1)

    def initialOffset(self) -> dict:  # noqa: N802
        if self._last() < 0:
            self._keep(0, {} if self.initial else snapshot(self.root))
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last, now = self._last(), {path: list(x) for path, x in snapshot(self.root).items()}
        if last < 0 or self._load(last)["files"] != now:
            last += 1
            self._keep(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(start["listing"], end["listing"], k) for k in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        """The differences of two listings in one share of the paths."""
        old, new = self._load(partition.start)["files"], self._load(partition.end)
        at = datetime.fromisoformat(new["ts"])
        for n, path in enumerate(sorted(new["files"].keys() | old.keys())):
            was, now = old.get(path), new["files"].get(path)
            if was != now and zlib.crc32(path.encode()) % self.parts == partition.k:
                project, own, *_ = now or was
                yield project, own, "remove" if now is None else "create" if was is None else "modify", at, (partition.end << 32) + n

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.folder):
            if name.startswith("listing-") and name.endswith(".json") and int(name[8:-5]) < end["listing"]:
                os.remove(os.path.join(self.folder, name))


class TreeEvents(DataSource):
    """Options: root, initial ("true": files that are there at the start count as created), and listings, a folder
    that driver and executors share, best beside the checkpoint: with it the stream goes on after a restart with what
    has changed meanwhile, in `parts` (4) partitions; without it a restart begins at what is there then."""

    @classmethod
    def name(cls) -> str:
        return "tree_events"

    def schema(self) -> str:
        return SCHEMA

    def _initial(self) -> bool:
        return self.options.get("initial", "false").lower() == "true"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        if "listings" not in self.options:
            return super().streamReader(schema)  # not there, so the simple one is asked for
        return _Resumable(self.options["root"], self.options["listings"], self._initial(), int(self.options.get("parts", "4")))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(self.options["root"], self._initial())
