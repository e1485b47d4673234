"""File events against stored hashes, in a stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from srcatlas.streaming import state as S

GAP = 3000


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, S.PROVIDER)
    yield spark
    spark.conf.unset(name)


def brute(events, stored):
    """Bursts of each file in order, against its stored hash."""
    have, out = dict(stored), []
    for key in sorted({e[:2] for e in events}):
        bursts = []
        for _, _, kind, value, ts, _ in sorted((e for e in events if e[:2] == key), key=lambda e: (e[4], e[5])):
            if bursts and ts < bursts[-1][-1][2] + GAP / 1000:
                bursts[-1].append((kind, value, ts))
            else:
                bursts.append([(kind, value, ts)])
        for b in bursts:
            kind, value, _ = b[-1]
            new = None if kind == "remove" else value
            if new != have.get(key):
                out.append((*key, "remove" if new is None else "create" if have.get(key) is None else "modify", new, b[0][2], b[-1][2], len(b)))
                have[key] = new
    return sorted(out, key=repr)


def run(spark, folder, stored, out, checkpoint, late):
    events = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    q = S.changes(events, stored, GAP, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and not q.isActive


def test_bursts_hashes_and_restart(rocks, tmp_path):
    spark = rocks
    rng = random.Random(2)
    files = [("p", f"f{i}.py") for i in range(6)] + [("", "root.py")]
    stored = {k: f"h{i % 2}" for i, k in enumerate(files) if i % 3}
    events = []
    for i in range(150):
        kind = rng.choice(["create", "modify", "modify", "remove"])
        events.append((*rng.choice(files), kind, None if kind == "remove" else rng.choice(["h0", "h1", "h2", None]), i + rng.randint(0, 1) / 4, i))
    have = spark.createDataFrame([(*k, h) for k, h in stored.items()], "project string, path string, hash string")
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    end = ("", "clock", "modify", "x", 10_000.0, 10_000)

    def put(rows):
        made = spark.createDataFrame(rows, "project string, path string, kind string, hash string, s double, seq long")
        made.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).select("project", "path", "kind", "hash", "ts", "seq").coalesce(1).write.mode("append").parquet(folder)

    # The stream stops in the middle of bursts and goes on from its checkpoint.
    put(events[:70])
    run(spark, folder, have, out, checkpoint, "5 seconds")
    put(events[70:])
    run(spark, folder, have, out, checkpoint, "5 seconds")
    put([end])
    run(spark, folder, have, out, checkpoint, "5 seconds")
    rows = spark.read.schema(S.CHANGE).parquet(out).withColumns({c: F.unix_micros(c) / 1_000_000 for c in ("first_ts", "last_ts")}).collect()
    assert sorted(map(tuple, rows), key=repr) == brute(events, stored)
    assert any(r.kind == "remove" for r in rows) and any(r.n_events > 1 for r in rows)


def test_source_goes_on_after_a_restart(spark, tmp_path):
    """What changes while no stream runs comes as events when it runs again, once."""
    from srcatlas import ship
    from srcatlas.streaming.source import TreeEvents

    ship.ensure(spark)
    spark.dataSource.register(TreeEvents)
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.py").write_text("a")
    (root / "sub" / "b.py").write_text("b")
    out, checkpoint, listings = (str(tmp_path / x) for x in ("out", "check", "listings"))

    def step():
        events = spark.readStream.format("tree_events").option("root", str(root)).option("listings", listings).load()
        q = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.path, r.kind) for r in spark.read.parquet(out).collect()) if any(tmp_path.joinpath("out").glob("*.parquet")) else []

    assert step() == []
    (root / "a.py").write_text("changed")
    (root / "sub" / "b.py").unlink()
    (root / "c.md").write_text("new")
    first = step()
    assert first == [("a.py", "modify"), ("c.md", "create"), ("sub/b.py", "remove")]
    assert step() == first
    (root / "a.py").unlink()
    assert step() == sorted([*first, ("a.py", "remove")])
    assert len([n for n in (tmp_path / "listings").iterdir()]) <= 3
