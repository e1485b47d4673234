"""The event source and the table functions."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from srcatlas.functions import udtf
from srcatlas.operators import render
from srcatlas.streaming.source import TreeEvents, _Reader


def test_differences(tmp_path):
    root = str(tmp_path)
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "sub" / ".git").mkdir(parents=True)
    reader = _Reader(root, initial=True)
    events, end = reader.read(reader.initialOffset())
    assert [(e[0], e[1], e[2], e[4]) for e in events] == [("", "a.py", "create", 1)] and end == {"seq": 1}
    (tmp_path / "a.py").write_text("longer")
    (tmp_path / "sub" / "b.py").write_text("y")
    events, end = reader.read(end)
    assert [(e[0], e[1], e[2]) for e in events] == [("", "a.py", "modify"), ("sub", "b.py", "create")]
    os.remove(tmp_path / "a.py")
    events, last = reader.read(end)
    assert [(e[1], e[2]) for e in events] == [("a.py", "remove")]
    assert [e[4] for e in reader.readBetweenOffsets({"seq": 1}, {"seq": 3})] == [2, 3]
    reader.commit({"seq": 3})
    assert [e[4] for e in reader.readBetweenOffsets({"seq": 0}, last)] == [4]


def test_live_stream(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("x")
    spark.dataSource.register(TreeEvents)
    got: list = []
    stream = spark.readStream.format("tree_events").option("root", str(root)).option("initial", "true").load()
    query = stream.writeStream.foreachBatch(lambda b, _: got.extend((r.path, r.kind) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="300 milliseconds").start()
    end = time.time() + 60
    while ("a.py", "create") not in got and time.time() < end:
        time.sleep(0.2)
    (root / "b.py").write_text("y")
    while ("b.py", "create") not in got and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert got == [("a.py", "create"), ("b.py", "create")]


def test_table_functions(spark):
    udtf.register(spark)
    spark.createDataFrame([("a.py", "import os\ndef f():\n    g('two words')\n"), ("b.txt", "x"), ("c.md", "# T")], "path string, content string").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT path, s.name, s.kind FROM sources, LATERAL extract_symbols(path, content) s").collect()
    assert {tuple(r) for r in rows} == {("a.py", "os", "import"), ("a.py", "f", "function"), ("c.md", "T", "section")}
    assert {tuple(r) for r in spark.sql("SELECT r.name, r.caller FROM sources, LATERAL extract_refs(path, content) r").collect()} == {("os", None), ("g", "f")}
    assert [r.text for r in spark.sql("SELECT t.text FROM sources, LATERAL extract_texts(path, content) t").collect()] == ["two words"]


def test_the_indent_of_a_snippet_is_found_once(spark):
    """Not again for each line: lines by lines would be 400 million here."""
    text = spark.range(1).select(F.repeat(F.lit("    some words\n"), 20_000).alias("text")).persist()
    text.count()
    began = time.perf_counter()
    block = text.select(render.snippet_block(F.col("text")).alias("b")).first().b
    assert time.perf_counter() - began < 20
    assert block == f"{render.BAR}some words\n" * 20_000 + f"{render.BAR}\n"
