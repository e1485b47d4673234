"""Listing, manifests, JSONL, maintenance, streaming, rendering, engine and command line."""

from __future__ import annotations

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from srcatlas import cli
from srcatlas.engine import CodeIndex, show
from srcatlas.functions import blake3, glob
from srcatlas.operators import explore, lookup, maintain, render, snippets
from srcatlas.plans import schema
from srcatlas.sources import jsonl, listing, locks, manifests
from srcatlas.sources.store import SnapshotStore
from srcatlas.streaming import events


def tree(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", encoding="utf-8") as f:
            f.write(text)


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("code"))
    tree(root, {
        ".git/HEAD": "", "package.json": '{"name": "demo", "description": "A demo."}',
        "src/app.py": '"""App code here."""\nimport util\n\nclass App:\n    def run(self):\n        util.helper(1)\n\n    def _stop(self):\n        pass\n\ndef main():\n    App().run()\n',
        "src/util.py": "def helper(x):\n    return x\n\n\ndef _inner():\n    helper(2)\n",
        "docs/readme.md": "# Guide\n\nHow to use the widget.\n", "sub/.git/HEAD": "", "sub/lib.rs": "pub fn helper() {}\n",
        ".gitignore": "*.log\n/gen/\n!keep.log\n", "a.log": "x", "keep.log": "x", "gen/x.py": "x = 1\n", "src/gen/y.py": "y = 1\n", "src/.hidden.py": "z = 1\n", ".conf/w.py": "w = 1\n",
    })
    os.symlink(f"{root}/src", f"{root}/link")
    return CodeIndex.of_tree(spark, root)


def test_listing(code):
    found = listing.walk(code.root)
    assert found.projects == ["", "sub"]
    assert found.files == [".conf/w.py", "docs/readme.md", "keep.log", "package.json", "src/app.py", "src/gen/y.py", "src/util.py", "sub/lib.rs"]
    assert {(r.project, r.path) for r in code.index.files.collect()} >= {("", "src/app.py"), ("sub", "lib.rs")}
    assert listing.owner(["", "a", "a/b"], "a/b/c") == "a/b" and listing.owner(["", "a"], "ab/c") == ""


def test_tools(code):
    assert [r.name for r in code.get_file_symbols("src/app.py").collect()] == ["App", "App.run", "main"]
    assert len(code.get_file_symbols("src/*", "private").collect()) > 5
    assert [r.name for r in code.get_children("src/app.py", "App", "internal").collect()] == ["App.run", "App._stop"]
    assert {(r.file, r.caller) for r in code.get_callers("helper").collect()} == {("src/app.py", "App.run"), ("src/util.py", "_inner")}
    assert {r.name for r in code.get_callees("run").collect()} == {"util.helper"}
    first = code.search("helper").first()
    assert first.type == "symbol" and first.name == "helper" and first.snippet.startswith(("def helper", "pub fn helper"))
    assert code.search("widget", scope=["file"]).first().file == "docs/readme.md"
    out = code.explore(visibility="private")
    assert out["name"] == "demo" and out["subprojects"] == ["sub"] and ("src", ["app.py", "util.py"]) in out["directories"]
    assert code.explore(path="sub", visibility="private")["project"] == "sub"
    with pytest.raises(LookupError):
        code.explore(project="nope")
    assert "src/app.py[4-9] class App" in show(code.get_file_symbols("src/app.py"), "text")
    assert json.loads(show(code.get_callers("helper")))[0]["kind"] == "call"


def test_round_trip(spark, code):
    assert code.flush_index() == 2 and code.flush_index() == 0
    folder = f"{code.root}/{listing.INDEX_FOLDER}"
    meta = jsonl.read_manifest(spark, folder)
    assert meta["version"] == "1.0" and "python" in meta["languages"]
    back = jsonl.read(spark, folder, "")
    key = lambda ix: sorted((r.file, r.name, r.kind, r.line_start, r.visibility_level, r.tokens or "") for r in ix.symbols.filter("project = ''").collect())
    assert key(back) == key(code.index)
    with open(f"{folder}/files.jsonl") as f:
        paths = [json.loads(x)["path"] for x in f]
    assert paths == sorted(paths) and "project" not in json.loads(open(f"{folder}/files.jsonl").readline())
    os.remove(f"{folder}/references.jsonl")
    assert jsonl.read(spark, folder).refs.count() == 0
    with open(f"{folder}/symbols.jsonl", "a") as f:
        f.write("{broken\n")
    with pytest.raises(Exception):
        jsonl.read(spark, folder).symbols.collect()
    jsonl.write_distributed(code.index, f"{code.root}/.dist", "all")
    assert jsonl.read(spark, f"{code.root}/.dist").refs.count() == code.index.refs.count()
    assert jsonl.read_manifest(spark, f"{code.root}/.dist") == {"version": "1.0", "name": "all", "root": ".", "languages": ["markdown", "python", "rust"]}
    with open(f"{folder}/index.json", "w") as f:
        f.write('{"version": "2.0", "name": "x"}')
    with pytest.raises(ValueError, match="unsupported index version: 2.0"):
        jsonl.read(spark, folder)


def test_maintenance(spark, tmp_path):
    root = str(tmp_path)
    tree(root, {"a.py": "def one(): pass\n", "b.py": "def two(): pass\n", "c.py": "def three(): pass\n"})
    index = CodeIndex.of_tree(spark, root)
    index.dirty.clear()
    tree(root, {"a.py": "def uno(): pass\n", "d.py": "def four(): pass\n"})
    os.remove(f"{root}/b.py")
    named = [("", "a.py", "modify"), ("", "b.py", "modify"), ("", "c.py", "remove"), ("", "d.py", "create")]
    index.apply(spark.createDataFrame(named, "project string, path string, kind string"))
    assert sorted(r.name for r in index.index.symbols.collect()) == ["four", "uno"]
    assert sorted(r.path for r in index.index.files.collect()) == ["a.py", "d.py"]
    assert index.dirty == {""} and index.search("uno").first().name == "uno"
    assert maintain.without_project(index.index, "").files.count() == 0
    changed = maintain.changed_files(index.index.files, index.index.files.withColumn("hash", F.when(F.col("path") == "a.py", F.lit("0")).otherwise(F.col("hash"))))
    assert [r.path for r in changed.collect()] == ["a.py"]


EVENT = "project string, path string, kind string"


@pytest.mark.parametrize("stored", [False, True])
def test_unchanged_files_are_left_alone(spark, tmp_path, stored):
    root = str(tmp_path / "code")
    tree(root, {"a.py": "def one(): pass\n", "b.py": "def two(): pass\n", "sub/.git/HEAD": "", "sub/c.py": "def three(): pass\n"})
    index = CodeIndex.of_tree(spark, root, SnapshotStore(spark, str(tmp_path / "store")) if stored else None)
    index.dirty.clear()
    index.apply(spark.createDataFrame([("", "a.py", "modify"), ("", "gone.py", "remove"), ("sub", "c.py", "create")], EVENT))
    assert index.dirty == set() and (not stored or index.store.versions() == [1])
    tree(root, {"sub/c.py": "def drei(): pass\n"})
    os.remove(f"{root}/b.py")
    index.reconcile()
    assert index.dirty == {"", "sub"}
    assert sorted((r.project, r.name) for r in index.index.symbols.collect()) == [("", "one"), ("sub", "drei")]
    index.dirty.clear()
    tree(root, {"new/.git/HEAD": "", "new/d.py": "def four(): pass\n"})
    index.reconcile()  # a project found since
    assert index.dirty == {"new"} and {r.project for r in index.index.files.collect()} == {"", "sub", "new"}
    index.dirty.clear()
    index.reconcile()
    assert index.dirty == set()
    if stored:
        assert len(index.store.versions()) == 3 and index.store.compact(2) is None and index.store.compact(1) == 4
        assert len(set(index.store._manifest().values())) == 1 and index.store.read().symbols.count() == 3 and index.store.compact(1) is None


def test_locks_and_requests(spark, tmp_path):
    import threading

    root = str(tmp_path)
    tree(root, {"a.py": "def one(): pass\n", "sub/.git/HEAD": "", "sub/b.py": "def two(): pass\n"})
    ours, theirs = CodeIndex.of_tree(spark, root), CodeIndex.of_tree(spark, root)
    ours.lock()
    theirs.lock()
    assert ours.locked == set() and theirs.locked == {"", "sub"} and theirs.flush_index() == 0
    assert not locks.ask(f"{root}/sub", timeout=0.2) and not locks.asked(f"{root}/sub")
    stop = threading.Event()
    watching = ours.watch_requests(stop)
    assert locks.ask(f"{root}/sub", timeout=60) and ours.dirty == {""}
    stop.set()
    watching.join(60)
    assert os.path.exists(f"{root}/sub/{listing.INDEX_FOLDER}/index.json") and not os.path.exists(f"{root}/{listing.INDEX_FOLDER}/index.json")
    ours.release()
    theirs.lock()
    assert theirs.locked == set() and theirs.flush_index() == 2
    theirs.release()
    assert [f for f in listing.walk(root).files if "lock" in f or "flush" in f] == []


def test_stream(spark, tmp_path):
    rows = [("a", "create", "2024-01-01 00:00:00.0", 1), ("a", "modify", "2024-01-01 00:00:00.3", 2), ("b", "modify", "2024-01-01 00:00:00.1", 3), ("a", "remove", "2024-01-01 00:00:05.0", 4), ("z", "modify", "2024-01-01 01:00:00.0", 5)]
    df = spark.createDataFrame(rows, "path string, kind string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.json(f"{tmp_path}/in")
    want = {(r.path, r.kind, r.n_events) for r in events.debounce_batch(df).collect()}
    assert want == {("a", "modify", 2), ("a", "remove", 1), ("b", "modify", 1), ("z", "modify", 1)}
    got: list = []
    stream = events.debounce_sessions(spark.readStream.schema(events.EVENT).json(f"{tmp_path}/in"))
    q = events.run(stream, lambda batch, _: got.extend((r.path, r.kind, r.n_events) for r in batch.collect()), f"{tmp_path}/check", once=True)
    q.awaitTermination(120)
    assert set(got) == want - {("z", "modify", 1)}  # the last burst may still grow


def test_stream_by_processing_time(spark, tmp_path):
    import time

    df = spark.createDataFrame([("a", "create", 1), ("a", "remove", 3), ("a", "modify", 2), ("b", "modify", 4)], "path string, kind string, seq long").withColumn("ts", F.current_timestamp())
    df.coalesce(1).write.json(f"{tmp_path}/in")
    got: list = []
    stream = events.debounce_processing_time(spark.readStream.schema(events.EVENT).json(f"{tmp_path}/in"), quiet_ms=300)
    q = events.run(stream, lambda batch, _: got.extend((r.path, r.kind, r.n_events) for r in batch.collect()), f"{tmp_path}/check", poll_ms=200)
    end = time.time() + 90
    while len(got) < 2 and time.time() < end and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert sorted(got) == [("a", "remove", 3), ("b", "modify", 1)]


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("package.json", '{"name": "x", "description": "d"}', ("x", "d")),
        ("package.json", '{"private": true, "name": "x"}', ("DIR", None)),
        ("Cargo.toml", '[package]\nname = "c"\ndescription = "cd"', ("c", "cd")),
        ("Cargo.toml", '[workspace]\nmembers = ["a"]', ("DIR", None)),
        ("pyproject.toml", '[tool.poetry]\nname = "p"\ndescription = "pd"', ("p", "pd")),
        ("go.mod", "module example.com/a/tool\n", ("tool", None)),
        ("pom.xml", "<project><artifactId>art</artifactId><name>Nm</name></project>", ("Nm", None)),
        ("pom.xml", "<project><artifactId>art</artifactId></project>", ("art", None)),
        ("x.gemspec", 's.name = "g"\ns.summary = \'gs\'\n', ("g", "gs")),
        ("package.json", "{broken", ("DIR", None)),
    ],
)
def test_manifests(tmp_path, name, text, want):
    (tmp_path / name).write_text(text)
    found = manifests.metadata(str(tmp_path))
    assert (found.name, found.description) == (tmp_path.name if want[0] == "DIR" else want[0], want[1]) and found.files == [name]


def test_manifest_precedence(tmp_path):
    (tmp_path / "package.json").write_text('{"name": "js"}')
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "rs"\ndescription = "from cargo"')
    found = manifests.metadata(str(tmp_path))
    assert (found.name, found.description, found.files) == ("js", "from cargo", ["package.json", "Cargo.toml"])


def test_manifests_over_a_table(spark):
    rows = [("x/a", "package.json", '{"name": "js"}'), ("x/a", "Cargo.toml", '[package]\nname = "rs"\ndescription = "from cargo"'), ("x/a", "src/package.json", '{"name": "no"}'), ("x/b", "go.mod", "nothing"), ("x/b", "go.mod", "nothing"), ("x/c", "main.py", "x"), (None, "pom.xml", None)]
    files = spark.createDataFrame([(p, path, text and bytearray(text.encode()), 1) for p, path, text in rows], "project string, path string, content binary, name int")
    assert sorted(map(tuple, manifests.scan(files).collect())) == [("", "", None, ["pom.xml"]), ("x/a", "js", "from cargo", ["package.json", "Cargo.toml"]), ("x/b", "b", None, ["go.mod"])]
    assert manifests.scan(files.limit(0)).count() == 0


def test_ignore_rules_over_a_table(spark):
    paths = spark.createDataFrame([(p,) for p in ("a.py", ".a.py", ".c/a.py", "x/.git/HEAD", "gen/a.py", "src/gen/a.py", "a.log", "keep.log", None)], "path string")
    assert sorted(r.path for r in listing.indexed(paths, ["*.log", "/gen/", "!keep.log"]).collect()) == [".c/a.py", "a.py", "keep.log", "src/gen/a.py"]


def test_levels_and_globs(spark):
    assert [schema.max_level(v, "public") for v in ("public", "internal", "private", "x", None)] == [1, 2, None, None, 1]
    rows = spark.createDataFrame([(x,) for x in ("a/b.py", "a/c/d.py", "a/b.pyc", "A/b.py", "[x]", "a\nb")], "p string")
    for pattern, want in {"a/*": ["a/b.py", "a/b.pyc", "a/c/d.py"], "a/?.py": ["a/b.py"], "*.py": ["A/b.py", "a/b.py", "a/c/d.py"], "a/[^x].py": ["a/b.py"], "[[]x]": ["[x]"], "a?b": ["a\nb"], "a/b.py": ["a/b.py"], "[a": []}.items():
        assert sorted(r.p for r in rows.filter(glob.matches(F.col("p"), pattern)).collect()) == sorted(want), pattern
    with pytest.raises(ValueError):
        lookup.page(rows, -1)


def test_blake3():
    data = lambda n: bytes(i % 251 for i in range(n))
    for n, want in {0: "af1349b9f5f9a1a6", 1: "2d3adedff11b61f1", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3", 2048: "e776b6028c7cd22a", 5121: "628bd2cb2004694a"}.items():
        assert blake3.short_hash(data(n)) == want
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 5121, 7168, 9000, 16385, 31744]
    assert blake3.short_hashes([data(n) for n in sizes]) == [blake3.short_hash(data(n)) for n in sizes]
    assert blake3.short_hashes([]) == []


def test_snippets(spark):
    text = "one\n\ntwo\n  three\nfour\n"
    rows = [(1, 5), (3, 3), (2, 2), (4, 99), (9, 12), (0, 1)]
    df = spark.createDataFrame([("p", "f", a, b, text) for a, b in rows], "project string, file string, line_start int, line_end int, c string")
    got = [r.s for r in df.select(snippets.snippet(F.col("c"), F.col("line_start"), F.col("line_end"), 2).alias("s")).collect()]
    assert got == ["one\ntwo\n...", "two", None, "  three\nfour", None, "one"]
    assert [snippets.context_lines(n) for n in (None, 0, -1, 5)] == [10, 1, None, 5]
    block = df.limit(1).select(render.snippet_block(F.lit("    a\n      b")).alias("b")).first().b
    assert block == "  │ a\n  │   b\n"


def test_tree_and_caps():
    out = render.tree("demo", [(".", ["a.md"]), ("src/main/java", ["X.java"]), ("src/main/java/deep", ["+3 java files"]), ("lib", [])])
    assert out.split("\n") == ["demo", "├── lib/", "├── src/main/java/", "│   ├── deep/", "│   │   └── +3 java files", "│   └── X.java", "└── a.md"]
    assert [explore.cap_of(*x) for x in ((10, 3, 200), (500, 10, 200), (500, 999, 200))] == [None, 20, 1]
    assert explore.resolve(["", "a", "a/b"], None, "a/b/c") == ("a", "b/c") and explore.resolve(["", "a"], None, "a/") == ("a", None) and explore.resolve(["x"], "x", "p") == ("x", "p")


def test_command_line(code):
    options = cli.parser().parse_args(["query", "search", "foo|bar", "--scope", "symbol", "--limit", "3"])
    assert cli.arguments_of(options) == ("search", {"query": "foo|bar", "scope": ["symbol"], "limit": 3}, "text")
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "get_callers", "arguments": {"name": "helper"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "a.b"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "prompts/get", "params": {"name": "trace_calls"}},
        {"jsonrpc": "2.0", "id": 6, "method": "nope"},
    ]
    sink = io.StringIO()
    cli.serve(code, io.StringIO("\n".join(map(json.dumps, asked)) + "\n{bad\n"), sink)
    answers = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, 4, 5, 6, None]
    assert len(answers[1]["result"]["tools"]) == 7 and answers[3]["result"]["isError"] and "error" in answers[5] and "error" in answers[6]
    assert {r["caller"] for r in json.loads(answers[2]["result"]["content"][0]["text"])} == {"App.run", "_inner"}
