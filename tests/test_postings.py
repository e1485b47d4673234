"""Stored posting lists against a scan, pruning, and change."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from srcatlas.extract.run import build
from srcatlas.functions import query as Q
from srcatlas.operators import maintain as M
from srcatlas.operators import search as S
from srcatlas.operators.postings import PostingIndex, _Slots
from srcatlas.plans.schema import Index, union
from srcatlas.sources import bridge

QUERIES = ["red", "red bolt", "red OR bolt", "widget NOT red", "wid*", "red_widget", "NEAR(red economy, 1)", "NEAR(red economy bolt, 4)", "name: red", "- {name file} : red", "^function", "nosuchword", "red OR (bolt AND steel)", "red red", '"small gizmo" OR wid*', "small + gi*", "en", '"..." red', "red OR nosuch*", "É*"]


def files(spark, *rows):
    return build(spark.createDataFrame([(p, f, bytearray(c.encode())) for p, f, c in rows], "project string, path string, content binary"))


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def postings(spark, sf_dir, tmp_path_factory):
    ix = bridge.index(spark, sf_dir).map(lambda df, _: df.persist())
    out = PostingIndex(spark, str(tmp_path_factory.mktemp("postings")), block_bits=4, first=2)
    out.build(ix)
    return S.tokenized(S.search_docs(ix)).persist(), out, ix


def scan(docs, query, **options):
    return S.search(Index(None, None, None, None), query, docs=docs, **options)


@pytest.mark.parametrize("query", QUERIES)
def test_equals_a_scan(postings, query):
    docs, index, _ = postings
    assert rows(index.search(query, visibility="private", limit=50)) == rows(scan(docs, query, visibility="private", limit=50))


@pytest.mark.parametrize(
    "options",
    [{}, {"scope": ["symbol"]}, {"scope": ["text", "file"]}, {"scope": ["nothing"]}, {"kind": ["class", "method"]}, {"path": "en/d1/*"}, {"path": "en/d[01]/f?.*"}, {"path": "en/d1/f1.rs", "visibility": "private"}, {"project": "src1"}, {"project": "nosuch"}, {"visibility": "internal", "limit": 7, "offset": 9}, {"limit": None}, {"limit": 0}, {"kind": ["class"], "project": "src1", "path": "en/*", "scope": ["symbol"]}],
)
def test_filters(postings, options):
    docs, index, _ = postings
    assert rows(index.search("red OR widget", **options)) == rows(scan(docs, "red OR widget", **options))


def test_exact_names_come_first(spark, postings, tmp_path):
    *_, ix = postings
    named = ix.with_(files=ix.files.withColumn("title", F.when(F.col("doc_id") % 50 == 1, F.lit("Widget")).otherwise(F.col("title"))))
    index = PostingIndex(spark, str(tmp_path), block_bits=3, first=1)
    index.build(named)
    got = rows(index.search("widget OR en"))
    assert got == rows(S.search(named, "widget OR en")) and got[0][-1] < -900


def test_errors_come_before_reading(postings):
    with pytest.raises(Q.QuerySyntaxError):
        postings[1].search("a AND")
    with pytest.raises(ValueError):
        postings[1].search("red", limit=-1)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_words_and_prefixes_read_their_range(spark, postings, tmp_path):
    """The folders of a range, and in them the row groups of the term."""
    docs, _, ix = postings
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = PostingIndex(spark, str(tmp_path), block_bits=4)
        index.build(ix)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    live = sorted(index._live()[1])
    parts = spark.read.parquet(f"{index.path}/postings").select("part").distinct().count()
    assert parts == 4
    word = index.lists(["widget"], [], F.col("term") == "widget", live)
    prefix = index.lists([], ["wid"], F.col("term").startswith("wid"), live)
    for df, pushed in ((word, "EqualTo(term,widget)"), (prefix, "StringStartsWith(term,wid)")):
        plan = plan_of(df)
        assert pushed in plan
        held = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S)[1]
        assert "part#" in held and df.select("part").distinct().count() == 1
        # Bounds of blocks don't read positions.
        small = plan_of(df.groupBy("segment", "block").agg(F.max("content_n")))
        assert "entries" not in small.split("== Physical Plan ==")[1].split("ReadSchema")[1]
    assert rows(index.search("wid*")) == rows(scan(docs, "wid*"))


def test_rows_beyond_the_best_are_not_read(postings):
    _, index, _ = postings
    plan = plan_of(index.search("red", limit=5)).split("== Physical Plan ==")[1]
    assert plan.count("FileScan parquet") == 1 and "/rows]" in plan and "entries" not in plan and re.search(r"PushedFilters: \[.*(In\(row|EqualTo\(row)", plan)


def test_bounds_hold_and_prune(spark, tmp_path):
    """No row scores better than its block's bound, and blocks that can't reach the best k are not opened."""
    index = PostingIndex(spark, str(tmp_path), block_bits=3, first=2)
    text = lambda k: "red" if k % 8 == 0 and k < 40 else "red " + "filler " * (20 + k % 5)
    made = [("text", "p", f"f{k:03}", "", text(k), "comment", 0, k, k, None, text(k)) for k in range(160)]
    made += [("text", "p", f"g{k:03}", "", "blue", "comment", 0, k, k, None, "blue") for k in range(400)]  # a word of most rows weighs nothing
    docs = spark.createDataFrame(made, "type string, project string, file string, name string, content string, kind string, visibility_level int, line_start int, line_end int, parent string, text string").repartition(1)
    index._add(1, docs, [])
    _, live = index._live()
    segments, slots = sorted(live), _Slots()
    p = Q.parse("red")
    slots.of(p)
    tests = {0: slots.test(0)}
    lists = index.lists(["red"], [], tests[0], segments)
    blocks = index._blocks(lists, tests, None, None).withColumn("most", slots.most(p))
    got = index._rows(lists, tests, None, None).withColumn("block", F.shiftright("row", index.block_bits)).withColumn("f", F.lit(3) * F.size("s0_name") + 2 * F.size("s0_file") + F.size("s0_content"))
    score = lambda f, size: S.saturation(f, size, F.lit(20.0))
    joined = got.join(blocks.select("segment", "block", "most", "least"), ["segment", "block"]).select(score(F.col("f"), F.col("n_tokens")).alias("own"), score(F.col("most"), F.col("least")).alias("bound")).collect()
    assert len(joined) == 160 and all(r.own <= r.bound + 1e-12 for r in joined)
    opened = []
    inner = index._rows

    def spy(lists, *rest):
        opened.append(lists.select("segment", "block").distinct().count())
        return inner(lists, *rest)

    index._rows = spy
    try:
        found = index.search("red", limit=2)
        assert [r.file for r in found.collect()] == ["f000", "f008"]
    finally:
        del index._rows
    assert opened == [2, 5] and blocks.count() >= 20


def test_change_equals_a_rebuild(spark, postings, tmp_path):
    """Upserts, deletes, new files and merges: the same answers and statistics as from scratch."""
    *_, ix = postings
    index = PostingIndex(spark, str(tmp_path / "a"), block_bits=4, first=2)
    index.build(ix)
    now = ix

    def check():
        fresh = S.tokenized(S.search_docs(now)).persist()
        for query in ("red OR widget", '"red widget"', "NEAR(red economy, 2)"):
            assert rows(index.search(query, visibility="private", limit=30)) == rows(scan(fresh, query, visibility="private", limit=30)), query
        step, live = index._live()
        assert (sum(n for n, _ in live.values()), sum(t for _, t in live.values())) == tuple(fresh.agg(F.count(F.lit(1)), F.sum("n_tokens")).first())
        for word in ("red", "widget", "en"):
            held = index.having([word], sorted(live), step).get(word, {})
            assert sum(held.values()) == fresh.filter(F.array_contains(F.concat("name_t", "file_t", "content_t"), word)).count()

    moved = ix.map(lambda df, k: df.filter(F.col("path" if k == "files" else "file").like("en/d1/%")))
    edited = moved.with_(symbols=moved.symbols.withColumns({"name": F.concat(F.lit("Widget."), "name"), "line_start": F.col("line_start") + 1}))
    index.upsert(edited)
    now = M.upsert(now, edited).map(lambda df, _: df.persist())
    check()
    gone = ix.files.filter("path LIKE 'fr/%'").select("project", "path")
    index.delete(gone)
    index.delete(gone)  # a second time changes nothing
    now = M.without_files(now, gone)
    check()
    new = files(spark, ("newp", "red/a.py", "def red_widget(): pass\n# a red widget of economy bolt steel\n"), ("newp", "b.md", "# Red\n\nred red widget\n"))
    index.upsert(new)
    now = union(now, new)
    check()
    index.upsert(new)  # the same files once more
    check()
    for k in range(3):
        index.upsert(files(spark, ("newp", f"more{k}.py", f"def bolt_{k}(): red()\n")))
        now = union(now, files(spark, ("newp", f"more{k}.py", f"def bolt_{k}(): red()\n")))
    before = set(index._live()[1])
    assert index.compact(most=3)
    after = set(index._live()[1])
    assert len(after) < len(before) and after & before  # small ones are merged, the large one stays
    check()
    assert not index.compact()


def test_of_nothing(spark, tmp_path):
    index = PostingIndex(spark, str(tmp_path))
    assert index.search("word").columns == S.RESULT and index.search("word").count() == 0
    index.build(files(spark, ("", "a.py", "")).map(lambda df, _: df.limit(0)))
    assert index.search("word").columns == S.RESULT and index.search("word").count() == 0
    index.upsert(files(spark, ("", "a.py", "def word(): pass")))
    assert [r.name for r in index.search("word").collect()] == ["word"]
    index.delete(spark.createDataFrame([("", "a.py")], "project string, path string"))
    assert index.search("word").count() == 0 and index.rows().count() == 0
