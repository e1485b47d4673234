"""The query language, and scores against SQLite's full-text index."""

from __future__ import annotations

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srcatlas.functions import query as Q
from srcatlas.operators import search as S
from srcatlas.plans.schema import Index


@pytest.mark.parametrize("text", ["foo.bar", "src/x.py", "don't", "", "foo -bar", "NOT x", "a|", "|a", "a AND", "(a", 'a )', "nosuch: a", "NEAR(a b, x)"])
def test_errors(text):
    with pytest.raises(Q.QuerySyntaxError):
        Q.parse(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("foo|bar baz", "(foo OR bar) baz"),
        ('"a|b" c', '"a|b" c'),
        ("hand*|context*", "(hand* OR context*)"),
        ("a b", "a b"),
    ],
)
def test_pipes(text, want):
    assert Q.expand_pipes(text) == want


def test_precedence():
    a, b, c = (Q.Phrase((x,)) for x in "abc")
    assert Q.parse("a NOT b c") == Q.Not(a, Q.And((b, c)))
    assert Q.parse("a OR b NOT c") == Q.Or((a, Q.Not(b, c)))
    assert Q.parse("a b OR c") == Q.Or((Q.And((a, b)), c))
    assert Q.parse("parse_file") == Q.Phrase(("parse", "file"))
    assert Q.parse("a + b*") == Q.Phrase(("a", "b"), prefix=True)
    assert Q.parse("-{name file}: ^a") == Q.Phrase(("a",), initial=True, columns=("content",))
    assert Q.parse("NEAR(a b, 3)") == Q.Near((a, b), 3)


ROWS = [
    ("symbol", "red_widget", "en/a.py", "function red widget economy small red"),
    ("symbol", "Blue.Bolt", "en/red/b.py", "class blue bolt"),
    ("text", "", "fr/c.md", "Élève déjà vu red bolt steel widget"),
    ("text", "", "fr/d.md", "red economy one two three four five six seven eight nine ten eleven twelve bolt"),
    ("file", "Red title", "en/e.rs", "A widget of steel. red red red"),
    ("file", "nothing", "en/f.rs", ""),
    ("symbol", "x", "zz/g.py", "function economy red steel"),
]
QUERIES = ["red", "red bolt", "red OR bolt", "widget NOT red", "wid*", '"red widget"', "red_widget", "eleve", "NEAR(red bolt, 3)", "NEAR(red bolt)", "name: red", "{name file}: red", "- name : red", "^red", "red OR (bolt AND steel)", "red NOT (bolt AND steel)", "red OR (bolt NOT widget)", "red red", "a OR of", "steel + widget", "red AND economy OR bolt", "NEAR(red economy bolt, 12)", '"red eco" *']


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(t, n, f, c, k) for k, (t, n, f, c) in enumerate(ROWS)], "type string, name string, file string, content string, line_start int")
    empty = {"project": "p", "kind": "k", "visibility_level": 1, "line_end": 1, "parent": None, "text": None}
    from pyspark.sql import functions as F

    for c, v in empty.items():
        df = df.withColumn(c, F.lit(v).cast("string") if v is None or isinstance(v, str) else F.lit(v))
    return S.tokenized(df).persist()


def sqlite_scores(query: str) -> dict[int, float]:
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, file, content)")
    con.executemany("INSERT INTO t(rowid, name, file, content) VALUES (?, ?, ?, ?)", [(k + 1, n, f, c) for k, (_, n, f, c) in enumerate(ROWS)])
    return {r - 1: s for r, s in con.execute("SELECT rowid, bm25(t, 3.0, 2.0, 1.0) FROM t WHERE t MATCH ?", (query,))}


@pytest.mark.parametrize("query", QUERIES)
def test_bm25_is_sqlites(spark, table, query):
    want = sqlite_scores(query)
    got = {r.line_start: r.score for r in S.search(Index(None, None, None, None), query, visibility="private", limit=None, docs=table).collect()}
    exact = query.split()[0].lower()
    got = {k: s + (1000 if ROWS[k][1].lower() == exact else 0) for k, s in got.items()}
    assert set(got) == set(want)
    for k, s in want.items():
        assert got[k] == pytest.approx(s, abs=2e-6)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aéÉß_1 .-'|\"", max_size=20))
def test_parser_never_breaks(text):
    try:
        Q.parse(text)
    except Q.QuerySyntaxError:
        pass
