"""Registered queries that extract from sources whose names, calls and places all come from rows, with DuckDB SQL that computes the same rows from the columns.

Each part gives one file: its words name what is declared and called, its key chooses among
calls that say nothing (which must not come out, unless they go through an object) and among
types, and moves everything down by up to three lines.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.extract import run as extraction
from srcatlas.sources.bridge import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Case(NamedTuple):
    """Lines of a file and rows (relation, name, kind, line, parent or caller), all as SQL over w1, w2 (words), t (a capitalised word), k (the key) and said (a call that says nothing)."""

    said: tuple[str, ...]
    lines: list[str]
    rows: list[tuple[str, str, str, int, str]]


CASES = {
    "c": Case(
        ("printf", "strlen", "qsort", "toupper", "fmod"),
        ["concat('int ', w1, '_', k, '(int a) {')", "concat('  ', w2, '_', k % 7, '(a);')", "concat('  ', said, '(a);')", "concat('  s->', said, '(a);')", "'}'"],
        [("symbol", "concat(w1, '_', k)", "function", 1, "NULL"), ("ref", "concat(w2, '_', k % 7)", "call", 2, "concat(w1, '_', k)"), ("ref", "concat('s.', said)", "call", 4, "concat(w1, '_', k)")],
    ),
    "cpp": Case(
        ("push_back", "make_unique", "sort", "stoi", "EXPECT_EQ"),
        ["concat('void Ns::', t, '::', w1, '_', k, '() {')", "concat('  ', w2, '_', k % 7, '(1);')", "concat('  ', said, '(2);')", "concat('  v.', said, '(3);')", "concat('  auto q = new ', t, k % 5, '();')", "concat('  auto r = new ', CASE k % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'string' ELSE 'shared_ptr' END, '(4);')", "'}'"],
        [
            ("symbol", "concat('Ns::', t, '.', w1, '_', k)", "method", 1, "concat('Ns::', t)"),
            ("ref", "concat(w2, '_', k % 7)", "call", 2, "concat('Ns::', t, '.', w1, '_', k)"),
            ("ref", "concat('v.', said)", "call", 4, "concat('Ns::', t, '.', w1, '_', k)"),
            ("ref", "concat(t, k % 5)", "instantiation", 5, "concat('Ns::', t, '.', w1, '_', k)"),
        ],
    ),
    "csharp": Case(
        ("WriteLine", "ToString", "FirstOrDefault", "ConfigureAwait", "AreEqual"),
        ["concat('class ', t, k, ' {')", "'  event Handler Ev;'", "concat('  public ', t, k, '() : base() {')", "concat('    ', w2, k % 7, '(1);')", "concat('    ', said, '(2);')", "concat('    Svc.', said, '(3);')", "concat('    var q = new ', CASE k % 3 WHEN 0 THEN 'List' WHEN 1 THEN 'Exception' ELSE 'Guid' END, '();')", "'  }'", "'}'"],
        [
            ("symbol", "concat(t, k)", "class", 1, "NULL"),
            ("symbol", "concat(t, k, '.', t, k)", "constructor", 3, "concat(t, k)"),
            ("ref", "concat(w2, k % 7)", "call", 4, "concat(t, k, '.', t, k)"),
            ("ref", "concat('Svc.', said)", "call", 6, "concat(t, k, '.', t, k)"),
        ],
    ),
    "ruby": Case(
        ("each", "nil?", "gsub", "raise", "assert_equal"),
        ["concat('class ', t, k)", "concat('  def ', w1, '_a = ', w2, '_', k % 7, '(1)')", "concat('  def ', w1, '_b')", "concat('    x.', said, '(2)')", "concat('    ', said, '(3)')", "concat('    y.', w2, '_', k % 7, '(4)')", "'  end'", "'end'"],
        [
            ("symbol", "concat(t, k)", "class", 1, "NULL"),
            ("symbol", "concat(t, k, '.', w1, '_a')", "method", 2, "concat(t, k)"),
            ("symbol", "concat(t, k, '.', w1, '_b')", "method", 3, "concat(t, k)"),
            ("ref", "concat(w2, '_', k % 7)", "call", 2, "concat(t, k, '.', w1, '_a')"),
            ("ref", "concat('y.', w2, '_', k % 7)", "call", 6, "concat(t, k, '.', w1, '_b')"),
        ],
    ),
}
SUFFIX = {"c": "c", "cpp": "cpp", "csharp": "cs", "ruby": "rb"}


def _columns(case: Case) -> list[str]:
    said = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(case.said))
    return ["p_partkey AS k", "split_part(p_name, ' ', 1) AS w1", "split_part(p_name, ' ', 2) AS w2", "concat(upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2)) AS t", f"CASE p_partkey % {len(case.said)} {said} END AS said"]


def _extracted(language: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        case = CASES[language]
        source = f"concat(repeat(chr(10), CAST(k % 4 AS INT)), concat_ws(chr(10), {', '.join(case.lines)}), chr(10))"
        files = table(spark, d, "part").selectExpr(*_columns(case)).selectExpr("'made' AS project", f"concat('p', k, '.{SUFFIX[language]}') AS path", f"encode({source}, 'UTF-8') AS content")
        ix = extraction.build(files.repartition(spark.sparkContext.defaultParallelism))
        symbols = ix.symbols.select("file", F.lit("symbol").alias("relation"), "name", "kind", "line_start", F.col("parent").alias("scope"))
        return symbols.unionByName(ix.refs.select("file", F.lit("ref").alias("relation"), "name", "kind", "line_start", F.col("caller").alias("scope")))

    return run


def _wanted(language: str) -> str:
    case = CASES[language]
    rows = [f"SELECT concat('p', k, '.{SUFFIX[language]}') AS file, '{relation}' AS relation, {name} AS name, '{kind}' AS kind, CAST({line} + k % 4 AS INT) AS line_start, CAST({scope} AS VARCHAR) AS scope FROM c" for relation, name, kind, line, scope in case.rows]
    return f"WITH c AS (SELECT {', '.join(_columns(case))} FROM part)\n" + "\nUNION ALL ".join(rows)


for _language in CASES:
    QUERIES[f"extract_varied_{_language}"] = _extracted(_language)
    ORACLE[f"extract_varied_{_language}"] = _wanted(_language)
