"""Stored suffixes of references against a scan."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from srcatlas.operators import lookup as L
from srcatlas.operators.suffixes import COLUMNS, SuffixIndex
from srcatlas.plans.schema import Index

NAMES = ["run", "a.run", "A.Run", "x.a.run", "rün", "run_all", "runXall", "x.run.all", "b.run_all", "x.RUNXALL", "run%", "a.b%c", "b.run%", "", ".", "run.", ".run", "a..run", "ru", "\\run", "x.\\run", None]


@pytest.fixture(scope="module")
def refs(spark):
    rows = [("p", f"f{i % 3}", n, "call", i, i, None if i % 4 == 0 else f"C.{n}") for i, n in enumerate(NAMES)]
    return spark.createDataFrame(rows + rows[:2], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def stored(spark, refs, tmp_path_factory):
    out = {}
    for column in ("name", "caller"):
        out[column] = SuffixIndex(spark, str(tmp_path_factory.mktemp("tails")), column)
        out[column].build(refs)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("column", ["name", "caller"])
def test_equals_a_scan(refs, stored, column):
    for name in ["run", "Run", "a.run", "run_all", "_un", "run.all", "r%", "%", "%n", "run%", "", "rün", "nosuch", "\\run", "all", "un"]:
        want = refs.filter(L.named(F.col(column), name)).select(*L.REF)
        assert rows(stored[column].find(name)) == rows(want), name


def test_reads_one_range(spark, refs, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = SuffixIndex(spark, str(tmp_path))
        index.build(refs.crossJoin(spark.range(20)).withColumn("name", F.concat("name", F.lit("_"), F.col("id").cast("string"))))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{index.path}/tails").select("part").distinct().count() == 4
    ix = Index(None, None, None, refs)
    for name, pushed in (("ru", "EqualTo(tail,ru)"), ("run_7", "StringStartsWith(tail,run)")):
        plan = L.callers(ix, name, find=index.find)._jdf.queryExecution().toString()
        held = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan, re.S)
        (own,) = re.findall(r"part#\d+ (?:= |IN \()([\d,]+)", held[1])
        assert len(own.split(",")) < 4 and pushed in held[2]


def test_of_nothing(spark, tmp_path):
    index = SuffixIndex(spark, str(tmp_path))
    assert index.find("run").count() == 0
    index.build(spark.createDataFrame([], COLUMNS))
    assert index.find("run").columns == L.REF and index.find("run").count() == 0


def test_references_are_stored_once(spark, tmp_path):
    """However many dots a name has and however many references it; a task's references lie by their names."""
    refs = spark.range(2000).repartition(2).selectExpr("'p' AS project", "'f' AS file", "concat('a.b.c', id % 10) AS name", "'call' AS kind", "1 AS line_start", "1 AS line_end", "CAST(NULL AS STRING) AS caller")
    index = SuffixIndex(spark, str(tmp_path))
    index.build(refs)
    assert spark.read.parquet(f"{index.path}/refs").count() == 2000 and spark.read.parquet(f"{index.path}/tails").count() == 30
    for file in (tmp_path / "refs").glob("*.parquet"):
        names = [r.name for r in spark.read.parquet(str(file)).collect()]
        assert names == sorted(names)
    found = index.find("c3")
    assert found.count() == 200 and "EqualTo(name,a.b.c3)" in found._jdf.queryExecution().toString()
