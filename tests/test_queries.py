"""Every registered index query against its SQL."""

from __future__ import annotations

import pytest

from srcatlas.plans import queries as Q
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query(spark, sf_dir, name):
    same(Q.QUERIES[name](spark, sf_dir), Q.ORACLE[name], sf_dir)


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.ORACLE)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:3] == ["project", "file", "name"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark, sf_dir):
    """An exact file name and a prefix reach the scan of a stored table."""
    from srcatlas.functions import glob
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = docs.filter(glob.matches(F.col("source"), "src1*")).select("doc_id")._jdf.queryExecution().toString()
    assert "StringStartsWith(source,src1)" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan
