"""Incremental maintenance of the relations as batch algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.plans.schema import VERSION, Index, union


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """New files whose (project, path, hash) isn't stored yet."""
    return new.join(old.select("project", "path", "hash"), ["project", "path", "hash"], "left_anti")


def without_files(ix: Index, gone: DataFrame) -> Index:
    """The index without all rows of the files (project, path) in `gone`."""
    keys = gone.select("project", "path").distinct()
    return ix.map(lambda df, k: df.join(keys, ["project", "path"], "left_anti") if k == "files" else df.join(keys.withColumnRenamed("path", "file"), ["project", "file"], "left_anti"))


def without_project(ix: Index, project: str) -> Index:
    return ix.map(lambda df, _: df.filter(F.col("project") != project))


def upsert(ix: Index, new: Index) -> Index:
    """Replace all rows of the files that `new` holds."""
    return union(without_files(ix, new.files), new)


def apply_events(ix: Index, events: DataFrame, extracted: Index) -> Index:
    """Debounced events (project, path, kind): rows of all paths named are dropped, and those of created or modified ones come from `extracted`; a path that has vanished is only dropped."""
    touched = events.select("project", "path").distinct()
    alive = events.filter("kind <> 'remove'").select("project", "path").distinct()
    fresh = extracted.map(lambda df, k: df.join(alive if k == "files" else alive.withColumnRenamed("path", "file"), ["project", "path" if k == "files" else "file"], "left_semi"))
    return union(without_files(ix, touched), fresh)


ORDER = {"files": ["path"], "symbols": ["file", "line_start", "line_end", "name", "kind"], "texts": ["file", "line_start", "line_end", "kind", "text"], "refs": ["file", "line_start", "line_end", "name", "kind"]}


def export(ix: Index, project: str | None = None) -> Index:
    """All rows in their stored order; of one project if given, else led by the project."""
    if project is not None:
        return ix.map(lambda df, k: df.filter(F.col("project") == project).orderBy(*ORDER[k]))
    return ix.map(lambda df, k: df.orderBy("project", *ORDER[k]))


def manifest(ix: Index, project: str, name: str) -> DataFrame:
    """One row, unless the project has no files."""
    own = ix.files.filter(F.col("project") == project)
    row = own.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("lang")).alias("languages"))
    return row.filter("n > 0").select(F.lit(VERSION).alias("version"), F.lit(name).alias("name"), F.lit(".").alias("root"), "languages")


def languages(ix: Index) -> DataFrame:
    return ix.files.groupBy("project").agg(F.array_sort(F.collect_set("lang")).alias("languages"))


def project_totals(ix: Index) -> DataFrame:
    """Files, symbols, texts and references of each project."""
    parts = [getattr(ix, k).groupBy("project").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(k)) for k in ("files", "symbols", "texts", "refs")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    count = lambda k: F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{k}")
    return every.groupBy("project").agg(*map(count, ("files", "symbols", "texts", "refs")))
