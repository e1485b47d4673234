"""The portable index: index.json and four sorted JSONL files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.operators import maintain
from srcatlas.plans.schema import MANIFEST, STORED, VERSION, Index, to_query_form

REQUIRED = ("files", "symbols", "texts")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    row = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/index.json").first()
    if row is None or not row.version or row.version.split(".")[0] != "1":
        raise ValueError(f"unsupported index version: {row.version if row else None}")
    return row.asDict()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, folder: str, project: str | None = None) -> Index:
    """An index in query form. Unknown fields are ignored, a broken line and an unsupported version fail; references and the manifest may be missing."""
    if _exists(spark, f"{folder}/index.json"):
        read_manifest(spark, folder)
    tables = {}
    for name, schema in STORED.items():
        path = f"{folder}/{name}.jsonl"
        if name in REQUIRED or _exists(spark, path):
            tables[name] = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        else:
            tables[name] = spark.createDataFrame([], schema)
    return to_query_form(tables["files"], tables["symbols"], tables["texts"], tables["references"], project)


def stored(ix: Index) -> dict[str, DataFrame]:
    """Query form to stored rows: `line` is joined again, derived columns and empty projects go."""

    def rows(df: DataFrame, schema) -> DataFrame:
        if "line_start" in df.columns:
            df = df.withColumn("line", F.array("line_start", "line_end"))
        df = df.withColumn("project", F.when(F.col("project") != "", F.col("project")))
        return df.select(*(f.name for f in schema if f.name in df.columns))

    return {name: rows(getattr(ix, "refs" if name == "references" else name), schema) for name, schema in STORED.items()}


def write(ix: Index, folder: str, project: str, name: str) -> bool:
    """One project as single local files, as tools exchange them; False, and nothing written, if it has no files.

    Rows stream through the driver one partition at a time; write_distributed is for
    indexes beyond one machine.
    """
    manifest = maintain.manifest(ix, project, name).collect()
    if not manifest:
        return False
    os.makedirs(folder, exist_ok=True)
    own = maintain.export(ix, project).map(lambda df, _: df.withColumn("project", F.lit("")))
    for table, df in stored(own).items():
        part = f"{folder}/.{table}.jsonl.part"
        with open(part, "w", encoding="utf-8") as f:
            for row in df.toJSON().toLocalIterator():
                f.write(row + "\n")
        os.replace(part, f"{folder}/{table}.jsonl")
    with open(f"{folder}/.index.json.part", "w", encoding="utf-8") as f:
        json.dump(manifest[0].asDict(), f, indent=2, ensure_ascii=False)
    os.replace(f"{folder}/.index.json.part", f"{folder}/index.json")
    return True


def write_distributed(ix: Index, folder: str, name: str = "workspace") -> None:
    """All projects, partitioned by project and sorted inside; every table a folder of JSON files that read() also takes, and the manifest of all, last."""
    for table, df in stored(ix).items():
        keys = [k for k in maintain.ORDER["refs" if table == "references" else table] if k in df.columns]
        df.repartitionByRange("project", keys[0]).sortWithinPartitions("project", *keys).write.mode("overwrite").json(f"{folder}/{table}.jsonl")
    every = ix.files.agg(F.array_sort(F.collect_set("lang")).alias("languages"))
    about = every.select(F.lit(VERSION).alias("version"), F.lit(name).alias("name"), F.lit(".").alias("root"), "languages")
    about.coalesce(1).write.mode("overwrite").json(f"{folder}/index.json")
