"""Versioned Parquet snapshots of an index.

A version is a small manifest: which folder holds which projects. A write puts the
projects that changed into a new folder and publishes a manifest that takes the others
from where they are, so maintenance rewrites what changed and readers keep the version
they opened. A version counts once its manifest is complete; the greatest one wins.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.operators import maintain
from srcatlas.plans.schema import FILES, REFS, SYMBOLS, TEXTS, Index, to_query_form
from srcatlas.sources.jsonl import stored

TABLES = {"files": FILES, "symbols": SYMBOLS, "texts": TEXTS, "references": REFS}
FOLDERS = 16  # data folders of one version, beyond which the small ones are merged
ROOT = "."  # stands for the root project, whose name is empty, in folder names


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the cluster shares; one of our own only where that is unset and all runs on this machine, as in tests."""
    context = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not own and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
    if not context.getCheckpointDir():
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="srcatlas-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root, fs = self._fs(f"{self.path}/versions")
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _manifest(self, version: int | None = None) -> dict[str, str]:
        """project -> folder."""
        known = self.versions()
        if version is None and not known:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{known[-1] if version is None else version}", wholetext=True).first().value)

    def _publish(self, manifest: dict[str, str]) -> int:
        version = (self.versions() or [0])[-1] + 1
        # The write fails if another writer has published this number already.
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/versions/{version}")
        return version

    def write(self, ix: Index, projects: list[str] | None = None) -> int:
        """Store some projects of an index (by default all it has), and keep the others as they are. A project without files goes."""
        if projects is None:
            projects = [r.project for r in ix.files.select("project").distinct().collect()]
        folder = uuid.uuid4().hex
        rows = ix.map(lambda df, _: df.filter(F.col("project").isin(projects)))
        for name, df in stored(rows).items():
            key = maintain.ORDER["refs" if name == "references" else name][0]
            named = df.withColumn("project", F.coalesce("project", F.lit(ROOT)))
            named.repartitionByRange("project", key).sortWithinPartitions("project", key).write.partitionBy("project").parquet(f"{self.path}/data/{folder}/{name}")
        have = {r.project for r in rows.files.select("project").distinct().collect()}
        kept = {p: f for p, f in self._manifest().items() if p not in projects}
        return self._publish(kept | {p: folder for p in have})

    def read(self, version: int | None = None) -> Index:
        """An index in query form; a filter on project prunes folders and files."""
        folders: dict[str, list[str]] = {}
        for project, folder in self._manifest(version).items():
            folders.setdefault(folder, []).append(project or ROOT)

        def table(name: str) -> DataFrame:
            out = self.spark.createDataFrame([], TABLES[name])
            for folder, projects in sorted(folders.items()):
                part = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/data/{folder}/{name}").filter(F.col("project").isin(projects))
                out = out.unionByName(part.withColumn("project", F.when(F.col("project") != ROOT, F.col("project")).otherwise("")))
            return out

        return to_query_form(*(table(n) for n in TABLES))

    def upsert(self, new: Index) -> int:
        """Replace all rows of the files in `new`."""
        projects = [r.project for r in new.files.select("project").distinct().collect()]
        return self.write(maintain.upsert(self.read(), new), projects)

    def delete_project(self, project: str) -> int:
        return self._publish({p: f for p, f in self._manifest().items() if p != project})

    def compact(self, most: int = FOLDERS) -> int | None:
        """Merge the folders with the fewest projects into one, where a version takes rows from more than `most`; the new version, if any.

        About half of the folders stay as they are, so each project is rewritten once in
        a while and reading plans stay short.
        """
        held: dict[str, list[str]] = {}
        for project, folder in self._manifest().items():
            held.setdefault(folder, []).append(project)
        if len(held) <= most:
            return None
        small = sorted(held.values(), key=len)[: len(held) - most // 2]
        return self.write(self.read(), [p for projects in small for p in projects])
