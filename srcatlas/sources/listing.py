"""Source trees as tables: walking, ignore rules, projects."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Always ignored.
BUILT_IN = [".git/", ".srcatlas/", ".vscode/", ".idea/", ".vs/", ".DS_Store", ".Spotlight-V100/", ".Trashes/"]
INDEX_FOLDER = ".srcatlas"


@dataclass
class Ignore:
    """Patterns in gitignore syntax, all relative to one root; the last that matches wins."""

    rules: list[tuple[re.Pattern[str], bool, bool]] = field(default_factory=list)

    def add(self, line: str) -> None:
        line = line.rstrip("\n").rstrip("\r")
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            return
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\")
        only_folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        if line:
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + self._regex(line)), negated, only_folder))

    @staticmethod
    def _regex(pattern: str) -> str:
        out, i = "", 0
        while i < len(pattern):
            if pattern.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif pattern.startswith("/**", i) and i + 3 == len(pattern):
                out, i = out + "/.*", i + 3
            elif pattern[i] == "*":
                while pattern[i : i + 1] == "*":
                    i += 1
                out += "[^/]*"
            elif pattern[i] == "?":
                out, i = out + "[^/]", i + 1
            elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
                end = pattern.index("]", i + 2)
                body = pattern[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            else:
                if pattern[i] == "\\" and i + 1 < len(pattern):
                    i += 1
                out, i = out + re.escape(pattern[i]), i + 1
        return out

    def add_file(self, path: str) -> None:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                for line in f:
                    self.add(line)
        except OSError:
            pass

    def _own(self, path: str, folder: bool) -> bool | None:
        verdict = None
        for pattern, negated, only_folder in self.rules:
            if (folder or not only_folder) and pattern.fullmatch(path):
                verdict = not negated
        return verdict

    def ignored(self, path: str, folder: bool) -> bool:
        """Whether the path or a folder above it is ignored."""
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            if self._own("/".join(parts[:k]), folder or k < len(parts)):
                return True
        return False


@dataclass
class Walk:
    files: list[str] = field(default_factory=list)
    projects: list[str] = field(default_factory=lambda: [""])


def walk(root: str) -> Walk:
    """Files of a tree (relative, with `/`) and the folders that are projects: the root, and those with a `.git`.

    Symbolic links are not followed, ignored folders not entered, and files whose name
    begins with a dot left out. A nested ignore file's patterns count from the root.
    """
    root = os.path.realpath(root)
    rules, out = Ignore(), Walk()
    for line in BUILT_IN:
        rules.add(line)
    rules.add_file(os.path.join(root, ".git/info/exclude"))
    todo = [""]
    while todo:
        folder = todo.pop()
        with os.scandir(os.path.join(root, folder)) as found:
            entries = sorted(found, key=lambda e: e.name)
        if any(e.name == ".gitignore" for e in entries):
            rules.add_file(os.path.join(root, folder, ".gitignore"))
        if folder and any(e.name == ".git" for e in entries):
            out.projects.append(folder)
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink() or e.name == ".git":
                continue
            if e.is_dir():
                if not rules.ignored(path, True):
                    todo.append(path)
            elif e.is_file() and not e.name.startswith(".") and not rules.ignored(path, False):
                out.files.append(path)
    out.files.sort()
    out.projects.sort()
    return out


def indexed(files: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """The files that a walk would find, from a table of paths: those not ignored by the built-in patterns or by `patterns`, whose name begins with no dot. A null path goes."""
    rules = Ignore()
    for line in BUILT_IN + patterns:
        rules.add(line)

    @F.pandas_udf("boolean")
    def ignored(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: p is None or rules.ignored(p, False)).astype(bool)

    return files.filter(~F.substring_index(path, "/", -1).startswith(".")).filter(~ignored(path))


def owner(projects: list[str], path: str) -> str:
    """The deepest project that holds a path."""
    return max((p for p in projects if not p or path == p or path.startswith(p + "/")), key=len, default="")


def listing(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """(project, path, full) of every file of a tree; paths are relative to their project. Only names pass the driver."""
    found = walk(root)
    rows = []
    for path in found.files:
        p = owner(found.projects, path)
        rows.append((p, path[len(p) + 1 :] if p else path, os.path.join(os.path.realpath(root), path)))
    df = spark.createDataFrame(rows, "project string, path string, full string")
    return df.repartition(partitions or spark.sparkContext.defaultParallelism)


def with_content(files: DataFrame) -> DataFrame:
    """Adds content binary, read by the executors; a file that has gone is left out. The tree must be on a shared file system."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = []
            for full in batch["full"]:
                try:
                    with open(full, "rb") as f:
                        content.append(f.read())
                except OSError:
                    content.append(None)
            out = batch.assign(content=content)
            yield out[out["content"].notna()]

    return files.mapInPandas(task, "project string, path string, full string, content binary")


def archive(spark: SparkSession, path: str) -> DataFrame:
    """A table (project, path, content) in Parquet, the form for corpora beyond one machine."""
    return spark.read.parquet(path).select("project", "path", "content")
