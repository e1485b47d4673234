"""Name and description of a project from its package manifests."""

from __future__ import annotations

import glob
import json
import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Metadata:
    name: str
    description: str | None = None
    files: list[str] = field(default_factory=list)


def package_json(text: str, folder: str) -> tuple[str | None, str | None]:
    data = json.loads(text)
    return (folder if data.get("private") is True else data.get("name")), data.get("description")


def cargo_toml(text: str, folder: str) -> tuple[str | None, str | None]:
    data = tomllib.loads(text)
    if "package" in data:
        own = data["package"]
        text_of = lambda v: v if isinstance(v, str) else None
        return text_of(own.get("name")), text_of(own.get("description"))
    return (folder, None) if "workspace" in data else (None, None)


def pyproject_toml(text: str, folder: str) -> tuple[str | None, str | None]:
    data = tomllib.loads(text)
    own = data.get("project") or data.get("tool", {}).get("poetry") or {}
    return own.get("name"), own.get("description")


def go_mod(text: str, folder: str) -> tuple[str | None, str | None]:
    m = re.search(r"(?m)^module\s+(\S+)", text)
    return (m[1].strip('"').rstrip("/").rsplit("/", 1)[-1] if m else None), None


def pom_xml(text: str, folder: str) -> tuple[str | None, str | None]:
    def first(tag: str) -> str | None:
        m = re.search(rf"<{tag}>([^<]*)</{tag}>", text)
        return m[1].strip() or None if m else None

    return first("name") or first("artifactId"), first("description")


def gemspec(text: str, folder: str) -> tuple[str | None, str | None]:
    def value(key: str) -> str | None:
        m = re.search(rf"\.{key}\s*=\s*(?:%q\{{([^}}]*)\}}|[\"']([^\"']*)[\"'])", text)
        return (m[1] or m[2]) if m else None

    return value("name"), value("summary") or value("description")


#: In order of precedence.
READERS = {"package.json": package_json, "Cargo.toml": cargo_toml, "pyproject.toml": pyproject_toml, "go.mod": go_mod, "pom.xml": pom_xml, "*.gemspec": gemspec}


BROKEN = (ValueError, AttributeError)


def metadata(root: str) -> Metadata:
    """The first name and the first description that a manifest gives; all manifests read are listed. A broken one is listed too."""
    folder = os.path.basename(os.path.realpath(root))
    name = description = None
    files: list[str] = []
    for pattern, reader in READERS.items():
        for path in sorted(glob.glob(os.path.join(glob.escape(root), pattern))):
            files.append(os.path.basename(path))
            try:
                with open(path, encoding="utf-8", errors="replace") as f:
                    own, said = reader(f.read(), folder)
            except BROKEN + (OSError,):
                continue
            name, description = name or own, description if description is not None else said
    return Metadata(name or folder, description, files)


def scan(files: DataFrame) -> DataFrame:
    """(project, name, description, files) of each project with a manifest at its root, from a table of files (project, path, content).

    As `metadata`, without a driver: the first name and description by precedence, then
    by path; a project without a name has its folder's. Other files are not parsed, null
    contents count as broken manifests, and repeated rows are listed once.
    """
    import pandas as pd

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for project, path, content in zip(batch["project"], batch["path"], batch["content"], strict=True):
                for rank, (pattern, reader) in enumerate(READERS.items()):
                    if fnmatchcase(path, pattern):
                        try:
                            name, said = reader(bytes(content or b"").decode("utf-8", "replace"), project.rsplit("/", 1)[-1])
                        except BROKEN:
                            name = said = None
                        made.append((project, path, rank, name, said))
            yield pd.DataFrame(made, columns=["project", "path", "rank", "name", "description"])

    likely = F.col("path").isin([p for p in READERS if "*" not in p]) | (F.col("path").endswith(".gemspec") & ~F.contains("path", F.lit("/")))
    own = files.select(F.coalesce("project", F.lit("")).alias("project"), "path", "content").filter(likely)
    read = own.mapInPandas(task, "project string, path string, rank int, name string, description string")
    at = F.struct("rank", "path")
    named, said = F.min_by("name", F.when(F.col("name") != "", at)), F.min_by("description", F.when(F.col("description").isNotNull(), at))
    listed = F.array_sort(F.collect_set(at))
    return read.groupBy("project").agg(named.alias("name"), said.alias("description"), listed.alias("files")).select("project", F.coalesce("name", F.substring_index("project", "/", -1)).alias("name"), "description", F.col("files.path").alias("files"))
