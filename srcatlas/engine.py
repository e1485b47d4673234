"""The seven tools over an index, with their defaults."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas import ship
from srcatlas.extract.run import build, extract, hashes, relations
from srcatlas.functions.blake3 import short_hashes
from srcatlas.operators import explore as X
from srcatlas.operators import lookup, maintain, render, search, snippets
from srcatlas.operators.postings import PostingIndex
from srcatlas.operators.suffixes import SuffixIndex
from srcatlas.plans.schema import Index
from srcatlas.sources import jsonl, listing, locks, manifests
from srcatlas.sources.store import SnapshotStore, shared_folder

CUT = 8  # maintenance steps after which a plan without a store is cut


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class CodeIndex:
    """An index, the contents of its files for snippets, and the projects that have changed since the last flush.

    With a store, each maintenance step is a new version of it, and the index is read from
    there; without one the index is a plan over what it was made from.
    """

    def __init__(self, spark: SparkSession, index: Index, sources: DataFrame | None = None, root: str | None = None, store: SnapshotStore | None = None) -> None:
        self.spark, self.index, self.sources, self.root, self.store = spark, index, sources, root, store
        self.dirty: set[str] = set()
        self.locked: set[str] = set()  # projects that another process writes
        self._held: dict[str, IO] = {}
        self._writing = threading.RLock()
        self._steps = 0
        self._lists: PostingIndex | None = None
        self._tails: dict[str, SuffixIndex] = {}
        if store is not None:
            store.write(index)
            self.index = store.read()

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, store: SnapshotStore | None = None) -> CodeIndex:
        ship.ensure(spark)
        files = listing.with_content(listing.listing(spark, root)).persist()
        index = build(files)
        out = cls(spark, index, files.select("project", "path", F.decode(F.col("content"), "UTF-8").alias("content")), root, store)
        out.dirty = {r.project for r in lookup.list_projects(out.index).collect()}
        return out

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str) -> CodeIndex:
        return cls(spark, jsonl.read(spark, folder))

    def _enrich(self, df: DataFrame, context_lines: int | None) -> DataFrame:
        if self.sources is None:
            return df
        page = snippets.existing(df, self.sources) if "type" not in df.columns else df
        return snippets.with_snippets(page, self.sources, snippets.context_lines(context_lines))

    # The tools.
    def search(self, query: str, scope: list[str] | None = None, kind: list[str] | None = None, path: str | None = None, project: str | None = None, visibility: str = "public", limit: int = search.LIMIT, offset: int = 0, context_lines: int | None = None) -> DataFrame:
        if self._lists is None:
            self._lists = PostingIndex(self.spark, f"{shared_folder(self.spark)}/postings-{uuid.uuid4().hex}")
            self._lists.build(self.index)
        found = self._lists.search(query, scope, kind, path, project, visibility, limit, offset)
        if self.sources is None:
            return found
        alive = self.sources.select("project", F.col("path").alias("file"), F.lit(True).alias("__alive"))
        kept = found.join(alive, ["project", "file"], "left").filter((F.col("type") != "symbol") | F.col("__alive")).drop("__alive")
        shown = self._enrich(kept, context_lines)
        return shown.withColumn("snippet", F.when(F.col("type") == "symbol", F.col("snippet"))).orderBy("score", F.length("name"), "type", "project", "file", "line_start")

    def get_file_symbols(self, file: str, visibility: str = "public", limit: int = lookup.LIMIT, offset: int = 0, context_lines: int | None = None) -> DataFrame:
        return self._enrich(lookup.file_symbols(self.index, file, visibility, limit, offset), context_lines)

    def get_children(self, file: str, parent: str, visibility: str = "public", context_lines: int | None = None) -> DataFrame:
        return self._enrich(lookup.children(self.index, file, parent, visibility), context_lines)

    def _find(self, column: str) -> Callable[[str], DataFrame]:
        """References by the suffixes of a column, which are stored when they are first asked for after a change."""
        if column not in self._tails:
            self._tails[column] = SuffixIndex(self.spark, f"{shared_folder(self.spark)}/suffixes-{uuid.uuid4().hex}", column)
            self._tails[column].build(self.index.refs)
        return self._tails[column].find

    def get_callers(self, name: str, kind: str | None = None, project: str | None = None, visibility: str = "private", limit: int = lookup.LIMIT, offset: int = 0, context_lines: int | None = None) -> DataFrame:
        return self._enrich(lookup.callers(self.index, name, kind, project, visibility, limit, offset, self._find("name")), context_lines)

    def get_callees(self, caller: str, kind: str | None = None, project: str | None = None, visibility: str = "private", limit: int = lookup.LIMIT, offset: int = 0, context_lines: int | None = None) -> DataFrame:
        return self._enrich(lookup.callees(self.index, caller, kind, project, visibility, limit, offset, self._find("caller")), context_lines)

    def explore(self, path: str | None = None, project: str | None = None, visibility: str = "public", max_entries: int = X.MAX_ENTRIES) -> dict:
        projects = [r.project for r in lookup.list_projects(self.index).collect()]
        project, path = X.resolve(projects, project, path)
        if project not in projects:
            raise LookupError(f"project not found: {project!r}")
        t = X.totals(self.index, project, path, visibility).first()
        cap = X.cap_of(t.total_visible_files, t.num_visible_groups, max_entries)
        found = X.directories(self.index, project, cap, path, visibility).collect()
        about = manifests.metadata(os.path.join(self.root, project)) if self.root else manifests.Metadata(project or "root")
        below = [r.project for r in X.subprojects(self.index, project).collect()]
        return {"project": project, "name": about.name, "description": about.description, "manifests": about.files, "subprojects": below, "directories": [(r.parent_path, list(r.files) + list(r.more)) for r in found]}

    def _base(self, project: str) -> str:
        return os.path.join(self.root or ".", project)

    def lock(self) -> None:
        """Become the writer of all projects; those that another process writes are `locked`."""
        for r in lookup.list_projects(self.index).collect():
            if r.project not in self._held:
                held = locks.take(self._base(r.project))
                if held is None:
                    self.locked.add(r.project)
                else:
                    self.locked.discard(r.project)
                    self._held[r.project] = held

    def release(self) -> None:
        for held in self._held.values():
            held.close()
        self._held = {}

    def flush_index(self, projects: set[str] | None = None) -> int:
        """Write the projects (all, if none are given) that have changed and are not locked; errors leave a project dirty."""
        done = 0
        with self._writing:
            for project in sorted(self.dirty - self.locked if projects is None else self.dirty & projects - self.locked):
                base = self._base(project)
                try:
                    jsonl.write(self.index, os.path.join(base, listing.INDEX_FOLDER), project, os.path.basename(os.path.realpath(base)))
                except OSError:
                    continue
                self.dirty.discard(project)
                done += 1
        return done

    def answer_requests(self) -> int:
        """Flush the projects of ours that another process has asked for; how many. One that can't be written stays without an answer."""
        wanted = [p for p in self._held if locks.asked(self._base(p))]
        self.flush_index(set(wanted))
        answered = [p for p in wanted if p not in self.dirty]
        for project in answered:
            locks.answer(self._base(project))
        return len(answered)

    def watch_requests(self, stop: threading.Event) -> threading.Thread:
        """Answer requests in the background until `stop` is set."""

        def run() -> None:
            while not stop.wait(locks.POLL):
                self.answer_requests()

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    # Maintenance.
    def apply(self, events: DataFrame, read: Callable[[str, str], bytes | None] | None = None) -> None:
        """One maintenance step: debounced events (project, path, kind) of a micro-batch, which is small.

        A path that has vanished is only removed. A file whose hash is the stored one is
        left alone, and a step that changes nothing leaves its projects clean.
        """
        touched = events.select("project", "path", "kind").distinct()
        have = {(r.project, r.path): r.hash for r in self.index.files.join(F.broadcast(touched.select("project", "path").distinct()), ["project", "path"], "left_semi").select("project", "path", "hash").collect()}
        raw = {(r.project, r.path): None if r.kind == "remove" else (read or self._read)(r.project, r.path) for r in touched.orderBy(F.col("kind") != "remove").collect()}
        alive = {at: content for at, content in raw.items() if content is not None}
        fresh = dict(zip(alive, short_hashes(list(alive.values())), strict=True))
        changed = [(project, path, "modify" if (project, path) in alive else "remove") for project, path in raw if have.get((project, path)) != fresh.get((project, path))]
        if not changed:
            return
        files = self.spark.createDataFrame([(p, path, bytearray(alive[p, path])) for p, path, kind in changed if kind == "modify"], "project string, path string, content binary")
        named = self.spark.createDataFrame(changed, "project string, path string, kind string")
        projects = {p for p, _, _ in changed}
        with self._writing:
            made = extract(files).persist()
            own = self.index if self.store is None else self.index.map(lambda df, _: df.filter(F.col("project").isin(sorted(projects))))
            fresh_rows = relations(made)
            after = maintain.apply_events(own, named, fresh_rows)
            if self.sources is not None:
                content = files.select("project", "path", F.decode(F.col("content"), "UTF-8").alias("content"))
                self.sources = self.sources.join(named.select("project", "path"), ["project", "path"], "left_anti").unionByName(content)
            self._steps += 1
            if self.store is not None:
                self.store.write(after, sorted(projects))
                self.store.compact()
                self.index = self.store.read()
            else:
                self.index = after.map(lambda df, _: cut(df)) if self._steps % CUT == 0 else after
            if self.sources is not None and self._steps % CUT == 0:
                self.sources = cut(self.sources)
            self.dirty |= projects
            self._tails = {}
            if self._lists is not None:
                self._lists.apply(named, fresh_rows)
                self._lists.compact()

    def reconcile(self) -> None:
        """Bring the index up to what lies in the tree now, as after a time without events: files whose hash isn't stored are read again, those that have gone are removed, and files below a new project's root go to it."""
        found = hashes(listing.with_content(listing.listing(self.spark, self.root or "."))).persist()
        changed = maintain.changed_files(self.index.files, found).select("project", "path", F.lit("modify").alias("kind"))
        gone = self.index.files.join(found, ["project", "path"], "left_anti").select("project", "path", F.lit("remove").alias("kind"))
        self.apply(changed.unionByName(gone))
        found.unpersist()

    def _read(self, project: str, path: str) -> bytes | None:
        try:
            with open(os.path.join(self._base(project), path), "rb") as f:
                return f.read()
        except OSError:
            return None


def show(df: DataFrame, form: str = "json") -> str:
    """Rows as pretty JSON without null fields, or one text line (and its snippet) each."""
    if form == "json":
        return json.dumps([json.loads(r.json) for r in render.json_line(df).collect()], indent=2, ensure_ascii=False)
    line = render.search_line() if "type" in df.columns else render.ref_line() if "caller" in df.columns else render.symbol_line()
    block = render.snippet_block(F.col("snippet")) if "snippet" in df.columns else F.lit(None).cast("string")
    return "\n".join("\n".join(x for x in (r.line, r.block) if x is not None) for r in df.select(line.alias("line"), block.alias("block")).collect())
