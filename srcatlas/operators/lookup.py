"""Structural lookups: symbols of a file, children, callers, callees, projects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import glob
from srcatlas.plans.schema import Index, base_name, visible

SYMBOL = ["project", "file", "name", "kind", "line_start", "line_end", "parent", "tokens", "alias", "visibility"]
REF = ["project", "file", "name", "kind", "line_start", "line_end", "caller"]
LIMIT = 100


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("limit and offset must not be negative")
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def ordered(df: DataFrame, *keys: str, rest: list[str]) -> DataFrame:
    """By the keys, then by all other columns, so that a page is well defined."""
    return df.orderBy(*keys, *(c for c in rest if c not in keys))


def file_symbols(ix: Index, file: str, visibility: str | None = "public", limit: int | None = LIMIT, offset: int = 0) -> DataFrame:
    """Symbols of the files that match (a name or a GLOB pattern), in all projects."""
    found = visible(ix.symbols.filter(glob.matches(F.col("file"), file)), visibility).select(*SYMBOL)
    return page(ordered(found, "file", "line_start", rest=SYMBOL), limit, offset)


def children(ix: Index, file: str, parent: str, visibility: str | None = "public") -> DataFrame:
    found = visible(ix.symbols.filter((F.col("file") == file) & (F.col("parent") == parent)), visibility).select(*SYMBOL)
    return ordered(found, "line_start", rest=SYMBOL)


def named(column: Column, name: str) -> Column:
    """The name itself, case-sensitive, or a dotted name that ends in it, by LIKE rules: any case, `_` and `%` are wildcards."""
    return (column == name) | column.ilike("%." + name.replace("\\", "\\\\"))


def _semi_by_symbol(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Refs for which a symbol of their project has the ref's name, or a dotted name that LIKE '%.' || ref name matches.

    LIKE is no equality, so the symbols' dotted suffixes are spelled out and joined by
    key: in lower case for a ref without wildcards; by length and first character for
    one with `_`, which stands for one character and is common in names; by project
    alone only for one with `%`. The LIKE is checked on what the keys let through.
    """
    parts = F.split("name", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size("parts")), lambda i: F.lower(F.concat_ws(".", F.slice("parts", i, F.size("parts")))))
    names = symbols.select("project", "name").distinct()
    suffixes = names.withColumn("parts", parts).filter(F.size("parts") > 1).select("project", F.explode(tails).alias("tail")).distinct()
    keyed = suffixes.select("project", "tail", F.length("tail").alias("n"), F.substring("tail", 1, 1).alias("head")).alias("s")
    like = F.ilike(F.col("s.tail"), F.replace(F.col("r.name"), F.lit("\\"), F.lit("\\\\")))
    home = F.col("s.project") == F.col("r.project")
    asked = refs.select("project", "name").distinct()  # each name is looked up once, however many refs have it
    r = asked.alias("r")
    length, head = F.col("s.n") == F.length("r.name"), F.col("s.head") == F.lower(F.substring("r.name", 1, 1))
    kinds = {
        "plain": (~F.col("name").rlike("[%_]"), F.col("s.tail") == F.lower("r.name")),
        "inner": (F.col("name").rlike("^[^%_][^%]*_[^%]*$"), length & head & like),
        "first": (F.col("name").rlike("^_[^%]*$"), length & like),
        "any": (F.col("name").contains("%"), like),
    }
    found = asked.join(names, ["project", "name"], "left_semi")
    for own, match in kinds.values():
        found = found.unionByName(r.filter(own).join(keyed, home & match, "left_semi"))
    return refs.join(found.distinct(), ["project", "name"], "left_semi")


def _refs(ix: Index, found: DataFrame, kind: str | None, project: str | None, visibility: str | None, limit: int | None, offset: int) -> DataFrame:
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    if project is not None:
        found = found.filter(F.col("project") == project)
    found = found.select(*REF)
    seen = visible(ix.symbols, visibility, default="private")
    if seen is not ix.symbols:  # everything is visible to `private`: no join
        found = _semi_by_symbol(found, seen).distinct()
    return page(ordered(found, "file", "line_start", rest=REF), limit, offset)


def callers(ix: Index, name: str, kind: str | None = None, project: str | None = None, visibility: str | None = "private", limit: int | None = LIMIT, offset: int = 0, find: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """References to a name. `find` may give them from a stored index of suffixes; else all references are read."""
    found = find(name) if find else ix.refs.filter(named(F.col("name"), name))
    return _refs(ix, found, kind, project, visibility, limit, offset)


def callees(ix: Index, caller: str, kind: str | None = None, project: str | None = None, visibility: str | None = "private", limit: int | None = LIMIT, offset: int = 0, find: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """References from a name, as callers."""
    found = find(caller) if find else ix.refs.filter(named(F.col("caller"), caller))
    return _refs(ix, found, kind, project, visibility, limit, offset)


def list_projects(ix: Index) -> DataFrame:
    return ix.files.select("project").distinct().orderBy("project")


def dir_files(ix: Index, project: str, parent_path: str) -> DataFrame:
    own = ix.files.filter((F.col("project") == project) & (F.col("parent_path") == parent_path) & ~hidden(F.col("path")))
    return own.orderBy("path").select(base_name(F.col("path")).alias("filename"), "lang")


def hidden(path: Column) -> Column:
    """A dot at the start of any part of the path."""
    return path.rlike(r"(^|/)\.")


def file_hash(ix: Index, project: str, path: str) -> DataFrame:
    return ix.files.filter((F.col("project") == project) & (F.col("path") == path)).select("hash")
