"""Relations of the index: their stored and query forms."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1.0"
PUBLIC, INTERNAL, PRIVATE = 1, 2, 3

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "ints": T.ArrayType(T.IntegerType()), "strings": T.ArrayType(T.StringType())}


def struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


MANIFEST = struct(version="string", name="string", root="string", languages="strings")
FILES = struct(project="string", path="string", lang="string", hash="string", lines="int", title="string", description="string")
SYMBOLS = struct(project="string", file="string", name="string", kind="string", line="ints", parent="string", tokens="string", alias="string", visibility="string")
TEXTS = struct(project="string", file="string", kind="string", line="ints", text="string", parent="string")
REFS = struct(project="string", file="string", name="string", kind="string", line="ints", caller="string")
STORED = {"files": FILES, "symbols": SYMBOLS, "texts": TEXTS, "references": REFS}


def level_of(visibility: Column) -> Column:
    """public 1, internal 2, anything else 3."""
    return F.when(visibility == "public", PUBLIC).when(visibility == "internal", INTERNAL).otherwise(PRIVATE)


def max_level(visibility: str | None, default: str) -> int | None:
    """The level up to which rows pass; None lets all pass."""
    return {"public": PUBLIC, "internal": INTERNAL}.get(visibility or default)


def visible(df: DataFrame, visibility: str | None, default: str = "public") -> DataFrame:
    level = max_level(visibility, default)
    return df if level is None else df.filter(F.col("visibility_level") <= level)


def parent_path(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


@dataclass(frozen=True)
class Index:
    """The four relations in query form; `line` is split and the derived columns are there."""

    files: DataFrame
    symbols: DataFrame
    texts: DataFrame
    refs: DataFrame

    def map(self, f) -> Index:
        return Index(*(f(getattr(self, k), k) for k in ("files", "symbols", "texts", "refs")))

    def with_(self, **tables: DataFrame) -> Index:
        return replace(self, **tables)


def _lines(df: DataFrame) -> DataFrame:
    return df.withColumns({"line_start": F.col("line")[0], "line_end": F.col("line")[1]}).drop("line")


def to_query_form(files: DataFrame, symbols: DataFrame, texts: DataFrame, refs: DataFrame, project: str | None = None) -> Index:
    """Stored rows to query form; rows without a project belong to `project`."""
    own = lambda df: df.withColumn("project", F.coalesce("project", F.lit(project or ""))) if project is None else df.withColumn("project", F.lit(project))
    return Index(
        own(files).withColumn("parent_path", parent_path(F.col("path"))),
        _lines(own(symbols)).withColumn("visibility_level", level_of(F.col("visibility"))),
        _lines(own(texts)),
        _lines(own(refs)),
    )


def union(a: Index, b: Index) -> Index:
    return Index(*(x.unionByName(y, allowMissingColumns=True) for x, y in ((a.files, b.files), (a.symbols, b.symbols), (a.texts, b.texts), (a.refs, b.refs))))
