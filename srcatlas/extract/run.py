"""One table function over files: content in, rows of all four relations out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcatlas.extract import base, curly, markdown, metadata, python, ruby, sfc
from srcatlas.functions.blake3 import short_hashes
from srcatlas.plans.schema import FILES, REFS, SYMBOLS, TEXTS, Index, to_query_form
from srcatlas.sources import languages

EXTRACTORS = {"python": python.extract, "ruby": ruby.extract, "markdown": markdown.extract, **{k: curly.extract for k in curly.READERS}}
BATCH = 200  # files hashed side by side
EMBEDDING = ("html", "vue", "svelte", "astro")


def parse(source: str, language: str) -> base.Extracted:
    """Symbols, texts and references of one file; ValueError for a language without an extractor."""
    if language in EMBEDDING:
        out = base.Extracted()
        for block in sfc.blocks(source, language):
            out.extend(EXTRACTORS[block.language](block.source, block.language), block.start_line - 1)
    elif language in EXTRACTORS:
        out = EXTRACTORS[language](source, language)
    else:
        raise ValueError(f"no extractor for {language!r}")
    out.texts = base.merge_texts(out.texts)
    return out


def line_count(source: str) -> int:
    return source.count("\n") + (1 if source and not source.endswith("\n") else 0)


def found_in(source: str, language: str | None) -> base.Extracted:
    """What `parse` finds; nothing without a language or in a file that can't be parsed, which keeps its file row."""
    try:
        return parse(source, language) if language else base.Extracted()
    except (RecursionError, IndexError, ValueError):
        return base.Extracted()


def arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow(kind.elementType))
    return pa.string() if isinstance(kind, T.StringType) else pa.int32()


def structs(columns: dict[str, list], schema: T.StructType) -> pa.StructArray:
    """One typed array for each field, side by side."""
    return pa.StructArray.from_arrays([pa.array(columns[f.name], arrow(f.dataType)) for f in schema], fields=list(arrow(schema)))


def per_file(found: list[list], columns: dict[str, list], schema: T.StructType) -> pa.ListArray:
    """The rows of all files as one array, cut by file."""
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs(columns, schema))


def extracted(projects: list[str], paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
    """One row per file: its file row and the lists of its symbols, texts and references, as typed arrays."""
    sources = [c.decode("utf-8", "replace").removeprefix("\ufeff") for c in contents]
    langs = [languages.of(path) for path in paths]
    about = [metadata.of(source, lang) for source, lang in zip(sources, langs, strict=True)]
    files = {"project": projects, "path": paths, "lang": langs, "hash": short_hashes(contents), "lines": [line_count(x) for x in sources], "title": [x for x, _ in about], "description": [x for _, x in about]}
    found = [found_in(source, lang) for source, lang in zip(sources, langs, strict=True)]
    arrays = [structs(files, FILES)]
    for name, schema in (("symbols", SYMBOLS), ("texts", TEXTS), ("refs", REFS)):
        lists = [getattr(x, name) for x in found]
        every = [(k, x) for k, own in enumerate(lists) for x in own]
        columns = {"project": [projects[k] for k, _ in every], "file": [paths[k] for k, _ in every], "line": [[x.start, x.end] for _, x in every]}
        columns |= {f.name: [getattr(x, f.name) for _, x in every] for f in schema if f.name not in columns}
        arrays.append(per_file(lists, columns, schema))
    return pa.RecordBatch.from_arrays(arrays, ["files", "symbols", "texts", "refs"])


def extract(files: DataFrame) -> DataFrame:
    """files (project, path, content binary) to one row each: files struct, and arrays of structs symbols, texts, refs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                projects, paths, contents = (c.to_pylist() for c in batch.slice(lo, BATCH).columns)
                yield extracted([p or "" for p in projects], paths, [bytes(c or b"") for c in contents])

    many = lambda name, schema: T.StructField(name, T.ArrayType(schema))
    made = T.StructType([T.StructField("files", FILES), many("symbols", SYMBOLS), many("texts", TEXTS), many("refs", REFS)])
    return files.select("project", "path", F.col("content").cast("binary").alias("content")).mapInArrow(task, made)


def hashes(files: DataFrame) -> DataFrame:
    """(project, path, hash) of files (project, path, content binary)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), BATCH):
                part = batch.iloc[lo : lo + BATCH]
                yield pd.DataFrame({"project": part["project"], "path": part["path"], "hash": short_hashes([bytes(c or b"") for c in part["content"]])})

    return files.select("project", "path", F.col("content").cast("binary")).mapInPandas(task, "project string, path string, hash string")


def build(files: DataFrame) -> Index:
    """The index of a table of files. The extraction is one pass; its result is persisted, as it is read four times, each time one column."""
    return relations(extract(files).persist())


def relations(made: DataFrame) -> Index:
    """The index of what `extract` has found."""
    return to_query_form(made.select("files.*"), *(made.select(F.inline(name)) for name in ("symbols", "texts", "refs")))
