"""Table functions for SQL: extraction of one file's content.

    register(spark)
    SELECT s.* FROM sources, LATERAL extract_symbols(path, content) s
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SYMBOL = "name string, kind string, line_start int, line_end int, parent string, tokens string, alias string, visibility string"
TEXT = "kind string, line_start int, line_end int, text string, parent string"
REF = "name string, kind string, line_start int, line_end int, caller string"


def _extracted(path: str | None, content: str | None):
    from srcatlas.extract import base, run
    from srcatlas.sources import languages

    language = languages.of(path or "")
    return run.parse(content or "", language) if language else base.Extracted()


class Symbols:
    def eval(self, path: str, content: str) -> Iterator[tuple]:
        for s in _extracted(path, content).symbols:
            yield s.name, s.kind, s.start, s.end, s.parent, s.tokens, s.alias, s.visibility


class Texts:
    def eval(self, path: str, content: str) -> Iterator[tuple]:
        for t in _extracted(path, content).texts:
            yield t.kind, t.start, t.end, t.text, t.parent


class Refs:
    def eval(self, path: str, content: str) -> Iterator[tuple]:
        for r in _extracted(path, content).refs:
            yield r.name, r.kind, r.start, r.end, r.caller


def register(spark: SparkSession) -> None:
    for name, handler, schema in (("extract_symbols", Symbols, SYMBOL), ("extract_texts", Texts, TEXT), ("extract_refs", Refs, REF)):
        spark.udtf.register(name, udtf(handler, returnType=schema))
