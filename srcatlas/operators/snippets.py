"""Source snippets for result rows, from a table of file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_LINES = 10


def context_lines(asked: int | None) -> int | None:
    """None is the default of 10, 0 becomes 1, a negative number means the full range."""
    if asked is None:
        return CONTEXT_LINES
    return None if asked < 0 else max(1, asked)


def snippet(content: Column, start: Column, end: Column, limit: int | None) -> Column:
    """Lines start..end (from 1, inclusive, clamped to the file) without blank ones, cut after `limit`; null if nothing is left."""
    lines = F.split(content, "\n")
    first = F.greatest(start, F.lit(1))
    own = F.when(first <= F.least(end, F.size(lines)), F.slice(lines, first, F.least(end, F.size(lines)) - first + 1)).otherwise(F.array().cast("array<string>"))
    kept = F.filter(own, lambda x: F.trim(x) != "")
    if limit is None:
        text = F.array_join(kept, "\n")
    else:
        text = F.concat(F.array_join(F.slice(kept, 1, limit), "\n"), F.when(F.size(kept) > limit, F.lit("\n...")).otherwise(F.lit("")))
    return F.when(F.size(kept) > 0, text)


def with_snippets(rows: DataFrame, sources: DataFrame, limit: int | None = CONTEXT_LINES) -> DataFrame:
    """rows (project, file, line_start, line_end, ...) with `snippet`; sources is (project, path, content). rows is a page, so it is small."""
    content = sources.select(F.col("project").alias("__p"), F.col("path").alias("__f"), F.col("content").alias("__c"))
    joined = rows.join(content, (F.col("project") == F.col("__p")) & (F.col("file") == F.col("__f")), "left")
    return joined.withColumn("snippet", snippet(F.col("__c"), F.col("line_start"), F.col("line_end"), limit)).drop("__p", "__f", "__c")


def existing(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose file is still there. Applied after the page is cut, so fewer rows than the limit may come back."""
    return rows.join(sources.select("project", F.col("path").alias("file")), ["project", "file"], "left_semi")
