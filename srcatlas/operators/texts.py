"""Operators over extracted texts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_adjacent(texts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Join docstrings or comments that follow each other line by line in one file, kind and parent.

    Gaps and islands: a row opens an island unless the row before it, in the file's
    order, has the same kind and parent, is of a kind that merges, and ends on the line
    before. `order` makes that order total; by default line_start, line_end, kind, text.
    """
    keys = order or ["line_start", "line_end", "kind", "text"]
    w = Window.partitionBy("project", "file").orderBy(*keys)
    same = F.col("kind").isin("docstring", "comment") & (F.lag("kind").over(w) == F.col("kind")) & F.lag("parent").over(w).eqNullSafe(F.col("parent")) & (F.lag("line_end").over(w) + 1 == F.col("line_start"))
    marked = texts.withColumns({"__new": F.when(same, 0).otherwise(1), "__pos": F.row_number().over(w)})
    islands = marked.withColumn("__island", F.sum("__new").over(w))
    joined = islands.groupBy("project", "file", "kind", "parent", "__island").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return joined.select("project", "file", "kind", "line_start", "line_end", "text", "parent")


def heading_parents(headings: DataFrame, doc: str = "doc_id", line: str = "line_start", level: str = "level") -> DataFrame:
    """Each heading with the line of its parent: the nearest one before it of a smaller level.

    For every level at most the last line seen matters, so one running maximum per
    level (1 to 6) answers all headings in one pass over a window.
    """
    w = Window.partitionBy(doc).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.max(F.when(F.col(level) == n, F.col(line))).over(w) for n in range(1, 7)}
    marked = headings.withColumns({f"__l{n}": c for n, c in last.items()})
    parent = F.lit(None).cast("int")
    for n in range(2, 7):
        # greatest() skips nulls, so it is the latest of the smaller levels
        older = [F.col(f"__l{k}") for k in range(1, n)]
        parent = F.when(F.col(level) == n, F.greatest(*older) if len(older) > 1 else older[0]).otherwise(parent)
    return marked.withColumn("parent_line", parent).drop(*(f"__l{n}" for n in range(1, 7)))
