"""Results as text and JSON: row formats as Column expressions, the directory tree on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.text import let

PREVIEW, BAR = 40, "  │ "
HIDDEN = ("tokens",)


def span(start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), start.cast("string"), F.when(end != start, F.concat(F.lit("-"), end.cast("string"))).otherwise(F.lit("")), F.lit("]"))


def search_line() -> Column:
    """One line for a search result of any type."""
    where = F.concat(F.col("file"), span(F.col("line_start"), F.col("line_end")))
    preview = F.replace(F.left("text", F.lit(PREVIEW)), F.lit("\n"), F.lit(" "))
    cut = F.when(F.length("text") > PREVIEW, F.concat(preview, F.lit("..."))).otherwise(preview)
    return F.when(F.col("type") == "symbol", F.concat_ws(" ", where, F.lit("symbol"), F.col("name"))).when(F.col("type") == "text", F.concat_ws(" ", where, F.lit("text"), F.col("kind"), cut)).otherwise(F.concat(F.col("file"), F.lit(" file ("), F.coalesce("kind", F.lit("unknown")), F.lit(")")))


def symbol_line() -> Column:
    return F.concat_ws(" ", F.concat(F.col("file"), span(F.col("line_start"), F.col("line_end"))), F.col("kind"), F.col("name"))


def ref_line() -> Column:
    where = F.concat(F.col("file"), span(F.col("line_start"), F.col("line_end")))
    return F.concat_ws(" ", where, F.lit("ref"), F.col("kind"), F.coalesce("caller", F.lit("(top-level)")), F.lit("->"), F.col("name"))


def snippet_block(text: Column) -> Column:
    """A snippet without its common indent, each line behind a bar, and a blank line."""
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))

    def shown(lines: Column, least: Column) -> Column:
        return F.transform(lines, lambda x: F.concat(F.lit(BAR), F.when(indent(x) >= least, F.substr(x, least + 1)).otherwise(F.ltrim(x))))

    def block(lines: Column) -> Column:
        least = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), indent)), F.lit(0))
        return let(least, lambda n: F.array_join(shown(lines, n), "\n"))  # once for a text, not for each of its lines

    return F.when(text.isNotNull(), F.concat(let(F.split(text, "\n"), block), F.lit("\n")))


def json_line(df: DataFrame) -> DataFrame:
    """Each row as JSON; null fields and the search tokens are left out."""
    return df.select(F.to_json(F.struct(*(c for c in df.columns if c not in HIDDEN))).alias("json"))


def tree(name: str, directories: list[tuple[str, list[str]]]) -> str:
    """Directories with their entries as a tree: directories before files, chains of single directories on one line."""
    root: dict = {"dirs": {}, "files": []}
    for path, entries in directories:
        node = root
        for part in [] if path in ("", ".") else path.split("/"):
            node = node["dirs"].setdefault(part, {"dirs": {}, "files": []})
        node["files"] += entries
    lines = [name]

    def walk(node: dict, indent: str) -> None:
        items: list[tuple[str, dict | None]] = []
        for part, below in sorted(node["dirs"].items()):
            while not below["files"] and len(below["dirs"]) == 1:
                (more, below), = below["dirs"].items()
                part = f"{part}/{more}"
            items.append((part + "/", below))
        items += [(f, None) for f in node["files"]]
        for k, (label, below) in enumerate(items):
            last = k == len(items) - 1
            lines.append(indent + ("└── " if last else "├── ") + label)
            if below is not None:
                walk(below, indent + ("    " if last else "│   "))

    walk(root, "")
    return "\n".join(lines)
