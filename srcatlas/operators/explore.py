"""Directory overview of a project under a visibility and an entry budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.operators.lookup import hidden
from srcatlas.plans.schema import PRIVATE, Index, base_name, max_level

MAX_ENTRIES = 200


def under(path: str | None):
    """The predicate of a path prefix: everything below it, at any depth."""
    clean = (path or "").rstrip("/")
    return F.lit(True) if not clean else F.col("path").startswith(clean + "/")


def file_levels(ix: Index, project: str, path: str | None = None, dots: bool = False) -> DataFrame:
    """(parent_path, path, lang, min_vis) of a project's files; a file without symbols has the last level.

    Symbols are reduced to one row per file before the join.
    """
    files = ix.files.filter((F.col("project") == project) & under(path))
    files = files if dots else files.filter(~hidden(F.col("path")))
    least = ix.symbols.filter(F.col("project") == project).groupBy(F.col("file").alias("path")).agg(F.min("visibility_level").alias("v"))
    return files.join(least, "path", "left").select("parent_path", "path", "lang", F.coalesce("v", F.lit(PRIVATE)).alias("min_vis"))


def overview(ix: Index, project: str, path: str | None = None) -> DataFrame:
    """Numbers of files by directory, language and least visibility level."""
    levels = file_levels(ix, project, path)
    return levels.groupBy("parent_path", "lang", "min_vis").agg(F.count(F.lit(1)).alias("n_files")).orderBy("parent_path", "lang", "min_vis")


def capped_files(ix: Index, project: str, cap: int | None, path: str | None = None, visibility: str | None = "public") -> DataFrame:
    """The first `cap` files, by path, of each directory and language; dot paths are included, unknown languages not."""
    level = max_level(visibility, "public")
    found = file_levels(ix, project, path, dots=True).filter(F.col("lang").isNotNull())
    found = found if level is None else found.filter(F.col("min_vis") <= level)
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("parent_path", "lang").orderBy("path"))
        found = found.withColumn("rn", rank).filter(F.col("rn") <= cap)
    return found.select("parent_path", base_name(F.col("path")).alias("filename"), "lang", "path").orderBy("parent_path", "lang", "path")


def totals(ix: Index, project: str, path: str | None = None, visibility: str | None = "public") -> DataFrame:
    """One row: files that the filter lets through and the groups they form."""
    level = max_level(visibility, "public") or PRIVATE
    seen = (F.col("min_vis") <= level) & F.col("lang").isNotNull()
    return overview(ix, project, path).agg(
        F.coalesce(F.sum(F.when(seen, F.col("n_files"))), F.lit(0)).alias("total_visible_files"),
        F.count(F.when(seen, F.lit(1))).alias("num_visible_groups"),
    )


def cap_of(total: int, groups: int, max_entries: int = MAX_ENTRIES) -> int | None:
    """Files of each group that fit the budget; None if all do."""
    return None if total <= max_entries else max(1, max_entries // max(groups, 1))


def cap_row(ix: Index, project: str, path: str | None = None, visibility: str | None = "public", max_entries: int = MAX_ENTRIES) -> DataFrame:
    t = totals(ix, project, path, visibility)
    share = F.greatest(F.lit(1), F.floor(F.lit(max_entries) / F.greatest("num_visible_groups", F.lit(1))))
    return t.withColumn("cap", F.when(F.col("total_visible_files") > max_entries, share).cast("long"))


def remainders(ix: Index, project: str, cap: int | None, path: str | None = None, visibility: str | None = "public") -> DataFrame:
    """Files of each directory and language that the capped listing leaves out, hidden ones included."""
    total = overview(ix, project, path).groupBy("parent_path", "lang").agg(F.sum("n_files").alias("total"))
    fetched = capped_files(ix, project, cap, path, visibility).groupBy("parent_path", "lang").agg(F.count(F.lit(1)).alias("fetched"))
    same = total["parent_path"].eqNullSafe(fetched["parent_path"]) & total["lang"].eqNullSafe(fetched["lang"])
    left = F.greatest(total["total"] - F.coalesce(fetched["fetched"], F.lit(0)), F.lit(0))
    found = total.join(fetched, same, "left").select(total["parent_path"], F.coalesce(total["lang"], F.lit("other")).alias("lang"), left.alias("remaining"))
    return found.filter("remaining > 0").orderBy("parent_path", "lang")


def directories(ix: Index, project: str, cap: int | None, path: str | None = None, visibility: str | None = "public") -> DataFrame:
    """Every directory of the project with its listed files and `+N lang files` lines, empty ones too."""
    every = overview(ix, project).select("parent_path").distinct()
    named = capped_files(ix, project, cap, path, visibility).groupBy("parent_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "filename"))), lambda x: x["filename"]).alias("files"))
    rest = remainders(ix, project, cap, path, visibility).groupBy("parent_path").agg(F.array_sort(F.collect_list(F.concat(F.lit("+"), F.col("remaining").cast("string"), F.lit(" "), F.col("lang"), F.lit(" files")))).alias("more"))
    empty = F.array().cast("array<string>")
    out = every.join(named, "parent_path", "left").join(rest, "parent_path", "left")
    return out.select("parent_path", F.coalesce("files", empty).alias("files"), F.coalesce("more", empty).alias("more")).orderBy("parent_path")


def subprojects(ix: Index, project: str) -> DataFrame:
    """Projects below this one, at any depth; for the root all that are not the root."""
    inside = (F.col("project") != "") if not project else F.col("project").startswith(project.rstrip("/") + "/")
    return ix.files.select("project").distinct().filter(inside).orderBy("project")


def resolve(projects: list[str], project: str | None, path: str | None) -> tuple[str, str | None]:
    """The project that a path means: if none is given, the first known one that is the path or a prefix of it, and the rest of the path."""
    if project is None and path:
        clean = path.rstrip("/")
        for p in sorted(projects):
            if p and (clean == p or clean.startswith(p + "/")):
                return p, clean[len(p) + 1 :] or None
    return project or "", path


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the deepest root that contains it (null if none); roots are joined on the path's spelled-out ancestors."""
    parts = F.split(F.col(path), "/")
    depth = F.sequence(F.lit(0), F.size(parts))
    ancestors = F.transform(depth, lambda n: F.struct(F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("root"), n.alias("depth")))
    spread = paths.withColumn("__a", F.explode(ancestors)).select(F.col(path).alias("path"), "__a.root", "__a.depth")
    known = roots.select(F.col(root).alias("root"), F.lit(True).alias("known")).distinct()
    return spread.join(known, "root", "left").groupBy("path").agg(F.max_by("root", F.when(F.col("known"), F.col("depth"))).alias("root"))
