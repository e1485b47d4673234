"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language.
EXTENSIONS = {
    "python": ["py", "pyi", "pyw"],
    "rust": ["rs"],
    "javascript": ["js", "mjs", "cjs", "jsx"],
    "typescript": ["ts", "mts", "cts"],
    "tsx": ["tsx"],
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx", "hh", "h++"],
    "ruby": ["rb", "rake", "gemspec"],
    "csharp": ["cs"],
    "markdown": ["md", "markdown"],
    "html": ["html", "htm"],
    "vue": ["vue"],
    "svelte": ["svelte"],
    "astro": ["astro"],
}
BY_EXTENSION = {e: lang for lang, es in EXTENSIONS.items() for e in es}


def detect(path: Column) -> Column:
    """The language of a path, null if its extension is unknown; case-sensitive."""
    known = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    name = F.substring_index(path, "/", -1)
    return known[F.when(F.instr(name, ".") > 1, F.substring_index(name, ".", -1))]


def of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return BY_EXTENSION.get(name.rsplit(".", 1)[1]) if name.rfind(".") > 0 else None
