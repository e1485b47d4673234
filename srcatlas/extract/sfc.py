"""Scripts embedded in HTML, Vue, Svelte and Astro files."""

from __future__ import annotations

import re
from dataclasses import dataclass

OPEN = re.compile(r"<script(?=[ \t\n\r>])([^>]*)>", re.I)
CLOSE = re.compile(r"</script\s*>", re.I)
LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""", re.I)
# What a script's lang attribute means.
LANGUAGES = {"ts": "typescript", "typescript": "typescript", "tsx": "tsx", "js": "javascript", "javascript": "javascript", "jsx": "javascript"}


@dataclass
class Block:
    language: str
    start_line: int
    source: str


def blocks(source: str, language: str) -> list[Block]:
    """Non-blank scripts; an Astro file's front matter is TypeScript, and so are its scripts by default."""
    out: list[Block] = []
    at = 0
    if language == "astro" and (m := re.match(r"\s*---[ \t]*\r?\n", source)):
        end = re.compile(r"^---[ \t]*$", re.M).search(source, m.end())
        if end:
            out.append(Block("typescript", source.count("\n", 0, m.end()) + 1, source[m.end() : end.start()]))
            at = end.end()
    while m := OPEN.search(source, at):
        end = CLOSE.search(source, m.end())
        stop = end.start() if end else len(source)
        said = LANG.search(m[1])
        kind = LANGUAGES.get(said[1].lower(), "javascript") if said else "typescript" if language == "astro" else "javascript"
        out.append(Block(kind, source.count("\n", 0, m.end()) + 1, source[m.end() : stop]))
        at = end.end() if end else len(source)
    return [b for b in out if b.source.strip()]
