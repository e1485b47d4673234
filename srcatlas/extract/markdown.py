"""Markdown: headings become nested sections, code blocks become samples."""

from __future__ import annotations

import re

from srcatlas.extract.base import Extracted, Symbol, Text

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t ]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")


def clean(title: str) -> str:
    return " ".join(title.replace(" ", " ").split())


def headings(lines: list[str]) -> list[tuple[int, int, str, int]]:
    """(line from 1, level, title, last line of the heading), fenced code left out."""
    out, fence = [], None
    front = _front_matter(lines)
    for n, line in enumerate(lines, 1):
        if n <= front:
            continue
        m = FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence) and not m[2].strip():
                fence = None
            continue
        if m:
            fence = m[1]
        elif m := ATX.match(line):
            if clean(m[2] or ""):
                out.append((n, len(m[1]), clean(m[2]), n))
        elif (m := SETEXT.match(line)) and n > 1 and lines[n - 2].strip() and not ATX.match(lines[n - 2]) and not re.match(r"^\s*([-*+>|]|\d+\.)\s", lines[n - 2]) and n - 1 > front:
            out.append((n - 1, 1 if m[1][0] == "=" else 2, clean(lines[n - 2]), n))
    return out


def _front_matter(lines: list[str]) -> int:
    """The number of lines a leading `---` block takes."""
    if lines and lines[0].strip() == "---":
        for n, line in enumerate(lines[1:], 2):
            if line.strip() in ("---", "..."):
                return n
    return 0


def extract(source: str, language: str = "markdown") -> Extracted:
    out = Extracted()
    lines = source.split("\n")
    total = len(lines) - (lines[-1] == "")
    found = headings(lines)
    stack: list[tuple[int, str]] = []
    sections: list[tuple[int, str]] = []
    for k, (line, level, title, _) in enumerate(found):
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1][1] if stack else None
        full = f"{parent}/{title}" if parent else title
        end = next((f[0] - 1 for f in found[k + 1 :] if f[1] <= level), max(total, line))
        out.symbols.append(Symbol(full, "section", line, end, parent))
        stack.append((level, full))
        sections.append((line, full))
    fence, start, body = None, 0, []
    for n, line in enumerate(lines, 1):
        m = FENCE.match(line)
        if fence is None:
            if m:
                fence, start, body = m[1], n, []
        elif m and m[1].startswith(fence) and not m[2].strip():
            _sample(out, start, n, body, sections)
            fence = None
        else:
            body.append(line)
    if fence is not None:
        _sample(out, start, total, body, sections)
    return out


def _sample(out: Extracted, start: int, end: int, body: list[str], sections: list[tuple[int, str]]) -> None:
    text = "\n".join(body).strip("\n")
    if text.strip():
        parent = next((name for line, name in reversed(sections) if line < start), None)
        out.texts.append(Text("sample", start, end, text, parent))
