"""Titles and descriptions of files."""

from __future__ import annotations

import re

from srcatlas.extract import markdown
from srcatlas.extract.base import clean_block, unquote
from srcatlas.extract.lexer import tokens

DECORATION = re.compile(r"^[\s=\-*#~_/+]*$")
COPYRIGHT = re.compile(r"copyright|licen[sc]e|spdx|all rights reserved", re.I)


def first_line(text: str) -> str:
    return text.strip().split("\n", 1)[0].strip()


def first_sentence(text: str) -> str:
    m = re.match(r"(?s)(.*?\.)(?:\s|$)", text.strip())
    return (m[1] if m else text).strip()


def split(text: str) -> tuple[str | None, str | None]:
    """(title, description) of a documentation text: its first telling line, and the first sentence of the paragraph after it."""
    lines = [x for x in text.strip().split("\n")]
    while lines and DECORATION.match(lines[0]):
        lines.pop(0)
    if not lines:
        return None, None
    title, rest = lines[0].strip(), "\n".join(lines[1:]).strip("\n")
    paragraph = re.split(r"\n\s*\n", rest.strip())[0] if rest.strip() else ""
    words = " ".join(x.strip() for x in paragraph.split("\n") if not DECORATION.match(x))
    return title, first_sentence(words) or None if words else None


def _jsdoc(text: str) -> str:
    out, keep = [], True
    for line in text.split("\n"):
        m = re.match(r"\s*@(\w+)\s*(.*)", line)
        if m:
            keep = m[1] in ("description", "fileoverview")
            line = m[2]
        if keep:
            out.append(line)
    return "\n".join(out).strip()


def _leading(source: str, language: str) -> list[str]:
    """The comments before any code."""
    out = []
    for t in tokens(source, language):
        if t.kind != "comment":
            break
        out.append(t.text)
    return out


def of(source: str, language: str | None) -> tuple[str | None, str | None]:
    if not language or language in ("html", "vue", "svelte", "astro"):
        return None, None
    if language == "markdown":
        return _markdown(source)
    if language == "python":
        first = next((t for t in tokens(source, "python") if t.kind != "comment"), None)
        return split(unquote(first.text)) if first and first.kind == "string" else (None, None)
    comments = _leading(source, language)
    if language == "rust":
        doc = [clean_block(c) if c.startswith("/*!") else c[3:].strip() for c in comments if c.startswith(("//!", "/*!"))]
    elif language in ("javascript", "typescript", "tsx", "java"):
        doc = [_jsdoc(clean_block(c)) for c in comments[:1] if c.startswith("/**")]
    elif language == "go":
        head = source[: m.start()] if (m := re.search(r"(?m)^package\b", source)) else ""
        doc = [clean_block(c) if c.startswith("/*") else c[2:].strip() for c in _leading(head, language)] if head.rstrip("\n") == head or head.endswith("\n") and not head.endswith("\n\n") else []
    elif language in ("c", "cpp"):
        doc = [clean_block(c) if c.startswith("/*") else c.lstrip("/!").strip() for c in comments]
        doc = [] if doc and all(COPYRIGHT.search(x) or DECORATION.match(x) for x in "\n".join(doc).split("\n")[:3]) else doc
    elif language == "ruby":
        doc = [c[1:].strip() for c in comments if not c.startswith("#!") and not re.match(r"#\s*(-\*-|frozen_string_literal|(en)?coding)", c)]
    elif language == "csharp":
        said = "\n".join(c[3:].strip() for c in comments if c.startswith("///"))
        m = re.search(r"(?s)<summary>(.*?)</summary>", said)
        doc = [re.sub(r"<[^>]+>", "", m[1] if m else said).strip()]
    else:
        doc = []
    text = "\n".join(doc).strip()
    return split(text) if text else (None, None)


def _markdown(source: str) -> tuple[str | None, str | None]:
    lines = source.split("\n")
    front = markdown._front_matter(lines)
    said = dict(re.findall(r"(?m)^(title|description):\s*[\"']?(.*?)[\"']?\s*$", "\n".join(lines[1 : max(front - 1, 1)]))) if front else {}
    found = markdown.headings(lines)
    title = said.get("title") or (found[0][2] if found else None)
    description = said.get("description")
    if not description and found:
        after = next((x.strip() for x in lines[found[0][3] :] if x.strip()), "")
        description = first_sentence(after) if after and not after.startswith(("#", "```", "~~~")) else None
    return title or None, description or None
