"""What extractors make, and the text rules they share."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

# Words that never count as search tokens of a symbol.
STOPWORDS = frozenset(
    "foo bar baz qux tmp temp assert assert_eq assert_ne assert_match assert_equal assert_kind_of "
    "if else for while do switch case break continue return new default const true false "
    "class struct enum static void super this public private protected try catch throw in".split()
)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    parent: str | None = None
    tokens: str | None = None
    alias: str | None = None
    visibility: str | None = None


@dataclass
class Text:
    kind: str
    start: int
    end: int
    text: str
    parent: str | None = None


@dataclass
class Ref:
    name: str
    kind: str
    start: int
    end: int
    caller: str | None = None


@dataclass
class Extracted:
    symbols: list[Symbol] = field(default_factory=list)
    texts: list[Text] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)

    def extend(self, other: Extracted, lines: int = 0) -> None:
        """Add another extraction whose lines are `lines` further down here."""
        for own, new in ((self.symbols, other.symbols), (self.texts, other.texts), (self.refs, other.refs)):
            for x in new:
                x.start += lines
                x.end += lines
                own.append(x)


class Scopes:
    """Named ranges of token positions, nested; finds the innermost one around a position."""

    def __init__(self) -> None:
        self.ranges: list[tuple[int, int, str, bool]] = []
        self.order: list[int] | None = None

    def add(self, start: int, end: int, name: str, callable_: bool = True) -> None:
        self.ranges.append((start, end, name, callable_))
        self.order = None

    def around(self, position: int) -> str | None:
        if self.order is None:
            self.ranges.sort(key=lambda r: (r[0], -r[1]))
            self.order = [r[0] for r in self.ranges]
        k = bisect_right(self.order, position) - 1
        while k >= 0:
            if self.ranges[k][1] >= position:
                return self.ranges[k][2]
            k -= 1
        return None


def trivial(text: str) -> bool:
    t = text.strip()
    return len(t) <= 1 or (" " not in t and len(t.encode()) <= 20)


def clean_block(text: str) -> str:
    """A block comment without its delimiters and the stars that lead its lines."""
    body = re.sub(r"^/\*[*!]*|\*+/$", "", text.strip())
    lines = [re.sub(r"^\s*\*+ ?", "", x).strip() for x in body.split("\n")]
    return "\n".join(lines).strip()


def comment_text(raw: str, line: int, end: int, parent: str | None) -> Text | None:
    if raw.startswith(("///", "//!")):
        kind, text = "docstring", raw[3:].strip()
    elif raw.startswith("//"):
        kind, text = "comment", raw[2:].strip()
    elif raw.startswith("/*"):
        kind, text = ("docstring" if raw.startswith(("/**", "/*!")) else "comment"), clean_block(raw)
    elif raw.startswith("=begin"):
        kind, text = "comment", re.sub(r"^=begin|\n=end.*$", "", raw).strip()
    elif raw.startswith("#"):
        kind, text = "comment", raw[1:].strip()
    else:
        kind, text = "comment", raw
    return None if trivial(text) else Text(kind, line, end, text, parent)


def unquote(raw: str) -> str:
    """A literal without prefix and quotes."""
    m = re.match(r"(?s)^(?:[a-zA-Z$@]{0,3}#*)(\"\"\"|'''|\"|'|`)(.*)$", raw)
    if not m:
        return raw
    body = m[2]
    body = re.sub(r"#+$", "", body) if raw[:3].startswith(("r#", "br#")) else body
    return body[: -len(m[1])] if body.endswith(m[1]) else body


def string_text(raw: str, line: int, end: int, parent: str | None, kind: str = "string") -> Text | None:
    text = unquote(raw).strip()
    return None if trivial(text) else Text(kind, line, end, text, parent)


def token_set(words, stop: frozenset[str] = frozenset(), capitals: bool = True) -> str | None:
    """Distinct identifiers of two ASCII characters or more, sorted; without capitals, names in capitals are left out."""
    found = {w for w in words if len(w) >= 2 and IDENTIFIER.fullmatch(w) and w not in STOPWORDS and w not in stop}
    if not capitals:
        found = {w for w in found if w != w.upper()}
    return " ".join(sorted(found)) or None


def is_constant(name: str) -> bool:
    return len(name) > 1 and name == name.upper() and any(c.isalpha() for c in name)


def merge_texts(texts: list[Text]) -> list[Text]:
    """Docstrings and comments on successive lines, of one kind and parent, become one text."""
    out: list[Text] = []
    for t in texts:
        last = out[-1] if out else None
        if last and t.kind in ("docstring", "comment") and (last.kind, last.parent) == (t.kind, t.parent) and t.start == last.end + 1:
            last.end, last.text = t.end, f"{last.text}\n{t.text}"
        else:
            out.append(t)
    return out
