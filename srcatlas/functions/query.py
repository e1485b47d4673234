"""The full-text query language: a recursive-descent parser to a small syntax tree.

    query   := or_expr          or_expr  := and_expr (OR and_expr)*
    and_expr := not_expr (AND not_expr)*      not_expr := adjacent (NOT adjacent)*
    adjacent := primary+        (an implicit AND, which binds tightest)
    primary := [columns ':'] ( '(' query ')' | NEAR '(' phrase+ [',' n] ')' | ['^'] phrase )
    phrase  := string ('+' string)* ['*']
    columns := ['-'] (name | '{' name+ '}')

Operators are upper case. A bare word may hold letters, digits, `_` and characters
beyond ASCII; it and a quoted string become the phrase of their tokens. Before parsing,
`a|b` outside quotes becomes `(a OR b)`.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

COLUMNS = ("name", "file", "content")
NEAR_DISTANCE = 10


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = NEAR_DISTANCE


@dataclass(frozen=True)
class And:
    parts: tuple[object, ...] = field(default=())


@dataclass(frozen=True)
class Or:
    parts: tuple[object, ...] = field(default=())


@dataclass(frozen=True)
class Not:
    keep: object
    drop: object


def split_tokens(text: str) -> tuple[str, ...]:
    """The tokens of a string, as documents are tokenized."""
    folded = "".join(_fold(c) for c in text.lower())
    return tuple(re.findall(r"[^\W_]+", "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded)))


def _fold(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0] if 0xC0 <= ord(c) < 0x250 and unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<") else c


def expand_pipes(query: str) -> str:
    """`a|b|c` in a run without blanks to `(a OR b OR c)`; quoted text is left alone."""
    out: list[str] = []
    for run in re.findall(r'\s+|(?:"(?:[^"]|"")*"?|[^\s"])+', query):
        pieces = re.findall(r'"(?:[^"]|"")*"?|\||[^|"]+', run)
        if "|" not in pieces:
            out.append(run)
            continue
        parts, own = [], ""
        for p in [*pieces, "|"]:
            if p == "|":
                parts.append(own)
                own = ""
            else:
                own += p
        if len(pieces) > 0 and pieces[-1] == "|" or any(not p for p in parts):
            raise QuerySyntaxError("an empty alternative beside `|`")
        out.append("(" + " OR ".join(parts) + ")")
    return "".join(out)


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|([(){}:,+*^-]))')


class _Parser:
    def __init__(self, text: str) -> None:
        self.items: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise QuerySyntaxError(f"syntax error near {text[at:].strip()[:1]!r}")
            kind = "string" if m[1] is not None else "word" if m[2] is not None else "mark"
            value = m[1][1:-1].replace('""', '"') if m[1] is not None else m[2] or m[3]
            if kind == "word" and value in ("AND", "OR", "NOT"):
                kind = "operator"
            self.items.append((kind, value))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, *want: str) -> tuple[str, str]:
        item = self.peek()
        if want and item[1] not in want or item[0] == "end":
            raise QuerySyntaxError(f"syntax error near {item[1]!r}")
        self.at += 1
        return item

    def level(self, operator: str, below, make):
        parts = [below()]
        while self.peek() == ("operator", operator):
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else make(tuple(parts))

    def query(self):
        return self.level("OR", self.and_, Or)

    def and_(self):
        return self.level("AND", self.not_, And)

    def not_(self):
        out = self.adjacent()
        while self.peek() == ("operator", "NOT"):
            self.take()
            out = Not(out, self.adjacent())
        return out

    def adjacent(self):
        parts = [self.primary()]
        while (p := self.peek())[0] in ("string", "word") or p in (("mark", "("), ("mark", "^"), ("mark", "{"), ("mark", "-")):
            parts.append(self.primary())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def columns(self) -> tuple[str, ...] | None:
        """A column filter, if one stands here."""
        at, minus = self.at, False
        if self.peek() == ("mark", "-"):
            self.take()
            minus = True
        if self.peek() == ("mark", "{"):
            self.take()
            names = []
            while self.peek()[0] in ("word", "string"):
                names.append(self.take()[1])
            self.take("}")
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("mark", ":"):
            names = [self.take()[1]]
        elif minus:
            raise QuerySyntaxError("syntax error near '-'")
        else:
            self.at = at
            return None
        self.take(":")
        for n in names:
            if n.lower() not in COLUMNS:
                raise QuerySyntaxError(f"no such column: {n}")
        chosen = {n.lower() for n in names}
        return tuple(c for c in COLUMNS if (c in chosen) != minus)

    def primary(self):
        columns = self.columns()
        if columns is not None:
            return restrict(self.primary(), columns)
        if self.peek() == ("mark", "("):
            self.take()
            out = self.query()
            self.take(")")
            return out
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.take()
            self.take()
            phrases, distance = [], NEAR_DISTANCE
            while self.peek()[0] in ("word", "string"):
                phrases.append(self.phrase())
            if self.peek() == ("mark", ","):
                self.take()
                number = self.take()[1]
                if not number.isdigit():
                    raise QuerySyntaxError(f"expected integer, got {number!r}")
                distance = int(number)
            self.take(")")
            if not phrases:
                raise QuerySyntaxError("syntax error near ')'")
            return Near(tuple(phrases), distance) if len(phrases) > 1 else phrases[0]
        initial = self.peek() == ("mark", "^")
        if initial:
            self.take()
        return self.phrase(initial)

    def phrase(self, initial: bool = False) -> Phrase:
        tokens: tuple[str, ...] = ()
        while True:
            kind, value = self.peek()
            if kind not in ("word", "string"):
                raise QuerySyntaxError(f"syntax error near {value!r}")
            self.take()
            tokens += split_tokens(value)
            if self.peek() != ("mark", "+"):
                break
            self.take()
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        return Phrase(tokens, prefix, initial)


def restrict(node, columns: tuple[str, ...]):
    """A column filter over a subtree; nested filters intersect."""
    if isinstance(node, Phrase):
        return Phrase(node.tokens, node.prefix, node.initial, tuple(c for c in node.columns if c in columns))
    if isinstance(node, Near):
        return Near(tuple(restrict(p, columns) for p in node.phrases), node.distance)
    if isinstance(node, Not):
        return Not(restrict(node.keep, columns), restrict(node.drop, columns))
    return type(node)(tuple(restrict(p, columns) for p in node.parts))


def parse(query: str):
    parser = _Parser(expand_pipes(query))
    if not parser.items:
        raise QuerySyntaxError("empty query")
    out = parser.query()
    if parser.peek()[0] != "end":
        raise QuerySyntaxError(f"syntax error near {parser.peek()[1]!r}")
    return out
