"""A tolerant tokenizer, driven by one regular expression for each language family."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True, slots=True)
class Token:
    kind: str  # word, number, string, punct, comment, directive
    text: str
    line: int
    end_line: int
    column: int


_NUMBER = r"(?P<number>\d[\w.]*)"
_LINE = r"//[^\n]*"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"

_COMMENTS = {"python": r"#[^\n]*", "ruby": r"#[^\n]*|(?:(?<=\n)|\A)=begin\b.*?(?:\n=end[^\n]*|\Z)"}
_STRINGS = {
    "python": r"(?:[rRbBuUfFtT]{0,3})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)",
    "rust": r"b?r(?P<hash>#*)\".*?\"(?P=hash)|[bc]?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]+?|[^'\\\n])'",
    "go": r"`[^`]*`?|" + _DOUBLE + r"|'(?:\\.[^'\n]*|[^'\\\n])'",
    "java": r'""".*?(?:"""|\Z)|' + _DOUBLE + "|" + _SINGLE,
    "csharp": r'\$*"""+.*?"""+|(?:\$@|@\$|@)"(?:[^"]|"")*"?|\$?' + _DOUBLE + "|" + _SINGLE,
    "c": r'(?:u8|[uUL])?R"(?P<d>[^()\\\s]*)\(.*?\)(?P=d)"|(?:u8|[uUL])?' + _DOUBLE + r"|(?:u8|[uUL])?'(?:\\[^'\n]*|[^'\\\n])'",
    "javascript": r"`(?:\\.|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`?|" + _DOUBLE + "|" + _SINGLE,
    "ruby": r"%[qQwWiI]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})|" + r'"(?:\\.|[^"\\])*"?|' + r"'(?:\\.|[^'\\])*'?",
}
_PUNCT = {
    "python": r"->|:=|\*\*|//|[-+*/%&|^<>=!]=|.",
    "rust": r"::|->|=>|\.\.=?|'[A-Za-z_]\w*|[-+*/%&|^<>=!]=|.",
    "go": r":=|<-|\.\.\.|&&|\|\||[-+*/%&|^<>=!]=|.",
    "java": r"->|::|\.\.\.|&&|\|\||[-+*/%&|^=!]=|.",
    "csharp": r"=>|\?\.|\?\?|::|&&|\|\||[-+*/%&|^=!]=|.",
    "c": r"->|::|\.\.\.|&&|\|\||<<|[-+*/%&|^<>=!]=|.",
    "javascript": r"=>|\?\.|\.\.\.|\?\?|&&|\|\||\*\*|[=!]==?|[-+*/%&|^<>]=|.",
    "ruby": r"::|&\.|=>|->|\.\.\.?|<<|&&|\|\||[-+*/%&|^<>=!]=|.",
}
FAMILY = {"cpp": "c", "typescript": "javascript", "tsx": "javascript"}
#: After these a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}


@lru_cache(maxsize=None)
def _pattern(family: str) -> re.Pattern[str]:
    word = {"javascript": r"#?[^\W\d][\w$]*|\$[\w$]*", "ruby": r"@{0,2}[^\W\d]\w*[?!]?(?!=[^=~>])|@{0,2}[^\W\d]\w*|\$\w+", "csharp": r"@?[^\W\d]\w*", "rust": r"r#[^\W\d]\w*|[^\W\d]\w*"}.get(family, r"[^\W\d]\w*")
    parts = [rf"(?P<comment>{_COMMENTS.get(family, _LINE + '|' + _BLOCK)})"]
    if family in ("c", "csharp"):
        parts.append(r"(?P<directive>(?:(?<=\n)|\A)[ \t]*#(?:\\\r?\n|[^\n])*)")
    parts += [rf"(?P<string>{_STRINGS[family]})", rf"(?P<word>{word})", _NUMBER, rf"(?P<punct>{_PUNCT[family]})"]
    return re.compile("|".join(parts), re.S)


def tokenize(source: str, language: str) -> list[Token]:
    """All tokens in order, comments among them; white space is left out."""
    return list(tokens(source, language))


def tokens(source: str, language: str) -> Iterator[Token]:
    """As tokenize, but only as far as they are asked for."""
    family = FAMILY.get(language, language)
    pattern = _pattern(family)
    at, line, begin = 0, 1, 0
    n = len(source)
    previous: Token | None = None
    while at < n:
        c = source[at]
        if c in " \t\r\f\v\ufeff":
            at += 1
            continue
        if c == "\n":
            line, at = line + 1, at + 1
            begin = at
            continue
        m = pattern.match(source, at)
        kind, text = m.lastgroup, m.group()
        if kind in ("hash", "d"):
            kind = "string"
        if family in ("javascript", "ruby") and text == "/" and _regex_may_stand(previous) and (r := re.compile(r"/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(source, at)):
            kind, text = "string", r.group()
        token = Token(kind, text, line, line + text.count("\n"), at - begin)
        if "\n" in text:
            line = token.end_line
            begin = at + text.rindex("\n") + 1
        at += len(text)
        yield token
        if kind != "comment":
            previous = token


def _regex_may_stand(previous: Token | None) -> bool:
    if previous is None:
        return True
    if previous.kind == "word":
        return previous.text in _BEFORE_REGEX
    return previous.kind == "punct" and previous.text not in (")", "]", "}")


def pairs(tokens: list[Token]) -> dict[int, int]:
    """The index of each bracket's partner, both ways; unbalanced ones pair with the end."""
    closing, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in "([{" and t.text:
            stack.append(i)
        elif t.text in closing:
            # a missing inner bracket doesn't unbalance the outer ones
            for k in range(len(stack) - 1, -1, -1):
                if tokens[stack[k]].text == closing[t.text]:
                    out[stack[k]], out[i] = i, stack[k]
                    for lost in stack[k + 1 :]:
                        out[lost] = i
                    del stack[k:]
                    break
    for i in stack:
        out[i] = len(tokens) - 1
    return out
