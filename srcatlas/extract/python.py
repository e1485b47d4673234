"""Python: definitions by indentation, on logical lines of tokens."""

from __future__ import annotations

from srcatlas.extract.base import Extracted, Ref, Scopes, Symbol, comment_text, is_constant, string_text, token_set
from srcatlas.extract.lexer import Token, pairs, tokenize

# Calls of these (by the first part of the name) are not references.
BUILTINS = frozenset(
    "print len str int float bool list dict set tuple range enumerate zip map filter sorted reversed any all min max sum abs round type "
    "isinstance issubclass hasattr getattr setattr delattr open input repr format id hash iter next super property staticmethod classmethod".split()
)
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match".split())
STOP = frozenset("self cls None True False and or not is def lambda pass yield raise except finally with as from import del global elif async await int str bool float list dict set tuple args kwargs".split())


def logical_lines(tokens: list[Token]) -> list[tuple[int, int, int]]:
    """(indent, first, end) of each statement line; brackets and strings may span lines."""
    out, depth, first = [], 0, None
    for i, t in enumerate(tokens):
        if t.kind == "comment":
            continue
        if first is None or depth == 0 and t.line > last_line:
            if first is not None:
                out.append((tokens[first].column, first, i))
            first = i
        if t.kind == "punct":
            depth = max(0, depth + (t.text in "([{") - (t.text in ")]}")) if len(t.text) == 1 else depth
        last_line = t.end_line + (1 if t.text == "\\" and t.kind == "punct" else 0)
    if first is not None:
        out.append((tokens[first].column, first, len(tokens)))
    return out


def visibility(name: str, exported: set[str] | None) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    if exported is not None:
        return "public" if name in exported else "internal"
    return "internal" if name.startswith("_") else "public"


def extract(source: str, language: str = "python") -> Extracted:
    out, scopes = Extracted(), Scopes()
    tokens = tokenize(source, "python")
    match = pairs(tokens)
    lines = logical_lines(tokens)
    text = lambda i: tokens[i].text if i < len(tokens) else ""
    exported = _dunder_all(tokens, lines)
    stack: list[tuple[int, str, str]] = []  # (indent, qualified name, kind) of open blocks
    docstrings: set[int] = set()

    def block_end(k: int) -> int:
        """The index of the line after the block that line k opens."""
        e = k + 1
        while e < len(lines) and lines[e][0] > lines[k][0]:
            e += 1
        return e

    def close(line: int) -> int:
        """The last token of a logical line that isn't a comment."""
        e = (lines[line][2] if line < len(lines) else len(tokens)) - 1
        while e > lines[line][1] and tokens[e].kind == "comment":
            e -= 1
        return e

    for k, (indent, first, end) in enumerate(lines):
        while stack and indent <= stack[-1][0]:
            stack.pop()
        parent = stack[-1][1] if stack else None
        i = first
        if text(i) == "@":
            continue
        if k == 0 or (k and lines[k - 1][0] < indent and text(lines[k - 1][1]) in ("def", "class", "async")):
            if tokens[i].kind == "string" and end - i == 1 + sum(t.kind == "comment" for t in tokens[i + 1 : end]):
                docstrings.add(i)
        if text(i) == "async" and text(i + 1) in ("def", "for", "with"):
            i += 1
        word = text(i)
        if word in ("def", "class") and tokens[i].kind == "word" and i + 1 < end:
            name = text(i + 1)
            qualified = f"{parent}.{name}" if parent else name
            last = close(block_end(k) - 1)
            colon = _colon(tokens, match, i, end)
            kind = "class" if word == "class" else "method" if parent else "function"
            body = tokens[colon + 1 : last + 1]
            shown = visibility(name, exported if not parent else None)
            found = token_set((t.text for t in body if t.kind == "word"), STOP) if kind != "class" else None
            out.symbols.append(Symbol(qualified, kind, tokens[first].line, tokens[last].end_line, parent, found, None, shown))
            scopes.add(colon, last, qualified)
            stack.append((indent, qualified, kind))
            continue
        if word == "import":
            _import(out, tokens, i, end, parent)
        elif word == "from":
            _from(out, tokens, i, end, parent)
        elif tokens[i].kind == "word" and word not in KEYWORDS and (not stack or stack[-1][2] == "class"):
            _assignment(out, tokens, match, i, end, parent, exported if not parent else None)
    _texts_and_calls(out, tokens, match, scopes, docstrings)
    return out


def _colon(tokens: list[Token], match: dict[int, int], i: int, end: int) -> int:
    while i < end:
        if tokens[i].text == ":" and tokens[i].kind == "punct":
            return i
        i = match.get(i, i) + 1 if tokens[i].text in ("(", "[", "{") and tokens[i].kind == "punct" else i + 1
    return end - 1


def _dunder_all(tokens: list[Token], lines: list[tuple[int, int, int]]) -> set[str] | None:
    for indent, first, end in lines:
        if indent == 0 and tokens[first].text == "__all__":
            return {t.text.strip("\"'") for t in tokens[first:end] if t.kind == "string"}
    return None


def _dotted(tokens: list[Token], i: int, end: int) -> tuple[str, int]:
    name = ""
    while i < end and (tokens[i].text in (".", "...") or tokens[i].kind == "word" and tokens[i].text not in ("import", "as") and (not name or name.endswith("."))):
        name += tokens[i].text
        i += 1
    return name, i


def _add_import(out: Extracted, name: str, alias: str | None, token: Token, parent: str | None) -> None:
    out.symbols.append(Symbol(name, "import", token.line, token.line, None, None, alias, "private"))
    out.refs.append(Ref(name, "import", token.line, token.line, parent))


def _import(out: Extracted, tokens: list[Token], i: int, end: int, parent: str | None) -> None:
    start = tokens[i]
    i += 1
    while i < end:
        name, i = _dotted(tokens, i, end)
        alias = None
        if i + 1 < end and tokens[i].text == "as":
            alias, i = tokens[i + 1].text, i + 2
        if name:
            _add_import(out, name, alias, start, parent)
        i += 1


def _from(out: Extracted, tokens: list[Token], i: int, end: int, parent: str | None) -> None:
    start = tokens[i]
    module, i = _dotted(tokens, i + 1, end)
    join = module if module.endswith(".") else module + "."
    i += 1
    while i < end:
        t = tokens[i]
        if t.text == "*":
            _add_import(out, join + "*", None, start, parent)
        elif t.kind == "word":
            alias = None
            if i + 2 < end + 1 and i + 1 < end and tokens[i + 1].text == "as":
                alias = tokens[i + 2].text
            _add_import(out, join + t.text, alias, start, parent)
            i += 2 if alias else 0
        i += 1


def _assignment(out: Extracted, tokens: list[Token], match: dict[int, int], i: int, end: int, parent: str | None, exported: set[str] | None) -> None:
    """name = value, name: type = value and name: type."""
    if i + 1 >= end or tokens[i + 1].text not in ("=", ":"):
        return
    name = tokens[i].text
    if name == "__all__":
        return
    last = end - 1
    while last > i and tokens[last].kind == "comment":
        last -= 1
    kind = "constant" if is_constant(name) else "variable"
    qualified = f"{parent}.{name}" if parent else name
    out.symbols.append(Symbol(qualified, kind, tokens[i].line, tokens[last].end_line, parent, None, None, visibility(name, exported)))


def _texts_and_calls(out: Extracted, tokens: list[Token], match: dict[int, int], scopes: Scopes, docstrings: set[int]) -> None:
    code = [i for i, t in enumerate(tokens) if t.kind != "comment"]
    place = {i: k for k, i in enumerate(code)}
    for i, t in enumerate(tokens):
        if t.kind == "comment":
            found = comment_text(t.text, t.line, t.end_line, scopes.around(i))
        elif t.kind == "string":
            found = string_text(t.text, t.line, t.end_line, scopes.around(i), "docstring" if i in docstrings else "string")
        else:
            found = None
        if found:
            out.texts.append(found)
        if t.text == "(" and t.kind == "punct":
            k = place[i] - 1
            name: list[str] = []
            while k >= 0 and tokens[code[k]].kind == "word" and tokens[code[k]].text not in KEYWORDS:
                name.insert(0, tokens[code[k]].text)
                if k < 1 or tokens[code[k - 1]].text != ".":
                    break
                k -= 2
                if k < 0 or tokens[code[k]].kind != "word":
                    name = []
                    break
            before = tokens[code[k - 1]].text if k > 0 else ""
            caller = scopes.around(i)
            if name and before not in ("def", "class") and name[0] not in BUILTINS:
                out.refs.append(Ref(".".join(name), "call", t.line, t.line, caller))
