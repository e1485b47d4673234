"""Ruby: definitions closed by `end`."""

from __future__ import annotations

from srcatlas.extract.base import Extracted, Ref, Scopes, Symbol, comment_text, string_text, token_set
from srcatlas.extract.lexer import tokenize

OPENERS = frozenset("def class module if unless while until case begin for do".split())
#: These open a block only at the start of a statement.
MODIFIER = frozenset("if unless while until".split())
KEYWORDS = OPENERS | frozenset("end else elsif when then return yield self nil true false and or not in rescue ensure retry next break redo super alias undef defined? __method__".split())
# Calls that are no references, by the method's name.
SKIP = frozenset(
    (
        "puts print p pp gets require require_relative load raise fail catch throw exit abort sleep rand srand loop lambda proc binding eval exec system spawn fork open sprintf format warn "
        "class object_id send public_send respond_to? method methods instance_variables is_a? kind_of? instance_of? nil? tap then yield_self freeze frozen? dup clone to_s to_a to_h to_i to_f to_sym inspect hash eql? equal? "
        "each each_with_index each_with_object map collect select filter reject find detect find_all first last take drop count length size empty? any? all? none? one? include? member? min max minmax sum reduce inject sort sort_by reverse flatten compact uniq zip group_by partition push pop shift unshift delete clear concat join split "
        "keys values fetch store merge merge! update has_key? key? has_value? value? dig strip chomp chop upcase downcase capitalize gsub sub match match? start_with? end_with? encode bytes chars lines "
        "attr_reader attr_writer attr_accessor attr include extend prepend alias_method define_method module_function private protected public new initialize allocate superclass ancestors "
        "describe context it before after let expect should assert assert_equal refute"
    ).split()
)
STOP = KEYWORDS | frozenset("attr_reader attr_writer attr_accessor require include extend initialize puts".split())


def extract(source: str, language: str = "ruby") -> Extracted:
    out, scopes = Extracted(), Scopes()
    every = tokenize(source, "ruby")
    code = [t for t in every if t.kind != "comment"]
    text = lambda i: code[i].text if 0 <= i < len(code) and code[i].kind != "string" else ""
    starts = lambda i: i == 0 or code[i].line > code[i - 1].end_line or text(i - 1) in (";", "then", "do", "else", "begin", "=", "(", "||", "&&", "return", "{")
    ends = _ends(code, text, starts)
    stack: list[tuple[int, str, str]] = []  # (last token, qualified name, kind)
    hidden: dict[str | None, str] = {}
    for i, t in enumerate(code):
        while stack and stack[-1][0] < i:
            stack.pop()
        parent, inside = (stack[-1][1], stack[-1][2]) if stack else (None, "")
        if t.kind != "word":
            continue
        word = t.text
        if word in ("class", "module") and starts(i) and text(i + 1) != "<<":
            name, k = text(i + 1), i + 2
            while text(k) == "::":
                name, k = f"{name}::{text(k + 1)}", k + 2
            last = ends.get(i, len(code) - 1)
            full = f"{parent}.{name}" if parent else name
            out.symbols.append(Symbol(full, word, t.line, code[last].end_line, parent, None, None, "public"))
            if text(k) == "<" and word == "class":
                base, k = text(k + 1), k + 2
                while text(k) == "::":
                    base, k = f"{base}::{text(k + 1)}", k + 2
                out.refs.append(Ref(base, "type_annotation", t.line, t.line, full))
            scopes.add(i + 1, last, full)  # a comment in front stands outside
            stack.append((last, full, word))
            hidden[full] = "public"
        elif word in ("private", "protected", "public") and starts(i) and (i + 1 >= len(code) or code[i + 1].line > t.line):
            hidden[parent] = "internal" if word == "protected" else word
        elif word == "def":
            k, single = i + 1, False
            if text(k + 1) == "." and text(k) == "self" or text(k + 1) == "." and code[k].kind == "word":
                k, single = k + 2, True
            name = text(k) + ("=" if text(k + 1) == "=" and text(k + 2) == "(" and not _apart(code, k + 1) else "")
            last = ends.get(i, len(code) - 1)
            full = f"{parent}.{name}" if parent else name
            kind = "method" if parent or single else "function"
            shown = "private" if name.startswith("_") else hidden.get(parent, "public") if not single else "public"
            words = [x.text for x in code[k + 1 : last] if x.kind == "word"]
            out.symbols.append(Symbol(full, kind, t.line, code[last].end_line, parent, token_set((w.lstrip("@").rstrip("?!") for w in words), STOP, capitals=False), None, shown))
            scopes.add(k + 1, last, full)
            stack.append((last, full, "def"))
        elif text(i + 1) == "=" and text(i + 2) not in ("=", "~") and starts(i) and inside != "def":
            shown = "private" if word.startswith("_") else "public"
            full = f"{parent}.{word}" if parent else word
            end = _line_end(code, i)
            if word.startswith("@"):
                out.symbols.append(Symbol(full, "property", t.line, code[end].end_line, parent, None, None, "internal" if word.startswith("@@") else "private"))
            elif word[0].isupper():
                out.symbols.append(Symbol(full, "constant", t.line, code[end].end_line, parent, None, None, shown))
            elif not parent:
                out.symbols.append(Symbol(full, "variable", t.line, code[end].end_line, None, None, None, shown))
        elif word in ("require", "require_relative", "load") and i + 1 < len(code):
            k = i + 1 + (text(i + 1) == "(")
            if k < len(code) and code[k].kind == "string":
                path = code[k].text.strip("\"'")
                out.symbols.append(Symbol(path, "import", t.line, t.line, None, None, None, "private"))
                out.refs.append(Ref(path, "import", t.line, t.line, parent))
        _call(out, code, text, scopes, i)
    n = 0
    for t in every:
        found = None
        if t.kind == "comment":
            found = comment_text(t.text, t.line, t.end_line, scopes.around(n) if n < len(code) else None)
        else:
            if t.kind == "string" and text(n - 1) not in ("require", "require_relative", "load"):
                found = string_text(t.text, t.line, t.end_line, scopes.around(n))
            n += 1
        if found:
            out.texts.append(found)
    return out


def _ends(code, text, starts) -> dict[int, int]:
    """The `end` of each block."""
    out, stack = {}, []
    loop_line = -1
    for i, t in enumerate(code):
        if t.kind != "word" or text(i - 1) in (".", "&.", ":") and t.text != "end":
            continue
        if t.text == "end" and text(i - 1) not in (".", ":"):
            if stack:
                out[stack.pop()] = i
        elif t.text in OPENERS:
            if t.text in MODIFIER and not starts(i):
                continue
            if t.text == "do" and t.line == loop_line:
                continue
            if t.text in ("while", "until", "for"):
                loop_line = t.line
            if t.text == "def" and _endless(code, text, i):
                out[i] = _line_end(code, i)
                continue
            stack.append(i)
    return out


def _endless(code, text, i: int) -> bool:
    """def name(args) = expression"""
    k = i + 1
    while k < len(code) and code[k].line == code[i].line and text(k) != "(" and text(k) != "=":
        k += 1
    if text(k) == "(":
        depth = 0
        while k < len(code):
            depth += (text(k) == "(") - (text(k) == ")")
            k += 1
            if not depth:
                break
    # A setter's `=` stands at its name, an endless method's apart from it.
    return k < len(code) and text(k) == "=" and code[k].line == code[k - 1].line and (k > i + 2 or _apart(code, k))


def _apart(code, k: int) -> bool:
    """Is there a blank before a token?"""
    return code[k].line != code[k - 1].end_line or code[k].column > code[k - 1].column + len(code[k - 1].text)


def _line_end(code, i: int) -> int:
    depth = 0
    while i + 1 < len(code):
        if code[i].kind == "punct":
            depth += (code[i].text in "([{") - (code[i].text in ")]}")
        if depth <= 0 and code[i + 1].line > code[i].end_line:
            break
        i += 1
    return i


def _call(out: Extracted, code, text, scopes: Scopes, i: int) -> None:
    """`recv.name`, `name(...)` and `name argument` at the start of a statement."""
    name = code[i].text
    before, after = text(i - 1), text(i + 1)
    if name in KEYWORDS or name in SKIP or before in ("def", "class", "module", ":", "::") or name.startswith(("@", "$")):
        return
    if before in (".", "&.") and i >= 2:
        if text(i - 3) == "def":
            return
        if name == "new" and code[i - 2].text[:1].isupper():
            out.refs.append(Ref(code[i - 2].text, "instantiation", code[i].line, code[i].line, scopes.around(i)))
            return
        receiver = code[i - 2].text if code[i - 2].kind == "word" and code[i - 2].text != "self" else ""
        out.refs.append(Ref(f"{receiver}.{name}" if receiver else name, "call", code[i].line, code[i].line, scopes.around(i)))
    elif after == "(" and code[i + 1].column == code[i].column + len(name) and code[i + 1].line == code[i].line:
        out.refs.append(Ref(name, "call", code[i].line, code[i].line, scopes.around(i)))
