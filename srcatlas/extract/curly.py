"""Languages with braces: a shared scanner over tokens, and one declaration reader for each language.

A reader walks the statements of one level. What it recognises becomes a symbol; type
bodies are walked again as a level of their own. References come from one pass over
all tokens afterwards, with the innermost declared range as their caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from srcatlas.extract.base import Extracted, Ref, Scopes, Symbol, comment_text, is_constant, string_text, token_set
from srcatlas.extract.lexer import FAMILY, Token, pairs, tokenize

# Words that are no calls, types that are no references, and words that say nothing about a body.
CONTROL = frozenset("if for while switch catch return do else try throw new delete super this assert".split())
KEYWORDS = {
    "rust": CONTROL | frozenset("match fn in loop pub unsafe await as move where impl let mut ref use crate".split()),
    "go": CONTROL | frozenset("func go defer select range import type var const chan map interface struct case package".split()),
    "javascript": CONTROL | frozenset("function typeof await yield in of async void case import with instanceof".split()),
    "java": CONTROL | frozenset("synchronized instanceof case".split()),
    "csharp": CONTROL | frozenset("using lock foreach when nameof typeof sizeof await in is as fixed checked unchecked default not and or case".split()),
    "c": CONTROL | frozenset("sizeof alignof decltype defined static_assert typeof case noexcept alignas int char void long short unsigned float double bool const auto operator".split()),
}
SKIP = {
    "rust": frozenset("println print eprintln eprint format write writeln panic assert assert_eq assert_ne debug_assert debug_assert_eq debug_assert_ne unreachable unimplemented todo vec dbg cfg include include_str include_bytes concat stringify env option_env file line column module_path Default Clone Copy Drop Some None Ok Err".split()),
    "go": frozenset("make len cap append copy delete close panic recover print println new complex real imag".split()),
    "javascript": frozenset(
        "console log error warn info debug trace dir table time timeEnd clear count group groupEnd assert "
        "parseInt parseFloat isNaN isFinite encodeURI decodeURI encodeURIComponent decodeURIComponent eval setTimeout setInterval clearTimeout clearInterval fetch require "
        "Object Array String Number Boolean Symbol BigInt Date RegExp Error Map Set WeakMap WeakSet Promise Proxy Reflect JSON Math "
        "push pop shift unshift slice splice concat join reverse sort filter map reduce reduceRight forEach find findIndex indexOf includes every some flat flatMap keys values entries from of isArray "
        "charAt charCodeAt substring substr replace replaceAll split toLowerCase toUpperCase trim trimStart trimEnd padStart padEnd repeat startsWith endsWith match search "
        "hasOwnProperty toString valueOf assign create defineProperty freeze seal getPrototypeOf setPrototypeOf "
        "then catch finally resolve reject all race allSettled any abs ceil floor round max min pow sqrt random sin cos parse stringify "
        "describe it test expect beforeEach afterEach beforeAll afterAll jest mock spyOn toBe toEqual".split()
    ),
    "c": frozenset(
        "printf fprintf sprintf snprintf scanf fscanf sscanf fopen fclose fread fwrite fgets fputs getc putc getchar putchar fflush fseek ftell rewind feof ferror perror remove rename "
        "malloc calloc realloc free exit abort atexit atoi atol atof strtol strtoul strtod rand srand qsort bsearch abs labs div ldiv getenv system "
        "strlen strcpy strncpy strcat strncat strcmp strncmp strchr strrchr strstr strtok memcpy memmove memset memcmp memchr "
        "isalpha isdigit isalnum isspace isupper islower toupper tolower "
        "sin cos tan asin acos atan atan2 sinh cosh tanh exp log log10 pow sqrt ceil floor fabs fmod assert sizeof offsetof".split()
    ),
    "cpp": frozenset(
        "printf fprintf sprintf snprintf scanf malloc calloc realloc free strlen strcpy strcmp memcpy memset sizeof "
        "push_back pop_back push_front pop_front insert erase clear empty size capacity reserve resize begin end rbegin rend cbegin cend front back at find count lower_bound upper_bound emplace emplace_back "
        "make_unique make_shared make_pair make_tuple get reset release swap "
        "sort find_if copy move transform for_each accumulate count_if remove remove_if reverse unique binary_search min max min_element max_element "
        "cout cin cerr clog endl flush getline to_string stoi stol stod substr length c_str data append compare "
        "new delete static_cast dynamic_cast const_cast reinterpret_cast "
        "EXPECT_EQ EXPECT_TRUE EXPECT_FALSE ASSERT_EQ ASSERT_TRUE ASSERT_FALSE TEST TEST_F".split()
    ),
    "java": frozenset(
        "System out err in println print printf exit currentTimeMillis nanoTime gc getenv getProperty toString equals hashCode getClass clone wait notify notifyAll "
        "length charAt substring indexOf lastIndexOf contains startsWith endsWith replace replaceAll split trim toLowerCase toUpperCase format valueOf isEmpty "
        "add remove get set size clear iterator toArray stream forEach put containsKey containsValue keySet values entrySet "
        "Object String Integer Long Double Float Boolean Byte Short Character Number Math Arrays Collections List ArrayList LinkedList Map HashMap TreeMap Set HashSet TreeSet Queue Deque Stack Optional Stream Collectors "
        "Class Enum Exception RuntimeException Error Throwable Thread Runnable assertEquals assertTrue assertFalse assertNull assertNotNull assertThrows fail".split()
    ),
    "csharp": frozenset(
        "Console WriteLine ReadLine Write Read Clear Beep ToString GetType Equals GetHashCode ReferenceEquals MemberwiseClone "
        "Format Join Split Substring Trim TrimStart TrimEnd ToUpper ToLower Replace Contains StartsWith EndsWith IndexOf LastIndexOf Length IsNullOrEmpty IsNullOrWhiteSpace Concat Compare "
        "Add Remove RemoveAt Insert Find FindAll FindIndex Sort Reverse ToArray ToList ToDictionary First FirstOrDefault Last LastOrDefault Single SingleOrDefault "
        "Where Select SelectMany OrderBy OrderByDescending GroupBy Any All Count Sum Average Min Max Aggregate Distinct Skip Take SkipWhile TakeWhile "
        "Wait WaitAll WaitAny Run FromResult Delay WhenAll WhenAny ContinueWith ConfigureAwait Abs Ceiling Floor Round Pow Sqrt Sin Cos Tan "
        "Parse TryParse Convert GetBytes GetString Dispose Close Invoke BeginInvoke EndInvoke "
        "Assert AreEqual AreNotEqual IsTrue IsFalse IsNull IsNotNull Throws ThrowsAsync Fact Theory Test TestCase Setup TearDown".split()
    ),
}
# Names that only one of the two script languages leaves out, and objects whose methods TypeScript leaves out.
SCRIPT_SKIP = {
    "javascript": frozenset("alert confirm prompt Function".split()),
    "typescript": frozenset("countReset matchAll localeCompare toLocaleString defineProperties getOwnPropertyNames getOwnPropertySymbols getOwnPropertyDescriptor tan exp toContain toThrow toHaveBeenCalled toHaveBeenCalledWith".split()),
}
SCRIPT_OBJECTS = frozenset("console Math JSON Object Array String Number Date RegExp Promise Reflect Proxy".split())
PRIMITIVE = {
    "rust": frozenset("i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str Self".split()),
    "go": frozenset("int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 bool byte rune string error any".split()),
    "javascript": frozenset(
        "string number boolean any void never unknown null undefined object symbol bigint this true false readonly keyof infer is asserts extends in typeof "
        "Function Object Array String Number Boolean Symbol Date RegExp Error Map Set WeakMap WeakSet Promise "
        "Readonly Partial Required Pick Omit Record Exclude Extract NonNullable Parameters ReturnType InstanceType ThisType Awaited".split()
    ),
    "java": frozenset("int long short byte char float double boolean void var String Integer Long Short Byte Float Double Boolean Character Void Object Number Class".split()),
    "c": frozenset("int long short char float double void unsigned signed bool auto size_t const struct union enum".split()),
    "cpp": frozenset(
        "int long short char float double bool void signed unsigned size_t ssize_t ptrdiff_t auto decltype "
        "string vector map set unordered_map unordered_set list deque queue stack pair tuple array unique_ptr shared_ptr weak_ptr optional variant any function iterator const_iterator".split()
    ),
    "csharp": frozenset(
        "int long short byte sbyte float double decimal bool char string object void dynamic var "
        "Int32 Int64 Int16 Byte SByte Single Double Decimal Boolean Char String Object Void "
        "DateTime TimeSpan Guid Type Array List Dictionary HashSet Queue Stack IEnumerable IList ICollection IDictionary IQueryable Task Action Func Predicate EventHandler Exception EventArgs".split()
    ),
}
STOP = {
    "rust": frozenset("self Self crate mod pub mut ref let type impl trait fn where loop match unsafe async await dyn move use as Some None Ok Err std core alloc cx rx tx io buf drop".split()),
    "go": frozenset("func var type package import map chan range nil err ctx string int error len make append defer go select interface".split()),
    "javascript": frozenset("let var function async await typeof instanceof null undefined export import from of extends constructor get set yield delete string number boolean any".split()),
    "java": frozenset("int long boolean final abstract extends implements import package null String Object instanceof throws synchronized var char byte double float".split()),
    "c": frozenset("int char long short unsigned signed float double sizeof typedef union NULL nullptr bool auto include define std template typename namespace using virtual override".split()),
    "csharp": frozenset("int string bool var namespace using null object readonly override virtual abstract async await get set value internal sealed base typeof out ref".split()),
}
MODIFIERS = frozenset("public private protected internal static final abstract sealed partial readonly override virtual async extern unsafe new native synchronized transient volatile default strictfp export declare const inline constexpr explicit friend mutable typename register accessor required file".split())


@dataclass
class Level:
    """What encloses the statements that are read."""

    parent: str | None = None
    kind: str = ""
    name: str = ""
    default: str = "public"


class Reader:
    language = ""
    separator = "."

    def __init__(self, source: str, language: str) -> None:
        every = tokenize(source, language)
        self.family = FAMILY.get(language, language)
        self.language = language
        self.out, self.scopes = Extracted(), Scopes()
        self.code = [t for t in every if t.kind not in ("comment", "directive")]
        self.other: list[tuple[int, object]] = []
        n = 0
        for t in every:
            if t.kind in ("comment", "directive"):
                self.other.append((n, t))
            else:
                n += 1
        self.match = pairs(self.code)
        # Unfinished sources point behind the last token, so one more stands there.
        self.size = len(self.code)
        last = every[-1].end_line if every else 1
        self.code.append(Token("punct", "", last, last, 0))
        self.skip, self.primitive, self.stop = (x.get(self.family, frozenset()) for x in (SKIP, PRIMITIVE, STOP))
        self.keywords = KEYWORDS[self.family]
        self._names: set[int] = set()  # where declared names stand, which are no calls

    # Tokens.
    def text(self, i: int) -> str:
        return self.code[i].text if 0 <= i < len(self.code) and self.code[i].kind != "string" else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.code) and self.code[i].kind == "word"

    def past(self, i: int) -> int:
        """The index after a token, or after the group it opens."""
        return self.match[i] + 1 if self.text(i) in ("(", "[", "{") and self.match.get(i, -1) >= i else i + 1

    def angle(self, i: int) -> int:
        """The index after `<...>`, if one begins here."""
        if self.text(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.code) and k < i + 400:
            t = self.text(k)
            depth += (t == "<") - (t == ">") - 2 * (t == ">>")
            if t in (";", "{") or depth <= 0:
                return k + 1 if depth <= 0 else i
            k = self.past(k) if t in ("(", "[") else k + 1
        return i

    def find(self, i: int, hi: int, stops: tuple[str, ...]) -> int:
        """The first of `stops` outside brackets, or hi."""
        while i < hi:
            if self.text(i) in stops:
                return i
            i = self.past(i)
        return hi

    def statement_end(self, i: int, hi: int) -> int:
        """The index after the statement: past `;`, or past a block that no expression follows."""
        while i < hi:
            t = self.text(i)
            if t == ";":
                return i + 1
            if t == "{":
                i = self.past(i)
                if self.text(i) in (";",):
                    return i + 1
                if self.text(i) not in (".", ",", "(", ")", "=", "?", "&&", "||", "=>", "->", "as", "else", "catch", "finally", "while", "where"):
                    return i
                continue
            i = self.past(i)
        return hi

    # Results.
    def symbol(self, level: Level, name: str, kind: str, first: int, last: int, visibility: str | None, body: tuple[int, int] | None = None, alias: str | None = None, callable_: bool | None = None, qualify: bool = True, tokens: str | None = None) -> str:
        first, last = min(first, self.size), min(last, max(self.size - 1, 0))
        full = f"{level.parent}{self.separator}{name}" if level.parent and qualify else name
        if body and tokens is None:
            tokens = token_set((t.text for t in self.code[body[0] : body[1] + 1] if t.kind == "word"), self.stop, capitals=self.family not in ("c", "csharp", "java"))
        self.out.symbols.append(Symbol(full, kind, self.code[first].line, self.code[last].end_line, level.parent, tokens, alias, visibility))
        if body:
            self.scopes.add(body[0], body[1], full)
        return full

    def imported(self, level: Level, name: str, first: int, last: int, alias: str | None = None, visibility: str = "private") -> None:
        self.out.symbols.append(Symbol(name, "import", self.code[first].line, self.code[min(last, len(self.code) - 1)].end_line, None, None, alias, visibility))
        self.out.refs.append(Ref(name, "import", self.code[first].line, self.code[first].line, level.parent))

    def types(self, lo: int, hi: int, caller: str | None) -> None:
        """Names in a range of types, without primitives and generic parameters' punctuation."""
        for i in range(lo, hi):
            if self.word(i) and self.text(i) not in self.primitive and self.text(i) not in MODIFIERS and self.text(i - 1) not in (".", "::") and self.text(i) not in ("mut", "dyn", "impl", "ref", "map", "chan", "func", "interface", "struct", "extends", "super", "where", "for", "let"):
                name, k = self.text(i), i
                while self.text(k + 1) in (".", "::") and self.word(k + 2):
                    name, k = name + self.text(k + 1) + self.text(k + 2), k + 2
                self.out.refs.append(Ref(name, "type_annotation", self.code[i].line, self.code[i].line, caller))

    # Walking.
    def run(self) -> Extracted:
        self.level(0, self.size, Level())
        for at, t in self.other:
            if t.kind == "directive":
                self.directive(t)
            else:
                found = comment_text(t.text, t.line, t.end_line, self.scopes.around(at) if at < self.size else None)
                if found:
                    self.out.texts.append(found)
        for i, t in enumerate(self.code):
            if t.kind == "string" and not self.plain(i):
                found = string_text(t.text, t.line, t.end_line, self.scopes.around(i))
                if found:
                    self.out.texts.append(found)
        self.calls()
        self.out.texts.sort(key=lambda x: (x.start, x.end))
        return self.out

    def plain(self, i: int) -> bool:
        """Whether a string is no text: an import path."""
        return self.text(i - 1) in ("import", "from")

    def level(self, i: int, hi: int, level: Level) -> None:
        while i < hi:
            if self.text(i) in (";", "}", ")", "]", ","):
                i += 1
                continue
            after = self.declare(i, hi, level)
            i = max(i + 1, after if after is not None else self.statement_end(i, hi))

    def declare(self, i: int, hi: int, level: Level) -> int | None:
        raise NotImplementedError

    def directive(self, t) -> None:
        pass

    def calls(self) -> None:
        for i, t in enumerate(self.code):
            if t.kind != "punct" or t.text != "(" or not i:
                continue
            k = i - 1
            if self.text(k) == ">":  # generic arguments before the call
                back = k
                while back > 0 and self.text(back) != "<" and self.text(back) not in (";", "{", "}", "(", ")"):
                    back -= 1
                k = back - 1 if self.text(back) == "<" else k
                k -= self.text(k) == "::"
            if self.text(k) == "!" and self.family == "rust":
                k -= 1
            if self.text(k) == "?.":
                k -= 1
            if not self.word(k) or k in self._names or self.text(k) in self.keywords:
                continue
            name, base = self.text(k), self.text(k)
            while self.text(k - 1) in (".", "::", "->", "?.") and self.word(k - 2) and self.text(k - 2) not in self.keywords - {"this", "super"}:
                name, k = self.text(k - 2) + ("::" if self.text(k - 1) == "::" else ".") + name, k - 2
            before = self.text(k - 1)
            if before in ("function", "fn", "func", "class", "def", "@") or self.skipped(name, base):
                continue
            kind = "instantiation" if before == "new" else "call"
            if kind == "instantiation" and self.family in ("c", "csharp") and name in self.primitive:
                continue
            self.out.refs.append(Ref(name.lstrip("#"), kind, t.line, t.line, self.scopes.around(i)))

    def skipped(self, name: str, base: str) -> bool:
        """Whether a call of this name, with or without a receiver, says nothing."""
        return base in self.skip

    def named(self, i: int) -> str:
        """The declared name at i, which is then no call."""
        self._names.add(i)
        return self.text(i)


class Rust(Reader):
    ITEMS = frozenset("fn struct enum union trait type mod const static impl use pub async unsafe extern macro_rules".split())

    def attributes(self, i: int) -> int:
        while self.text(i) == "#":
            i = self.past(i + 1 + (self.text(i + 1) == "!"))
        return i

    def body(self, i: int, hi: int, level: Level) -> None:
        """Items that stand among the statements of a function, in blocks too."""
        while i < hi:
            after = None
            if self.text(i - 1) in ("{", "}", ";", "]") and (self.text(i) in self.ITEMS or self.text(i + 1) == "!"):
                after = self.declare(i, hi, level)
            i = max(i + 1, after or 0)

    def holds_items(self, i: int, hi: int) -> bool:
        """Whether a macro's body reads as items of the language, and not as a syntax of its own."""
        i = self.attributes(i)
        if i >= hi or self.text(i) not in self.ITEMS or self.text(i) == "static" and self.text(i + 1) == "ref":
            return False
        i += self.text(i) == "pub"
        i = self.past(i) if self.text(i) == "(" else i
        return not (self.text(i) in ("struct", "enum") and self.text(i + 2) == ":")

    def declare(self, i: int, hi: int, level: Level) -> int | None:
        first = i = self.attributes(i)
        shown = "private"
        if self.text(i) == "pub":
            i += 1
            shown = "public"
            if self.text(i) == "(":
                shown, i = "internal", self.past(i)
        if level.kind == "trait":
            shown = "public"
        while self.text(i) in ("async", "unsafe", "extern", "default") or self.text(i) == "const" and self.text(i + 1) in ("fn", "unsafe", "async") or self.code[min(i, len(self.code) - 1)].kind == "string" and self.text(i - 1) == "extern":
            i += 1
        word = self.text(i)
        if word == "fn" and self.word(i + 1):
            name = self.named(i + 1)
            full = f"{level.parent}.{name}" if level.parent else name
            p = self.angle(i + 2)
            brace = self.find(p, hi, ("{", ";"))
            last = self.match.get(brace, brace) if self.text(brace) == "{" else brace
            if self.text(p) == "(":
                self.annotations(p, full)
            arrow = self.find(self.past(p), brace, ("->",))
            self.types(arrow + 1, self.find(arrow, brace, ("where",)), full)
            self.symbol(level, name, "method" if level.parent and level.kind in ("impl", "trait", "fn") else "function", first, last, shown, (brace, last) if self.text(brace) == "{" else None)
            if self.text(brace) == "{":
                self.body(brace + 1, last, Level(full, "fn", name))
            return last + 1
        if word in ("struct", "enum", "trait", "union") and self.word(i + 1):
            name = self.named(i + 1)
            stop = self.find(self.angle(i + 2), hi, ("{", ";"))
            last = self.match.get(stop, stop) if self.text(stop) == "{" else stop
            self.symbol(level, name, {"trait": "interface", "union": "struct"}.get(word, word), first, last, shown, qualify=False)
            if word == "struct":
                for k in range(stop + 1, last):
                    if self.text(k) == ":":
                        self.types(k + 1, self.find(k + 1, last, (",",)), name)
            if word == "trait" and self.text(stop) == "{":
                self.scopes.add(stop, last, name)
                self.level(stop + 1, last, Level(name, "trait", name))
            return last + 1
        if word == "type" and self.word(i + 1):
            last = self.find(i, hi, (";",))
            self.symbol(level, self.text(i + 1), "type_alias", first, last, shown, qualify=False)
            return last + 1
        if word == "mod" and self.word(i + 1):
            last = self.find(i, hi, ("{", ";"))
            end = self.match.get(last, last) if self.text(last) == "{" else last
            self.symbol(level, self.text(i + 1), "module", first, end, shown, qualify=False)
            if self.text(last) == "{":
                self.level(last + 1, end, Level(self.text(i + 1), "mod"))
            return end + 1
        if word in ("const", "static"):
            k = i + 1 + (self.text(i + 1) == "mut")
            last = self.find(i, hi, (";",))
            if self.word(k):
                self.symbol(level, self.text(k), "constant", first, last, shown, qualify=False)
            return last + 1
        if word == "impl":
            k = self.angle(i + 1)
            brace = self.find(k, hi, ("{", ";"))
            split = self.find(k, brace, ("for",))
            start = split + 1 if split < brace else k
            stop = self.find(start, brace, ("where",))
            shape = "".join(t.text for t in self.code[start:stop])
            last = min(self.match.get(brace, brace), self.size)
            self.out.symbols.append(Symbol(shape, "trait_impl" if split < brace else "impl", self.code[first].line, self.code[last].end_line, None, None, None, "private"))
            owner = shape.lstrip("&").split("<")[0]
            if split < brace:
                self.types(k, split, owner)
            self.level(brace + 1, last, Level(owner, "impl", owner))
            return last + 1
        if word == "use":
            last = self.find(i, hi, (";",))
            self.use(i + 1, last, "", first, level, shown)
            return last + 1
        if word == "macro_rules" and self.text(i + 1) == "!":
            last = self.match.get(i + 3, i + 3)
            self.symbol(level, self.text(i + 2), "macro", first, last, "private")
            return last + 1
        if self.word(i) and self.text(i + 1) == "!" and self.text(i + 2) in ("{", "(", "["):
            last = self.match.get(i + 2, i + 2)
            if self.holds_items(i + 3, last):
                self.level(i + 3, last, level)
            return last + 1
        return None

    def annotations(self, p: int, caller: str) -> None:
        close = self.match.get(p, p)
        k = p + 1
        while k < close:
            if self.text(k) == ":":
                end = self.find(k + 1, close, (",",))
                self.types(k + 1, end, caller)
                k = end
            k = k + 1

    def use(self, i: int, hi: int, prefix: str, first: int, level: Level, shown: str) -> None:
        path, k = "", i
        while k < hi and (self.word(k) and self.text(k) != "as" or self.text(k) in ("::", "*")):
            path, k = path + self.text(k), k + 1
        if self.text(k) == "{":
            close = self.match.get(k, hi)
            at = k + 1
            while at < close:
                end = self.find(at, close, (",",))
                self.use(at, end, prefix + path, first, level, shown)
                at = end + 1
        elif path:
            name = prefix + path
            self.imported(level, name.removesuffix("::self"), first, hi, self.text(k + 1) if self.text(k) == "as" else None, shown)


class Go(Reader):
    @staticmethod
    def shown(name: str) -> str:
        return "public" if name[:1].isupper() else "private"

    def end_of_line(self, i: int, hi: int) -> int:
        """The last token of a statement that ends with its line."""
        while i + 1 < hi and self.text(i) != ";":
            after = self.past(i)
            if after >= hi or self.code[after].line > self.code[after - 1].end_line and self.text(after - 1) not in (",", ".", "=", "+", "&&", "||", "|"):
                return after - 1
            i = after
        return min(i, hi - 1)

    def group(self, i: int, hi: int):
        """(first, last) of each spec of a `(...)` group, or of the only one."""
        if self.text(i) == "(":
            close, k = self.match.get(i, hi), i + 1
            while k < close:
                last = self.end_of_line(k, close)
                yield k, last
                k = last + 1
        else:
            yield i, self.end_of_line(i, hi)

    def declare(self, i: int, hi: int, level: Level) -> int | None:
        word = self.text(i)
        if word == "package":
            self.symbol(level, self.text(i + 1), "module", i, i + 1, "public")
            return i + 2
        if word == "import":
            last = i
            for k, last in self.group(i + 1, hi):
                alias = self.text(k) or None
                path = self.code[k + (alias is not None)]
                if path.kind == "string":
                    self.imported(level, path.text.strip('"`'), k, last, alias)
            return self.past(i + 1) if self.text(i + 1) == "(" else last + 1
        if word == "func":
            k, owner = i + 1, None
            if self.text(k) == "(" and self.word(self.past(k)):
                close = self.match[k]
                names = [self.text(x) for x in range(k + 1, close) if self.word(x)]
                owner = next((self.text(x) for x in range(close - 1, k, -1) if self.word(x) and self.text(x + 1) in (")", "[")), names[-1] if names else None)
                k = close + 1
            if not self.word(k):
                return None
            name = self.named(k)
            p = self.past(k + 1) if self.text(k + 1) == "[" else k + 1
            after = self.past(p)
            brace = after
            while brace < hi and self.text(brace) != "{" and self.code[brace].line == self.code[brace - 1].end_line:
                brace = self.past(brace) if self.text(brace) != "interface" else brace + 2
            own = Level(owner, "struct") if owner else level
            last = self.match.get(brace, brace) if self.text(brace) == "{" else brace - 1
            full = self.symbol(own, name, "method" if owner else "function", i, last, self.shown(name), (brace, last) if self.text(brace) == "{" else None)
            self.parameters(p, full)
            self.types(after, brace, full)
            return last + 1
        if word == "type":
            last = i
            for k, last in self.group(i + 1, hi):
                self.type_spec(k, last, level)
            return self.past(i + 1) if self.text(i + 1) == "(" else last + 1
        if word in ("var", "const"):
            last = i
            for k, last in self.group(i + 1, hi):
                at = k
                while self.word(at):
                    self.symbol(level, self.text(at), "constant" if word == "const" else "variable", at, last, self.shown(self.text(at)))
                    if self.text(at + 1) != ",":
                        break
                    at += 2
            return self.past(i + 1) if self.text(i + 1) == "(" else last + 1
        return self.end_of_line(i, hi) + 1

    def parameters(self, p: int, caller: str) -> None:
        close, k = self.match.get(p, p), p + 1
        while k < close:
            end = self.find(k, close, (",",))
            if end - k > 1:
                self.types(k + self.word(k) * (self.text(k + 1) != "."), end, caller)
            k = end + 1

    def type_spec(self, k: int, last: int, level: Level) -> None:
        name = self.text(k)
        at = k + 1
        if self.text(at) == "[" and self.word(at + 1) and self.match.get(at, 0) > at + 1:
            at = self.past(at)
        at += self.text(at) == "="
        kind = {"struct": "struct", "interface": "interface"}.get(self.text(at), "type_alias")
        self.symbol(level, name, kind, k - 1 if self.text(k - 1) == "type" else k, last, self.shown(name))
        brace = at + 1
        if kind == "type_alias" or self.text(brace) != "{":
            if kind == "type_alias":
                self.types(at, last + 1, name)
            return
        close, x = self.match.get(brace, last), brace + 1
        inner = Level(name, kind)
        while x < close:
            end = self.end_of_line(x, close)
            if kind == "interface" and self.text(x + 1) == "(":
                said = "".join(t.text if t.kind != "word" else f" {t.text} " for t in self.code[x : end + 1])
                self.symbol(inner, self.named(x), "method", x, end, self.shown(self.text(x)), tokens=" ".join(said.split()))
            elif kind == "struct" and end > x and self.text(x + 1) != ".":
                at = x
                names = []
                while self.word(at):
                    names.append(at)
                    if self.text(at + 1) != ",":
                        break
                    at += 2
                for n in names:
                    self.symbol(inner, self.text(n), "property", n, end, self.shown(self.text(n)))
                stop = end + (self.code[end].kind != "string")
                self.types(at + 1, stop, name)
            x = end + 1

    def plain(self, i: int) -> bool:
        return any(lo <= i <= hi for lo, hi in self.import_ranges())

    def import_ranges(self):
        return [(k, self.match.get(k + 1, k + 2) if self.text(k + 1) == "(" else k + 2) for k in range(len(self.code)) if self.text(k) == "import"]


class Script(Reader):
    """JavaScript and TypeScript."""

    def __init__(self, source: str, language: str) -> None:
        super().__init__(source, language)
        self.skip |= SCRIPT_SKIP["javascript" if language == "javascript" else "typescript"]

    def skipped(self, name: str, base: str) -> bool:
        """By the whole name: the same method of an object of one's own counts."""
        return name in self.skip or self.language != "javascript" and name.split(".")[0] in SCRIPT_OBJECTS

    def declare(self, i: int, hi: int, level: Level) -> int | None:
        first, exported, default = i, False, False
        if level.kind == "class":
            return self.member(i, hi, level)
        while self.text(i) == "@":
            i = self.past(i + 2) if self.text(i + 2) == "(" else i + 2
        while self.text(i) in ("export", "default", "declare", "abstract", "async") and (self.word(i + 1) or self.text(i) == "export"):
            exported |= self.text(i) == "export"
            default |= self.text(i) == "default"
            i += 1
        shown = "public" if exported else "private"
        if level.kind == "function":
            shown = "private"
        word = self.text(i)
        if word == "import" and self.text(i + 1) not in ("(", "."):
            return self.imports(i, hi, level)
        if word == "function":
            k = i + 1 + (self.text(i + 1) == "*")
            name = self.named(k) if self.word(k) else "default"
            return self.function(level, name, first, k + self.word(k), hi, shown)
        if word in ("class", "interface") and (self.word(i + 1) or default):
            name = self.text(i + 1) if self.word(i + 1) and self.text(i + 1) not in ("extends", "implements") else "default"
            brace = self.find(i + 1, hi, ("{",))
            last = self.match.get(brace, brace)
            full = self.symbol(level, name, word, first, last, shown, qualify=True)
            self.scopes.add(brace, last, full)
            for k in range(i + 2, brace):
                if self.text(k) in ("extends", "implements"):
                    self.types(k + 1, self.find(k + 1, brace, ("extends", "implements")), full)
            if word == "class":
                self.level(brace + 1, last, Level(full, "class", name))
            else:
                self.interface(brace, last, full)
            return last + 1
        if word == "enum" and self.word(i + 1) or word == "const" and self.text(i + 1) == "enum":
            k = i + 1 + (word == "const")
            last = self.match.get(k + 1, k + 1)
            self.symbol(level, self.text(k), "enum", first, last, shown)
            return last + 1
        if word == "type" and self.word(i + 1) and self.text(i + 2) in ("=", "<"):
            last = self.alias_end(i + 2, hi)
            full = self.symbol(level, self.text(i + 1), "type_alias", first, last, shown)
            self.types(self.find(i + 2, last, ("=",)) + 1, last + 1, full)
            return last + 1
        if word in ("namespace", "module") and self.word(i + 1):
            brace = self.find(i + 1, hi, ("{", ";"))
            last = self.match.get(brace, brace)
            name = "".join(self.text(k) for k in range(i + 1, brace))
            full = self.symbol(level, name, "module", first, last, shown)
            self.level(brace + 1, last, Level(full, "namespace", name))
            return last + 1
        if word in ("const", "let", "var"):
            return self.variables(i, hi, level, first, shown, word == "const")
        return None

    def alias_end(self, i: int, hi: int) -> int:
        while i < hi:
            if self.text(i) == ";":
                return i
            after = self.past(i)
            if after >= hi or self.code[after].line > self.code[after - 1].end_line and self.text(after) not in ("|", "&", "?", ":", "=>") and self.text(after - 1) not in ("|", "&", "=", "=>", "?", ":", "<", ","):
                return after - 1
            i = after
        return hi - 1

    def function(self, level: Level, name: str, first: int, p: int, hi: int, shown: str, kind: str | None = None) -> int:
        p = self.angle(p)
        after = self.past(p)
        brace = self.body(after, hi)
        last = self.match.get(brace, brace) if self.text(brace) == "{" else max(first, brace - 1)
        full = self.symbol(level, name, kind or ("method" if level.kind == "class" else "function"), first, last, shown, (brace, last) if self.text(brace) == "{" else None)
        if self.language != "javascript":
            self.parameters(p, full)
            if self.text(after) == ":":
                self.types(after + 1, brace, full)
        if self.text(brace) == "{":
            self.level(brace + 1, last, Level(full, "function", name))
        return last + 1

    def body(self, i: int, hi: int) -> int:
        """The brace of a body; one right after a colon is an object type."""
        while i < hi and self.text(i) not in ("{", ";"):
            if self.code[i].line > self.code[i - 1].end_line and self.text(i - 1) not in (":", "|", "&", "=>", ",", ")"):
                return i
            i += 1 if self.text(i) != ":" else 1
            if self.text(i) == "{" and self.text(i - 1) in (":", "|", "&"):
                i = self.past(i)
        return i

    def parameters(self, p: int, caller: str) -> None:
        close, k = self.match.get(p, p), p + 1
        while k < close:
            end = self.find(k, close, (",",))
            colon = self.find(k, end, (":",))
            self.types(colon + 1, self.find(colon, end, ("=",)), caller)
            k = end + 1

    def member(self, i: int, hi: int, level: Level) -> int | None:
        first, shown, accessor = i, "public", False
        while self.text(i) == "@":
            i = self.past(i + 2) if self.text(i + 2) == "(" else i + 2
        while self.text(i) in ("public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "get", "set", "accessor", "*") and self.text(i + 1) not in ("(", "=", ";", ":", "?"):
            shown = {"private": "private", "protected": "internal"}.get(self.text(i), shown)
            accessor |= self.text(i) in ("get", "set")
            i += 1
        if not self.word(i):
            return self.statement_end(i, hi)
        name = self.text(i)
        if name.startswith("#"):
            shown = "private"
        elif name.startswith("_") and self.language == "javascript":
            shown = "internal"
        p = self.angle(i + 1 + (self.text(i + 1) in ("?", "!")))
        if self.text(p) == "(":
            self.named(i)
            return self.function(level, name, first, p, hi, shown, "property" if accessor else "method")
        value = self.find(i + 1, hi, ("=", ";"))
        own = self.alias_end(i, hi)
        if self.text(value) == "=" and value <= own and self.is_function(value + 1):
            return self.arrow(level, name, first, value + 1, hi, shown, "method")
        full = self.symbol(level, name, "property", first, own, shown)
        if self.text(i + 1) in (":", "?", "!") and self.language != "javascript":
            self.types(i + 2, self.find(i + 1, own + 1, ("=",)), full)
        return own + 1

    def is_function(self, i: int) -> bool:
        i += self.text(i) == "async"
        if self.text(i) == "function":
            return True
        i = self.angle(i)
        after = self.past(i)
        if self.text(after) == ":":
            after = self.find(after, min(after + 40, len(self.code)), ("=>", ";", "{"))
        return self.text(after) == "=>"

    def arrow(self, level: Level, name: str, first: int, i: int, hi: int, shown: str, kind: str) -> int:
        i += self.text(i) == "async"
        if self.text(i) == "function":
            k = i + 1 + (self.text(i + 1) == "*")
            return self.function(level, name, first, k + self.word(k), hi, shown, kind)
        p = self.angle(i)
        arrow = self.find(self.past(p), hi, ("=>",))
        last = self.match.get(arrow + 1, arrow) if self.text(arrow + 1) == "{" else self.alias_end(arrow + 1, hi)
        full = self.symbol(level, name, kind, first, last, shown, (arrow, last))
        if self.language != "javascript" and self.text(p) == "(":
            self.parameters(p, full)
            self.types(self.past(p) + 1, arrow, full)
        if self.text(arrow + 1) == "{":
            self.level(arrow + 2, last, Level(full, "function", name))
        return last + 1

    def variables(self, i: int, hi: int, level: Level, first: int, shown: str, const: bool) -> int:
        k = i + 1
        while k < hi:
            if not self.word(k):  # a pattern
                return self.alias_end(k, hi) + 1
            name = self.text(k)
            end = self.alias_end(k, hi)
            value = self.find(k + 1, end + 1, ("=", ","))
            if self.text(value) == "=" and self.is_function(value + 1):
                if level.kind == "function":
                    return end + 1
                return self.arrow(level, name, first, value + 1, hi, shown, "function")
            comma = self.find(k + 1, end + 1, (",",))
            if level.kind != "function":
                full = self.symbol(level, name, "constant" if const and is_constant(name) else "variable", first, min(comma, end), shown)
                if self.text(k + 1) == ":" and self.language != "javascript":
                    self.types(k + 2, self.find(k + 1, end + 1, ("=",)), full)
            if comma > end:
                return end + 1
            k = comma + 1
        return hi

    def interface(self, brace: int, last: int, full: str) -> None:
        k, own = brace + 1, Level(full, "interface")
        while k < last:
            if not self.word(k):
                k += 1
                continue
            first = k
            k += self.text(k) == "readonly" and self.word(k + 1)
            end = self.find(k, last, (";", ","))
            line = self.alias_end(k, last)
            end = min(end, line + 1)
            p = self.angle(k + 1 + (self.text(k + 1) == "?"))
            method = self.text(p) == "("
            if method:
                self.named(k)
            self.symbol(own, self.text(k), "method" if method else "property", first, end - 1, "public")
            self.types(p + 1, end, full) if not method else (self.parameters(p, full), self.types(self.past(p) + 1, end, full))
            k = max(end, k + 1)

    def imports(self, i: int, hi: int, level: Level) -> int:
        last = i + 1
        while last < hi and self.code[last].kind != "string":
            last += 1
        module = self.code[last].text.strip("\"'`") if last < hi else ""
        k = i + 1 + (self.text(i + 1) == "type" and self.text(i + 2) != "from")
        if k == last:
            self.imported(level, module, i, last)
        while k < last:
            if self.text(k) == "{":
                close, at = self.match.get(k, last), k + 1
                while at < close:
                    at += self.text(at) == "type" and self.word(at + 1) and self.text(at + 1) != "as"
                    if self.word(at):
                        alias = self.text(at + 2) if self.text(at + 1) == "as" else None
                        self.imported(level, f"{module}.{self.text(at)}", i, last, alias)
                        at += 2 if alias else 0
                    at += 1
                k = close
            elif self.text(k) == "*":
                self.imported(level, f"{module}.*", i, last, self.text(k + 2) or None)
                k += 2
            elif self.word(k) and self.text(k) != "from":
                self.imported(level, module, i, last, self.text(k))
            k += 1
        return last + 1 + (self.text(last + 1) == ";")


class Typed(Reader):
    """What Java, C# and C++ classes share: modifiers, then a type declaration, a method or a field."""

    TYPES = {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "record": "struct", "union": "struct"}

    def visibility(self, modifiers: set[str], level: Level) -> str:
        if "public" in modifiers:
            return "public"
        if "private" in modifiers and "protected" not in modifiers:
            return "private"
        if "protected" in modifiers or "internal" in modifiers:
            return "internal"
        return level.default

    def modifiers(self, i: int) -> tuple[int, set[str]]:
        found: set[str] = set()
        while True:
            if self.text(i) == "@" and self.text(i + 1) != "interface":
                i += 2
                while self.text(i) == ".":
                    i += 2
                i = self.past(i) if self.text(i) == "(" else i
            elif self.text(i) == "[" and self.family == "csharp":
                i = self.past(i)
            elif self.text(i) in MODIFIERS and not (self.text(i) == "default" and self.text(i + 1) == ":"):
                found.add(self.text(i))
                i += 1
            else:
                return i, found

    def type_body(self, i: int, hi: int, first: int, level: Level, shown: str, kind: str) -> int:
        name = self.named(i)
        brace = self.find(i + 1, hi, ("{", ";"))
        last = self.match.get(brace, brace) if self.text(brace) == "{" else brace
        full = self.symbol(level, name, kind, first, last, shown)
        k = self.angle(i + 1)
        if self.text(k) == "(":  # a record's components
            self.components(k, Level(full, "class", name))
            k = self.past(k)
        for x in range(k, brace):
            if self.text(x) in ("extends", "implements", ":", "permits"):
                self.types(x + 1, self.find(x + 1, brace, ("extends", "implements", "permits", "where")), full)
        if self.text(brace) == "{":
            self.scopes.add(brace, last, full)
            start = brace + 1
            if kind == "enum":
                start = self.constants(brace, last, full)
            self.level(start, last, Level(full, kind, name, self.member_default(kind)))
        return last + 1

    def member_default(self, kind: str) -> str:
        return "public" if kind == "interface" else "internal"

    def components(self, p: int, level: Level) -> None:
        close, k = self.match.get(p, p), p + 1
        while k < close:
            end = self.find(k, close, (",",))
            if self.word(end - 1) and end - 1 > k:
                self.symbol(level, self.text(end - 1), "property", k, end - 1, "public")
                self.types(k, end - 1, level.parent)
            k = end + 1

    def constants(self, brace: int, last: int, full: str) -> int:
        k = brace + 1
        while k < last and self.text(k) != ";":
            if self.word(k):
                self._names.add(k)
                end = self.find(k, last, (",", ";"))
                if self.family != "java":
                    self.symbol(Level(full, "enum"), self.text(k), "constant", k, end - 1, "public")
                k = end
            k += self.text(k) != ";"
        return k + 1

    def method_or_field(self, i: int, hi: int, first: int, level: Level, shown: str, modifiers: set[str]) -> int | None:
        k = self.angle(i)
        stop = k
        while stop < hi and self.text(stop) not in ("(", "=", ";", "{", "=>", ","):
            stop = self.angle(stop) if self.text(stop) == "<" and self.angle(stop) > stop else self.past(stop)
        if stop >= hi:
            return None
        name_at = stop - 1
        while name_at > k and self.text(name_at) in (">", "]", "["):
            name_at -= 1
        if self.text(stop - 1) == ">":
            back = stop - 1
            while back > k and self.text(back) != "<":
                back -= 1
            name_at = back - 1
        if not self.word(name_at) or self.text(name_at) in CONTROL:
            return None
        name = self.text(name_at)
        if self.text(stop) == "(":
            constructor = name == level.name and name_at == k
            if name_at == k and not constructor and level.kind not in ("class", "struct", "interface", "enum"):
                return None
            self.named(name_at)
            if self.text(name_at - 1) == "~":
                name = "~" + name
            body = self.find(self.past(stop), hi, ("{", ";", "=>", "="))
            last = self.match.get(body, body) if self.text(body) == "{" else self.find(body, hi, (";",))
            kind = "constructor" if constructor else "method"
            full = self.symbol(level, name, kind, first, last, shown, (body, last) if self.text(body) in ("{", "=>") else None)
            self.types(k, name_at, full)
            self.typed_parameters(stop, full)
            return last + 1
        if name_at == k and self.text(stop) != "{":
            return None
        last = self.find(stop, hi, (";",))
        if self.text(stop) in ("{", "=>") and self.family == "csharp":
            last = self.match.get(stop, stop) if self.text(stop) == "{" else last
            if self.text(last + 1) == "=":
                last = self.find(last, hi, (";",))
            full = self.symbol(level, name, "property", first, last, shown, (stop, last))
            self.types(k, name_at, full)
            return last + 1
        kind = "constant" if self.constant(modifiers) else "property"
        at = name_at
        while at < last and self.word(at):
            self.symbol(level, self.text(at), kind, first, last, shown)
            comma = self.find(at + 1, last, (",",))
            if comma >= last:
                break
            at = comma + 1
        self.types(k, name_at, level.parent)
        return last + 1

    def constant(self, modifiers: set[str]) -> bool:
        return "const" in modifiers or {"static", "final"} <= modifiers or {"static", "readonly"} <= modifiers

    def typed_parameters(self, p: int, caller: str) -> None:
        close, k = self.match.get(p, p), p + 1
        while k < close:
            end = self.find(k, close, (",",))
            stop = self.find(k, end, ("=",))
            if self.word(stop - 1) and stop - 1 > k:
                self.types(k, stop - 1, caller)
            k = end + 1


class Java(Typed):
    def __init__(self, source: str, language: str) -> None:
        super().__init__(source, language)
        self.primitive |= self.skip  # neither calls nor types

    def skipped(self, name: str, base: str) -> bool:
        return name in self.skip

    def declare(self, i: int, hi: int, level: Level) -> int | None:
        first = i
        i, modifiers = self.modifiers(i)
        word = self.text(i)
        if word in ("import", "package"):
            last = self.find(i, hi, (";",))
            k = i + 1 + (self.text(i + 1) == "static")
            name = "".join(self.text(x) for x in range(k, last))
            if word == "import":
                self.imported(level, name, first, last)
            else:
                self.symbol(level, name, "module", first, last, "public")
            return last + 1
        shown = self.visibility(modifiers, Level(default="public" if level.kind == "interface" else "internal"))
        if word == "@" and self.text(i + 1) == "interface":
            return self.type_body(i + 2, hi, first, level, shown, "annotation")
        if word in self.TYPES and self.word(i + 1) and not (word == "record" and self.text(i + 2) not in ("(", "<")):
            return self.type_body(i + 1, hi, first, level, shown, self.TYPES[word])
        if word == "{":
            return self.past(i)
        return self.method_or_field(i, hi, first, level, shown, modifiers) if level.parent else None


class CSharp(Typed):
    def skipped(self, name: str, base: str) -> bool:
        return name in self.skip or name in ("base", "this", "nameof", "typeof", "default", "checked", "unchecked")  # no calls: initialisers and operators

    def member_default(self, kind: str) -> str:
        return "public" if kind == "interface" else "private"

    def declare(self, i: int, hi: int, level: Level) -> int | None:
        first = i
        i, modifiers = self.modifiers(i)
        word = self.text(i)
        if word == "global" and self.text(i + 1) == "using":
            i, word = i + 1, "using"
        if word == "using" and self.text(i + 1) != "(" and level.kind in ("", "namespace"):
            last = self.find(i, hi, (";",))
            k = i + 1 + (self.text(i + 1) == "static")
            alias = self.text(k) if self.text(k + 1) == "=" else None
            self.imported(level, "".join(self.text(x) for x in range(k + 2 * (alias is not None), last)), first, last, alias)
            return last + 1
        if word == "namespace":
            stop = self.find(i, hi, ("{", ";"))
            name = "".join(self.text(x) for x in range(i + 1, stop))
            last = self.match.get(stop, stop) if self.text(stop) == "{" else hi - 1
            full = self.symbol(level, name, "module", first, last, "public")
            self.scopes.add(stop, last, full)
            self.level(stop + 1, last + (self.text(stop) == ";"), Level(full, "namespace", name, "private"))
            return last + 1
        shown = self.visibility(modifiers, Level(default=level.default if level.parent else "private"))
        if level.kind in ("", "namespace") and not modifiers & {"public", "private", "protected", "internal"}:
            shown = "private"
        if word == "record" and self.text(i + 1) in ("class", "struct"):
            i += 1
        if word in self.TYPES and self.word(i + 1):
            return self.type_body(i + 1, hi, first, level, shown, self.TYPES[word])
        if word == "event":  # neither a member that is called nor a type of one
            stop = self.find(i, hi, (";", "{"))
            return self.past(stop)
        if word == "delegate":
            last = self.find(i, hi, (";",))
            p = self.find(i, last, ("(",))
            self.symbol(level, self.named(p - 1), "type_alias", first, last, shown)
            return last + 1
        return self.method_or_field(i, hi, first, level, shown, modifiers) if level.parent and level.kind != "namespace" else None


class C(Typed):
    def __init__(self, source: str, language: str) -> None:
        super().__init__(source, language)
        if language == "cpp":
            self.skip, self.primitive = SKIP["cpp"], PRIMITIVE["cpp"] | PRIMITIVE["c"]

    def skipped(self, name: str, base: str) -> bool:
        """A call through an object or a namespace is named with it, and stays."""
        return name in self.skip

    def member_default(self, kind: str) -> str:
        return "private" if kind == "class" else "public"

    def directive(self, t) -> None:
        import re

        def put(name: str, kind: str, visibility: str = "public") -> None:
            self.out.symbols.append(Symbol(name, kind, t.line, t.end_line, None, None, None, visibility))

        if m := re.match(r'\s*#\s*include\s*[<"]([^>"]+)[>"]', t.text):
            put(m[1], "import", "private")
            self.out.refs.append(Ref(m[1], "import", t.line, t.line, None))
        elif m := re.match(r"\s*#\s*define\s+(\w+)(\(?)", t.text):
            put(m[1], "macro" if m[2] else "constant")

    def declare(self, i: int, hi: int, level: Level) -> int | None:
        first = i
        if self.text(i) in ("public", "private", "protected") and self.text(i + 1) == ":":
            level.default = {"protected": "internal"}.get(self.text(i), self.text(i))
            return i + 2
        if self.text(i) == "template":
            i = self.angle(i + 1)
        modifiers: set[str] = set()
        while self.text(i) in MODIFIERS or self.text(i) == "[" and self.text(i + 1) == "[":
            modifiers.add(self.text(i))
            i = self.past(i) if self.text(i) == "[" else i + 1
        word = self.text(i)
        shown = level.default if level.kind in ("class", "struct") else "private" if "static" in modifiers or level.default == "private" else "public"
        if word == "extern" and i + 1 < hi and self.code[i + 1].kind == "string" and self.text(i + 2) == "{":
            self.level(i + 3, self.match[i + 2], level)
            return self.past(i + 2)
        if word == "namespace":
            brace = self.find(i, hi, ("{", ";"))
            if self.text(brace) != "{":
                return brace + 1
            name = "".join(self.text(x) for x in range(i + 1, brace))
            last = self.match[brace]
            if name:
                full = self.symbol(level, name, "module", first, last, "public")
                self.scopes.add(brace, last, full)
                self.level(brace + 1, last, Level(full, "namespace", name))
            else:
                self.level(brace + 1, last, Level(level.parent, "namespace", "", "private"))
            return last + 1
        if word == "using":
            last = self.find(i, hi, (";",))
            if self.text(i + 2) == "=":
                self.symbol(level, self.text(i + 1), "type_alias", first, last, shown)
            else:
                k = i + 1 + (self.text(i + 1) in ("namespace", "typename"))
                self.imported(level, "".join(self.text(x) for x in range(k, last)), first, last)
            return last + 1
        if word == "typedef":
            last = self.find(i, hi, (";",))
            if self.text(i + 1) in self.TYPES:
                brace = self.find(i + 1, last, ("{",))
                if brace < last and brace > i + 2:
                    self.aggregate(i + 1, last, i + 1, level, "public", self.TYPES[self.text(i + 1)])
            name = next((x for x in range(last - 1, i, -1) if self.word(x)), None)
            group = self.find(i, last, ("(",))
            if group < last and self.text(group + 1) == "*":
                name = group + 2
            if name is not None:
                self.symbol(level, self.named(name), "type_alias", first, last, shown)
            return last + 1
        if word in self.TYPES and word not in ("interface", "record"):
            brace = self.find(i, hi, ("{", ";", "(", "="))
            if self.text(brace) == "{" and brace > i + 1:
                return self.aggregate(i, hi, first, level, shown, self.TYPES[word])
            if self.text(brace) == "{":
                return self.statement_end(i, hi)
            if self.text(brace) == ";" and brace == i + 2:
                return brace + 1
            i += 1
        return self.function_or_variable(i, hi, first, level, shown, modifiers)

    def aggregate(self, i: int, hi: int, first: int, level: Level, shown: str, kind: str) -> int:
        k = i + 1 + (kind == "enum" and self.text(i + 1) in ("class", "struct"))
        brace = self.find(i, hi, ("{",))
        last = self.match.get(brace, brace)
        name = self.text(k)
        full = self.symbol(level, name, kind, first, last, shown)
        if kind == "enum":
            self.constants(brace, last, full)
        else:
            for x in range(k + 1, brace):
                if self.text(x) == ":":
                    self.types(x + 1, brace, full)
            self.scopes.add(brace, last, full)
            self.level(brace + 1, last, Level(full, kind, name, self.member_default(kind if self.code[i].text == "class" else "struct")))
        return self.find(last, hi, (";",)) + 1

    def function_or_variable(self, i: int, hi: int, first: int, level: Level, shown: str, modifiers: set[str]) -> int | None:
        stop = i
        while stop < hi and self.text(stop) not in ("(", "=", ";", "{", ","):
            stop = self.angle(stop) if self.text(stop) == "<" and self.angle(stop) > stop else self.past(stop)
        if stop >= hi or stop == i:
            return None
        name_at = stop - 1
        while name_at > i and not self.word(name_at):
            name_at -= 1
        if not self.word(name_at) or self.text(name_at) in CONTROL:
            return None
        name, member = self.text(name_at), level.kind in ("class", "struct")
        if self.text(name_at - 1) == "~":
            name = "~" + name
        if self.text(stop) == "(" and self.text(stop + 1) != "*":
            constructor = name.lstrip("~") == level.name
            owner, begin = level, name_at - (self.text(name_at - 1) == "~")
            while self.text(begin - 1) == "::" and self.word(begin - 2) and begin - 2 >= i:
                begin -= 2
            if begin < name_at - (self.text(name_at - 1) == "~"):
                around = "::".join(self.text(x) for x in range(begin, name_at, 2) if self.word(x))
                owner = Level(around, "class", around.rpartition("::")[2])
            elif name_at == i and not constructor:
                return None
            self.named(name_at)
            body = self.find(self.past(stop), hi, ("{", ";", "="))
            last = self.match.get(body, body) if self.text(body) == "{" else self.find(body, hi, (";",))
            kind = "method" if member or owner is not level else "function"
            full = self.symbol(owner, name, kind, first, last, shown, (body, last) if self.text(body) == "{" else None)
            self.types(i, begin, full)
            return last + 1
        if name_at == i:
            return None
        last = self.find(stop, hi, (";",))
        kind = "property" if member else "constant" if is_constant(name) and self.text(stop) == "=" else "variable"
        at = name_at
        while at < last and self.word(at):
            self.symbol(level, self.text(at), kind, first, last, shown)
            comma = self.find(at + 1, last, (",",))
            if comma >= last:
                break
            at = comma + 1
            while self.text(at) == "*":
                at += 1
        if member:
            self.types(i, name_at, level.parent)
        return last + 1


READERS = {"rust": Rust, "go": Go, "javascript": Script, "typescript": Script, "tsx": Script, "java": Java, "csharp": CSharp, "c": C, "cpp": C}


def extract(source: str, language: str) -> Extracted:
    return READERS[language](source, language).run()
