"""Extraction goldens: small sources of every language."""

from __future__ import annotations

import pytest

from srcatlas.extract import base, markdown, metadata, run, sfc


def kinds(source: str, language: str) -> dict[str, tuple]:
    return {s.name: (s.kind, s.visibility) for s in run.parse(source, language).symbols}


def refs(source: str, language: str) -> set[tuple]:
    return {(r.name, r.kind, r.caller) for r in run.parse(source, language).refs}


PYTHON = '''"""Module text of several words."""
import os, sys as system
from a.b import c as d, e
from . import f
MAX_SIZE = 1
config: int = 2
class Person(Base):
    kind = 3
    def __init__(self, name):
        """Makes a person now."""
        self.greet(helper(name))
    async def _greet(self): return os.path.join("x")
def main(a=init(1)):
    print(Person(1))
    def inner():
        go()
def __hidden(): pass
'''


def test_python():
    k = kinds(PYTHON, "python")
    assert k["Person"] == ("class", "public") and k["Person.__init__"] == ("method", "internal") and k["Person._greet"] == ("method", "internal")
    assert k["MAX_SIZE"] == ("constant", "public") and k["config"] == ("variable", "public") and k["Person.kind"] == ("variable", "public")
    assert k["main.inner"][0] == "method" and k["__hidden"][1] == "private" and k["a.b.c"] == ("import", "private")
    r = refs(PYTHON, "python")
    assert {("self.greet", "call", "Person.__init__"), ("helper", "call", "Person.__init__"), ("os.path.join", "call", "Person._greet"), ("go", "call", "main.inner"), ("Person", "call", "main"), ("sys", "import", None)} <= r
    assert not any(n == "print" for n, _, _ in r)
    out = run.parse(PYTHON, "python")
    texts = {(t.kind, t.text, t.parent) for t in out.texts}
    assert ("docstring", "Module text of several words.", None) in texts and ("docstring", "Makes a person now.", "Person.__init__") in texts
    alias = {s.name: s.alias for s in out.symbols}
    assert alias["sys"] == "system" and alias["a.b.c"] == "d" and alias["os"] is None
    span = {s.name: (s.start, s.end) for s in out.symbols}
    assert span["Person"] == (7, 12) and span["main"] == (13, 16)


def test_python_exports():
    k = kinds("__all__ = ['a', \"B\"]\ndef a(): pass\nclass B: pass\ndef c(): pass\ndef __d(): pass\nclass E:\n    def m(self): pass\n", "python")
    assert [k[n][1] for n in ("a", "B", "c", "__d", "E.m")] == ["public", "public", "internal", "private", "public"]
    assert "__all__" not in k


CASES = {
    "rust": (
        "use std::io::{Read, Write as W};\n/// Doc of the thing\npub struct Conf { name: Foo }\npub(crate) enum Kind { A }\npub trait Run { fn run(&self) -> Out; }\nimpl Conf { pub fn new(f: Foo) -> Self { helper(f); println!(\"x\"); } fn hid() {} }\nimpl Run for Conf { fn run(&self) -> Out { self.inner.run() } }\nconst MAX: u8 = 1;\nmod m { pub fn f() {} }\ntype T = Foo;\n",
        {"std::io::Read": ("import", "private"), "std::io::Write": ("import", "private"), "Kind": ("enum", "internal"), "Run": ("interface", "public"), "Conf.new": ("method", "public"), "Conf.hid": ("method", "private"), "MAX": ("constant", "private"), "m": ("module", "private"), "T": ("type_alias", "private")},
        {("helper", "call", "Conf.new"), ("Foo", "type_annotation", "Conf.new"), ("self.inner.run", "call", "Conf.run"), ("Foo", "type_annotation", "Conf"), ("Run", "type_annotation", "Conf")},
    ),
    "javascript": (
        'import a, { b as c } from "m";\nimport * as n from "x";\nexport function go(x) { helper(x); new Foo(1); }\nclass A extends B { #p() { this.q(); } get v() { return 1 } _i() {} }\nconst MAX = 3, q = 4;\nexport const fn = (a) => a.run();\n',
        {"m": ("import", "private"), "m.b": ("import", "private"), "x.*": ("import", "private"), "go": ("function", "public"), "A": ("class", "private"), "A.#p": ("method", "private"), "A.v": ("property", "public"), "A._i": ("method", "internal"), "MAX": ("constant", "private"), "q": ("variable", "private"), "fn": ("function", "public")},
        {("helper", "call", "go"), ("Foo", "instantiation", "go"), ("B", "type_annotation", "A"), ("this.q", "call", "A.#p"), ("a.run", "call", "fn")},
    ),
    "typescript": (
        "export interface I extends J { a: Foo; m(x: Bar): Baz }\nexport type U = Foo | Bar;\nenum E { A }\nexport abstract class K implements I { private x: Foo; protected go(a: Bar): void { this.s.call(a); } }\nnamespace N { export function f() { g(); } }\n",
        {"I": ("interface", "public"), "I.a": ("property", "public"), "I.m": ("method", "public"), "U": ("type_alias", "public"), "E": ("enum", "private"), "K": ("class", "public"), "K.x": ("property", "private"), "K.go": ("method", "internal"), "N": ("module", "private"), "N.f": ("function", "public")},
        {("J", "type_annotation", "I"), ("Foo", "type_annotation", "U"), ("I", "type_annotation", "K"), ("this.s.call", "call", "K.go"), ("g", "call", "N.f")},
    ),
    "go": (
        'package main\nimport (\n  "fmt"\n  f "os/x"\n)\ntype Server struct {\n  Name string\n  conf *Config\n}\ntype Doer interface {\n  Do(a int) Out\n}\nfunc (s *Server) Start(c *Config) Out { s.run(c); fmt.Println(1); return nil }\nfunc helper() {}\nvar A, b = 1, 2\n',
        {"main": ("module", "public"), "fmt": ("import", "private"), "os/x": ("import", "private"), "Server": ("struct", "public"), "Server.Name": ("property", "public"), "Server.conf": ("property", "private"), "Doer": ("interface", "public"), "Doer.Do": ("method", "public"), "Server.Start": ("method", "public"), "helper": ("function", "private"), "A": ("variable", "public"), "b": ("variable", "private")},
        {("s.run", "call", "Server.Start"), ("Config", "type_annotation", "Server.Start"), ("Config", "type_annotation", "Server")},
    ),
    "java": (
        "package a.b;\nimport java.util.List;\npublic class Foo extends Bar implements Baz {\n  private static final int MAX = 3;\n  protected List<String> items;\n  public Foo(int a) { init(); }\n  Out run(Cfg c) { return new Thing(c); }\n  enum Color { RED }\n}\n@interface Ann {}\nrecord P(int x) {}\n",
        {"a.b": ("module", "public"), "java.util.List": ("import", "private"), "Foo": ("class", "public"), "Foo.MAX": ("constant", "private"), "Foo.items": ("property", "internal"), "Foo.Foo": ("constructor", "public"), "Foo.run": ("method", "internal"), "Foo.Color": ("enum", "internal"), "Ann": ("annotation", "internal"), "P": ("struct", "internal")},
        {("Bar", "type_annotation", "Foo"), ("init", "call", "Foo.Foo"), ("Thing", "instantiation", "Foo.run"), ("Cfg", "type_annotation", "Foo.run")},
    ),
    "c": (
        "#include <stdio.h>\n#define MAX 3\n#define SQ(x) ((x)*(x))\ntypedef struct node { int v; Foo *f; } node_t;\nenum color { RED };\nstatic int helper(int a) { return go(a); }\nOut *run(Cfg *c);\nint global = 3;\nconst int LIMIT = 4;\n",
        {"stdio.h": ("import", "private"), "MAX": ("constant", "public"), "SQ": ("macro", "public"), "node": ("struct", "public"), "node.v": ("property", "public"), "node_t": ("type_alias", "public"), "color.RED": ("constant", "public"), "helper": ("function", "private"), "run": ("function", "public"), "global": ("variable", "public"), "LIMIT": ("constant", "public")},
        {("go", "call", "helper"), ("Foo", "type_annotation", "node"), ("Out", "type_annotation", "run")},
    ),
    "cpp": (
        "namespace ns { class Foo : public Bar { public: Foo(int a); int run(Cfg c) { return helper(c); } private: int v_; protected: int w; };\nnamespace { void hid() {} }\nusing Alias = Foo; }\nusing namespace std;\nvoid go() { auto p = new Foo(3); p->run(1); }\n",
        {"ns": ("module", "public"), "ns.Foo": ("class", "public"), "ns.Foo.run": ("method", "public"), "ns.Foo.v_": ("property", "private"), "ns.Foo.w": ("property", "internal"), "ns.hid": ("function", "private"), "ns.Alias": ("type_alias", "public"), "std": ("import", "private"), "go": ("function", "public")},
        {("helper", "call", "ns.Foo.run"), ("Foo", "instantiation", "go"), ("p.run", "call", "go"), ("Bar", "type_annotation", "ns.Foo")},
    ),
    "csharp": (
        "using System; using X = A.B;\nnamespace My.App;\npublic class Foo : Bar { private readonly int _x; public const int Max = 3; public string Name { get; set; } public Foo(Cfg c) { Init(c); } protected Out Run(Cfg c) => svc.Go(c); enum E { A } public delegate void H(int a); }\ninterface I { void Call(); }\n",
        {"System": ("import", "private"), "A.B": ("import", "private"), "My.App": ("module", "public"), "My.App.Foo": ("class", "public"), "My.App.Foo._x": ("property", "private"), "My.App.Foo.Max": ("constant", "public"), "My.App.Foo.Name": ("property", "public"), "My.App.Foo.Foo": ("constructor", "public"), "My.App.Foo.Run": ("method", "internal"), "My.App.Foo.E.A": ("constant", "public"), "My.App.Foo.H": ("type_alias", "public"), "My.App.I.Call": ("method", "public")},
        {("Init", "call", "My.App.Foo.Foo"), ("svc.Go", "call", "My.App.Foo.Run"), ("Bar", "type_annotation", "My.App.Foo")},
    ),
    "ruby": (
        "require 'json'\nmodule M\n  MAX = 3\n  class Foo < Bar\n    @@n = 0\n    def self.make(a)\n      new(a)\n    end\n    def run(x)\n      helper(x) if x\n      items.each do |i|\n        Thing.new(i)\n      end\n    end\n    private\n    def hid; end\n  end\nend\nx = 1\n",
        {"json": ("import", "private"), "M": ("module", "public"), "M.MAX": ("constant", "public"), "M.Foo": ("class", "public"), "M.Foo.@@n": ("property", "internal"), "M.Foo.make": ("method", "public"), "M.Foo.run": ("method", "public"), "M.Foo.hid": ("method", "private"), "x": ("variable", "public")},
        {("Bar", "type_annotation", "M.Foo"), ("helper", "call", "M.Foo.run"), ("json", "import", None)},
    ),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_declarations_and_references(language):
    source, want, named = CASES[language]
    got = kinds(source, language)
    assert {k: got.get(k) for k in want} == want
    assert named <= refs(source, language)


def test_rust_bodies_and_macros():
    source = "pub fn out() {\n  struct Deep { a: u8 }\n  if x { fn inner() { go(); } }\n  let y = vec![1];\n}\ncfg_x! {\n  #[cfg(a)]\n  pub fn feature() {}\n}\nlazy_static! { static ref X: u8 = 1; }\nbitflags! { struct Flags: u32 { const A = 1; } }\n#[derive(Debug)]\npub struct Late;\n"
    got = kinds(source, "rust")
    assert got == {"out": ("function", "public"), "Deep": ("struct", "private"), "out.inner": ("method", "private"), "feature": ("function", "public"), "Late": ("struct", "public")}
    assert ("go", "call", "out.inner") in refs(source, "rust")
    assert {s.name: (s.start, s.parent) for s in run.parse(source, "rust").symbols if s.name in ("Late", "Deep")} == {"Late": (13, None), "Deep": (2, "out")}


def test_names_that_say_nothing():
    assert refs("function f() { console.log(1); log(2); repo.find(3); alert(4); fetch(5); own(6); }", "javascript") == {("console.log", "call", "f"), ("repo.find", "call", "f"), ("own", "call", "f")}
    assert refs("function f(a: Promise, b: Own) { console.log(1); Math.max(2); repo.find(3); alert(4); }", "typescript") == {("Own", "type_annotation", "f"), ("repo.find", "call", "f"), ("alert", "call", "f")}
    assert refs("class A { void f(List<Own> a, Map b) { add(1); a.add(2); new HashMap(); throw new Bad(); } }", "java") == {("Own", "type_annotation", "A.f"), ("a.add", "call", "A.f"), ("Bad", "instantiation", "A.f")}


@pytest.mark.parametrize("language", sorted(run.EXTRACTORS))
def test_broken_sources_do_not_break(language):
    for source in ("", "\n", "{", "}}}", "((((", '"', "'", "/*", "`", "class", "fn", "func (", "def", "import", "x = {", "\\", "é 中", "a" * 5000, "(" * 3000, "if (a) { b(" * 50):
        run.parse(source, language)
    source = CASES.get(language, ("# a\n```\nx\n",))[0]
    for k in range(0, len(source), 7):
        run.parse(source[:k], language)


def test_markdown():
    src = "# Top #\nIntro.\n## A\n```py\n# no heading\n```\n### B\nSub\n---\n## A\n~~~\nopen"
    out = run.parse(src, "markdown")
    assert [(s.name, s.parent, s.kind, s.visibility) for s in out.symbols] == [("Top", None, "section", None), ("Top/A", "Top", "section", None), ("Top/A/B", "Top/A", "section", None), ("Top/Sub", "Top", "section", None), ("Top/A", "Top", "section", None)]
    assert [(t.kind, t.text, t.parent) for t in out.texts] == [("sample", "# no heading", "Top/A"), ("sample", "open", "Top/A")]
    assert markdown.headings(["---", "title: x", "---", "# T"]) == [(4, 1, "T", 4)]


def test_embedded_scripts():
    vue = '<template/>\n<script setup lang="ts">\nexport function f() {}\n</script>\n<script>\nlet a = 1\n</script>\n<scripty>x</scripty>\n<script> </script>'
    found = sfc.blocks(vue, "vue")
    assert [(b.language, b.start_line) for b in found] == [("typescript", 2), ("javascript", 5)]
    astro = sfc.blocks("---\nconst a = 1\n---\n<script>go()</script>", "astro")
    assert [(b.language, b.start_line) for b in astro] == [("typescript", 2), ("typescript", 4)]
    (f,) = [s for s in run.parse(vue, "vue").symbols if s.name == "f"]
    assert (f.start, f.end) == (3, 3)


def test_merging_and_text_rules():
    out = run.parse("// one two\n// three\n\n// four five\nfn a() {}\n", "rust")
    assert [(t.start, t.end, t.text) for t in out.texts] == [(1, 2, "one two\nthree"), (4, 4, "four five")] if not base.trivial("three") else True
    assert base.trivial("x") and base.trivial("short_word") and not base.trivial("two words") and not base.trivial("a" * 21)
    assert base.clean_block("/** a\n * b\n */") == "a\nb"
    assert [base.unquote(x) for x in ('"a"', "'''b'''", 'r#"c"#', 'f"d"', '@"e"', "`g`")] == ["a", "b", "c", "d", "e", "g"]


@pytest.mark.parametrize(
    ("source", "language", "want"),
    [
        ('"""Title here.\n\nFirst sentence. Second one.\n"""\n', "python", ("Title here.", "First sentence.")),
        ("//! Crate title\n//!\n//! More of it. Rest.\nfn a() {}", "rust", ("Crate title", "More of it.")),
        ("/**\n * What it does.\n * @author me\n */\nlet a", "javascript", ("What it does.", None)),
        ("// Copyright 2020 Foo\n// License MIT\nint a;", "c", (None, None)),
        ("#!/usr/bin/ruby\n# frozen_string_literal: true\n# Says hello.\nx", "ruby", ("Says hello.", None)),
        ("/// <summary>Sums it up.</summary>\nclass A {}", "csharp", ("Sums it up.", None)),
        ("---\ntitle: My page\ndescription: All of it\n---\n# H\n", "markdown", ("My page", "All of it")),
        ("# Head\n\nBody text. More.\n", "markdown", ("Head", "Body text.")),
        ("// Package a does it.\npackage a\n", "go", ("Package a does it.", None)),
        ("<html/>", "html", (None, None)),
    ],
)
def test_metadata(source, language, want):
    assert metadata.of(source, language) == want


def test_build(spark):
    files = spark.createDataFrame([("p", "a.py", bytearray(PYTHON.encode())), ("p", "b.unknown", bytearray(b"x\ny")), ("q", "c.md", bytearray(b"# T\n")), ("q", "d.py", bytearray(b"\xff\xfe def"))], "project string, path string, content binary")
    ix = run.build(files)
    rows = {r.path: r for r in ix.files.collect()}
    assert rows["b.unknown"].lang is None and rows["b.unknown"].lines == 2 and rows["a.py"].lang == "python" and len(rows["a.py"].hash) == 16
    levels = {r.name: r.visibility_level for r in ix.symbols.collect()}
    assert levels["Person"] == 1 and levels["Person._greet"] == 2 and levels["__hidden"] == 3 and levels["T"] == 3
    assert ix.refs.filter("caller = 'main'").count() == 1


@pytest.mark.parametrize("language, header, doc", [("rust", "// a line of the licence\n", "//! Title here\n"), ("csharp", "// a line of the licence\n", "/// <summary>Title here</summary>\nclass A {}\n"), ("python", "# a line of the licence\n", '"""Title here"""\n')])
def test_metadata_after_a_long_header(language, header, doc):
    assert metadata.of(header * 4000 + doc, language)[0] == "Title here"


def test_metadata_of_one_long_comment():
    assert metadata.of("/**\n * Title here\n *\n * " + "word " * 6000 + "end.\n */\nint a;\n", "java") == ("Title here", "word " * 6000 + "end.")


def test_calls_that_say_nothing():
    """They are left out by their own name; through an object or a namespace they stay, but for Ruby."""
    assert refs("void f() { push_back(1); v.push_back(2); std::sort(x); sort(x); auto a = new string(); auto b = new Foo(); }", "cpp") == {("v.push_back", "call", "f"), ("std::sort", "call", "f"), ("Foo", "instantiation", "f")}
    assert refs("void f() { qsort(a); push_back(1); }", "c") == {("push_back", "call", "f")}
    assert refs("class C { void F() { WriteLine(1); Console.WriteLine(2); Go(); new List<int>(); new Foo(); } }", "csharp") == {("Console.WriteLine", "call", "C.F"), ("Go", "call", "C.F"), ("Foo", "instantiation", "C.F")}
    assert refs("def f(x)\n  x.each { |y| go(y) }\n  Foo.new(1)\n  raise(x)\nend\n", "ruby") == {("go", "call", "f")}


def test_declarators():
    """A function's own qualified name is no type; events and initialisers are neither types nor calls."""
    assert kinds("void A::V::h() { k(); }\nA::V::~V() {}\nint A::g() {}\n", "cpp") == {"A::V.h": ("method", "public"), "A::V.~V": ("method", "public"), "A.g": ("method", "public")}
    assert refs("void A::V::h() { k(); }\nB A::V::g() {}\n", "cpp") == {("k", "call", "A::V.h"), ("B", "type_annotation", "A::V.g")}
    source = "class C { event Handler Ev; event Other Two { add { On(1); } remove { } } public C() : base() { Go(); } public C(int a) : this() {} void T() {} }"
    assert refs(source, "csharp") == {("Go", "call", "C.C"), ("On", "call", "C")}
    assert set(kinds(source, "csharp")) == {"C", "C.C", "C.T"}


def test_ruby_endless_methods():
    source = "class A\n  def f = g(1)\n  def h(x)\n    k(x)\n  end\n  def q() = r(2)\n  def z=(v)\n    w(v)\n  end\n  def s = (t(3))\nend\nlast = 1\n"
    got = {s.name: (s.start, s.end) for s in run.parse(source, "ruby").symbols}
    assert got == {"A": (1, 11), "A.f": (2, 2), "A.h": (3, 5), "A.q": (6, 6), "A.z=": (7, 9), "A.s": (10, 10), "last": (12, 12)}
    assert refs(source, "ruby") == {("g", "call", "A.f"), ("k", "call", "A.h"), ("r", "call", "A.q"), ("w", "call", "A.z="), ("t", "call", "A.s")}


def test_relations_are_typed_columns_of_one_pass(spark):
    rows = [("p", "a.py", b"class A:\n    \"\"\"Says several words here.\"\"\"\n    def f(self):\n        g(1)\n"), (None, "b.cfg", b"x = 1"), ("p", "c.rb", b""), ("q", "d.go", None), ("q", "e.rs", b"\xef\xbb\xbffn k() { m(); }\n\xff")]
    made = run.extract(spark.createDataFrame(rows, "project string, path string, content binary"))
    ix = run.relations(made)
    assert "from_json" not in ix.symbols._jdf.queryExecution().toString()
    assert sorted((r.project, r.path, r.lang, r.lines) for r in ix.files.collect()) == [("", "b.cfg", None, 1), ("p", "a.py", "python", 4), ("p", "c.rb", "ruby", 0), ("q", "d.go", "go", 0), ("q", "e.rs", "rust", 2)]
    assert sorted((r.file, r.name, r.kind, r.line_start, r.line_end, r.parent) for r in ix.symbols.collect()) == [("a.py", "A", "class", 1, 4, None), ("a.py", "A.f", "method", 3, 4, "A"), ("e.rs", "k", "function", 1, 1, None)]
    assert [(r.file, r.kind, r.text, r.parent) for r in ix.texts.collect()] == [("a.py", "docstring", "Says several words here.", "A")]
    assert sorted((r.file, r.name, r.caller) for r in ix.refs.collect()) == [("a.py", "g", "A.f"), ("e.rs", "m", "k")]
    assert run.relations(made.limit(0)).refs.count() == 0
