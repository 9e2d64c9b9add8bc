from __future__ import annotations

import datetime as dt

from marlstone.sources import code as C


def names(text, language):
    return [(s.name, s.kind, s.parent) for s in C.symbols(text, language)]


def test_rust():
    text = 'use a::b::c;\nuse d::*;\npub struct Foo { x: u32 }\nimpl Foo { pub fn new(x: u32) -> Self { bar(x); y.baz() } }\nimpl<T> Bar<T> { fn q(&self) {} }\nenum E { A }\ntrait T { fn sig(&self); }\nmod m;\nfn free() { Foo::new(1); println!("f("); }\n'
    assert names(text, "rust") == [("Foo", "struct", None), ("Foo", "struct", None), ("new", "function", "Foo"), ("q", "function", "Bar<T>"), ("E", "struct", None), ("T", "interface", None), ("m", "function", None), ("free", "function", None)]
    got = C.relations(text, "rust")
    assert {(k, n) for k, n, _ in got} >= {("calls", "bar"), ("calls", "baz"), ("calls", "new"), ("imports", "a::b::c"), ("imports", "d::*")}


def test_python():
    text = "import os.path\nfrom a.b import c\nclass A(B, x.C):\n    def m(self):\n        return y.z(w(1))\n\n\ndef f():\n    pass\n"
    assert names(text, "python") == [("A", "class", None), ("m", "function", "A"), ("f", "function", None)]
    assert {(k, n) for k, n, _ in C.relations(text, "python")} == {("calls", "z"), ("calls", "w"), ("imports", "os.path"), ("imports", "a.b"), ("inherits", "B")}
    assert names("class A:\n    def m(self):\n        x = (\n\ndef g(:\n    pass\n", "python") == [("A", "class", None), ("m", "function", "A"), ("g", "function", None)]


def test_go():
    text = 'package m\nimport (\n "fmt"\n x "a/b"\n)\ntype S struct { a int }\ntype (\n X interface { Y() }\n)\nfunc (s *S) M() { len(x); foo.Bar() }\nfunc F() {}\n'
    assert names(text, "go") == [("S", "struct", None), ("X", "interface", None), ("M", "method", None), ("F", "function", None)]
    assert {(k, n) for k, n, _ in C.relations(text, "go")} == {("calls", "Bar"), ("imports", "fmt"), ("imports", "a/b")}


def test_scripts():
    text = "import {x} from './q';\nclass A extends B implements C, D {\n  m(x) { if (x) { y(); } }\n  async n(): void {}\n}\nexport function f() { return '}' }\nconst g = (a) => { return new A(a) };\nconst h = async x => x + 1;\ninterface I { x(): void }\n"
    assert names(text, "typescript") == [("A", "class", None), ("m", "method", "A"), ("n", "method", "A"), ("f", "function", None), ("g", "function", None), ("h", "function", None), ("I", "interface", None)]
    assert {(k, n) for k, n, _ in C.relations(text, "typescript")} >= {("calls", "y"), ("imports", "./q"), ("inherits", "B"), ("inherits", "C"), ("inherits", "D")}
    assert ("I", "interface", None) not in names(text, "javascript")


def test_rows(spark):
    files = spark.createDataFrame([("a/x.py", dt.datetime(2024, 1, 1), "def f():\n    return g(1)\n"), ("a/b.md", None, "# x"), ("a/n.rs", None, None), ("a/e.go", None, "")], "filename string, modified_at timestamp, text string")
    rows = C.symbol_rows(files)
    got = rows.collect()
    assert [(r["filename"], r["symbol_name"], r["start_line"], r["end_line"], r["signature"]) for r in got] == [("a/x.py", "f", 1, 2, "def f()")]
    assert [(r["relation_type"], r["target_name"]) for r in C.relation_rows(rows).collect()] == [("calls", "g")]


def test_walk(spark, tmp_path):
    from marlstone.sources import walk

    for name in ("a.md", "sub/b.py", "node_modules/c.js", ".hidden/d.md", ".h.md", "e.xyz", "skip/f.md", "G.MD"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    (tmp_path / ".gitignore").write_text("skip/\n# no\n!a.md\n")
    got = {r["filename"].removeprefix(f"{tmp_path}/") for r in walk.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.md", "sub/b.py", ".hidden/d.md", ".h.md"}
    assert {p.removeprefix(f"{tmp_path}/") for p in walk.expand([f"{tmp_path}/**/*.md", str(tmp_path)])} == {"a.md", ".h.md", "skip/f.md", "sub/b.py", "node_modules/c.js"}
    assert walk.base_directory("/a/b*/c") == "/a" and walk.base_directory("*.md") == "." and walk.base_directory("/a/b/**/x") == "/a/b"
