"""Symbols and relations of source files.

Python is read by its own parser. For the others strings and comments are
blanked out, place for place, and declarations are found in what is left, with
their ends by matching brackets. Broken files give what can be found.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = {
    "rs": "rust", "go": "go", "py": "python", **dict.fromkeys("js mjs cjs jsx".split(), "javascript"), **dict.fromkeys("ts mts cts tsx".split(), "typescript"),
}


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    parent: str | None = None


_BLANK = {
    "go": re.compile(r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\[^']*|[^'\\\n])'"),
    "rust": re.compile(r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|b?r(#*)\"(?s:.*?)\"\1|\"(?:\\(?s:.)|[^\"\\])*\"|'(?:\\[^']*|[^'\\\n])'"),
    "script": re.compile(r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|\"(?:\\(?s:.)|[^\"\\\n])*\"|'(?:\\(?s:.)|[^'\\\n])*'|`(?:\\(?s:.)|[^`\\])*`"),
}


def blanked(code: str, language: str) -> str:
    """The same length, with spaces for what strings and comments hold."""
    def spaces(m: re.Match[str]) -> str:
        t = m[0]
        keep = t[0] in "\"'`" and len(t) > 1
        inner = re.sub(r"[^\n]", " ", t[1:-1] if keep else t)
        return f"{t[0]}{inner}{t[-1]}" if keep else inner

    return _BLANK.get(language, _BLANK["script"]).sub(spaces, code)


def _matching(code: str, at: int) -> int:
    """One past the bracket that closes the one at ``at``; the end where none does."""
    close = {"{": "}", "(": ")", "[": "]"}[code[at]]
    depth = 0
    for m in re.finditer(rf"[{re.escape(code[at])}{re.escape(close)}]", code[at:]):
        depth += 1 if m[0] == code[at] else -1
        if not depth:
            return at + m.end()
    return len(code)


def _block(code: str, at: int) -> tuple[int, int] | None:
    """Start and end of the braces that follow; None where a semicolon comes first."""
    depth = 0
    for m in re.finditer(r"[{;()\[\]]", code[at:]):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif depth <= 0:
            return None if m[0] == ";" else (at + m.start(), _matching(code, at + m.start()))
    return None


def _line_end(code: str, at: int) -> int:
    end = code.find("\n", at)
    return len(code) if end < 0 else end


def _go(code: str) -> Iterator[Symbol]:
    for m in re.finditer(r"(?m)^func\s+(?:(\([^)]*\))\s*)?([A-Za-z_]\w*)", code):
        block = _block(code, m.end())
        end = block[1] if block else _line_end(code, m.end())
        yield Symbol(m[2], "method" if m[1] else "function", m.start(), end)
    for m in re.finditer(r"(?m)^type\s+(\(\s*)?", code):
        whole = _matching(code, code.index("(", m.start())) if m[1] else None
        for t in re.finditer(r"([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{", code[m.end() : whole or _line_end(code, m.end())]):
            end = whole or _matching(code, m.end() + t.end() - 1)
            yield Symbol(t[1], t[2], m.start(), end)


_RUST_HEAD = r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?"


def _rust(code: str) -> Iterator[Symbol]:
    for m in re.finditer(rf"{_RUST_HEAD}\bfn\s+([A-Za-z_]\w*)", code):
        if block := _block(code, m.end()):
            yield Symbol(m[1], "function", m.start(), block[1])
    for m in re.finditer(r"(?:unsafe\s+)?\bimpl\b\s*(?:<[^{]*?>\s*)?(?:!?[\w:]+(?:<[^{]*?>)?\s+for\s+)?([A-Za-z_]\w*)\s*(?=\{|where\b)", code):
        if block := _block(code, m.end()):
            yield Symbol(m[1], "struct", m.start(), block[1])
    for m in re.finditer(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:unsafe\s+)?\b(struct|enum|trait|mod)\s+([A-Za-z_]\w*)", code):
        block = _block(code, m.end())
        end = block[1] if block else code.find(";", m.end()) + 1 or len(code)
        yield Symbol(m[2], {"trait": "interface", "mod": "function"}.get(m[1], "struct"), m.start(), end)


#: Words before a parenthesis that are no names.
_KEYWORDS = frozenset("if for while switch catch function return typeof new await super import with match fn loop func go defer select range else case in of do type var const import".split())


def _script(code: str, typed: bool) -> Iterator[Symbol]:
    name = r"([A-Za-z_$][\w$]*)"
    for m in re.finditer(rf"(?<![\w$.])(?:async\s+)?function\s+{name}", code):
        if block := _block(code, m.end()):
            yield Symbol(m[1], "function", m.start(), block[1])
    for m in re.finditer(rf"(?<![\w$.])(?:const|let)\s+{name}\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:<[^>]*>\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\s*:[^=;{{]+)?|{name})\s*=>\s*", code):
        if m.end() < len(code) and code[m.end()] in "{([":
            end = _matching(code, m.end())
        else:
            stop = re.search(r";|\n", code[m.end() :])
            end = m.end() + (stop.start() if stop else len(code) - m.end())
        yield Symbol(m[1], "function", m.start(), end + (code[end : end + 1] == ";"))
    for m in re.finditer(rf"(?<![\w$.])(?:abstract\s+)?class\s+{name}", code):
        if block := _block(code, m.end()):
            yield Symbol(m[1], "class", m.start(), block[1])
            yield from _methods(code, *block)
    if typed:
        for m in re.finditer(rf"(?<![\w$.])interface\s+{name}", code):
            if block := _block(code, m.end()):
                yield Symbol(m[1], "interface", m.start(), block[1])


def _methods(code: str, start: int, end: int) -> Iterator[Symbol]:
    at = start + 1
    head = re.compile(r"((?:(?:public|private|protected|static|override|readonly|abstract|async|get|set)\s+|\*\s*)*)([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>\s*)?\(|[{(\[]")
    while m := head.search(code, at, end - 1):
        if m[2] is None or m[2] in _KEYWORDS:
            at = _matching(code, m.end() - 1)
            continue
        close = _matching(code, m.end() - 1)
        body = re.compile(r"\s*(?::[^;{=]+)?\{").match(code, close)
        if body:
            stop = _matching(code, body.end() - 1)
            yield Symbol(m[2], "method", m.start(), stop)
            at = stop
        else:
            at = close


def _python(code: str) -> Iterator[Symbol]:
    starts = [0]
    for line in code.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    raw = code.split("\n")
    place = lambda line, col: starts[line - 1] + len(raw[line - 1].encode()[:col].decode(errors="ignore"))

    def walk(node: ast.AST, parent: str | None) -> Iterator[Symbol]:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                cls = isinstance(c, ast.ClassDef)
                yield Symbol(c.name, "class" if cls else "function", place(c.lineno, c.col_offset), place(c.end_lineno, c.end_col_offset), parent)
                yield from walk(c, c.name if cls else parent)
            else:
                yield from walk(c, parent)

    try:
        yield from walk(ast.parse(code), None)
        return
    except (SyntaxError, ValueError, RecursionError):
        pass
    # broken: by indentation
    scopes: list[tuple[int, str]] = []
    for m in re.finditer(r"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", code):
        depth = len(m[1].expandtabs(8))
        scopes = [s for s in scopes if s[0] < depth]
        rest = re.compile(rf"(?m)^(?![ \t]{{{len(m[1]) + 1},}}|[ \t]*$|[ \t]*[)\]}}])").search(code, code.find("\n", m.end()) + 1 or len(code))
        end = len(code[: rest.start() if rest else len(code)].rstrip())
        yield Symbol(m[3], "class" if m[2] == "class" else "function", m.start() + len(m[1]), end, scopes[-1][1] if scopes else None)
        if m[2] == "class":
            scopes.append((depth, m[3]))


def symbols(code: str, language: str) -> list[Symbol]:
    """Symbols in order of place, each place and kind once; parents are the nearest class-like ones around."""
    if language == "python":
        found = list(_python(code))
    else:
        blank = blanked(code, language if language in _BLANK else "script")
        found = list({"go": _go, "rust": _rust}.get(language, lambda c: _script(c, language == "typescript"))(blank))
        around = [(s.start, s.end, s.name) for s in found if s.kind in ("class", "struct", "interface")] if language != "go" else []
        if language == "rust":  # methods of generic types know their type too
            around += [
                (m.start(), b[1], m[1].strip()) for m in re.finditer(r"\bimpl\b\s*(?:<[^{]*?>\s*)?(?:[\w:]+(?:<[^{]*?>)?\s+for\s+)?([A-Za-z_]\w*\s*<[^{]*>)\s*(?=\{|where\b)", blank)
                if (b := _block(blank, m.end()))
            ]
            around = [a for a in around if not re.match(r"(?:pub(?:\([^)]*\))?\s+)?enum\b|(?:pub(?:\([^)]*\))?\s+)?mod\b", blank[a[0] : a[0] + 60])]
        found = [
            Symbol(s.name, s.kind, s.start, s.end, min(((b - a, n) for a, b, n in around if a < s.start and s.end <= b), default=(0, None))[1]) for s in found
        ]
    out: dict[tuple[int, int, str], Symbol] = {}
    for s in sorted(found, key=lambda s: s.start):
        out.setdefault((s.start, s.end, s.kind), s)
    return list(out.values())


#: Go's own functions and words that look like calls.
GO_BUILTINS = frozenset("len make append delete print println panic recover range return break continue".split())


def relations(code: str, language: str) -> list[tuple[str, str, int]]:
    """``(relation_type, target_name, line)``: calls, imports and inherits, each name and type once."""
    found: list[tuple[str, str, int]] = []
    if language == "python":
        found = list(_python_relations(code))
    else:
        blank = blanked(code, language if language in _BLANK else "script")
        ends = [m.start() for m in re.finditer("\n", code)]
        line = lambda at: bisect.bisect_left(ends, at) + 1
        declared = re.compile(r"(?:\b(?:fn|func|function|class|interface)\s+|\bfunc\s*\([^)]*\)\s*)$")
        methods = {s.start + len(m[0]) for s in symbols(code, language) if s.kind == "method" and (m := re.match(r"(?:[a-z*]+\s+)*", blank[s.start : s.end]))}
        contracts = [(m.end(), _matching(blank, m.end() - 1)) for m in re.finditer(r"\binterface\s*\{", blank)] if language == "go" else []
        for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*(?:::\s*<[^()]*?>\s*)?\(", blank):
            if m[1] in (_KEYWORDS - {"new", "catch", "of"} if language in ("rust", "go") else _KEYWORDS) or m.start() in methods or declared.search(blank, 0, m.start()):
                continue
            if not (language == "go" and (m[1] in GO_BUILTINS or any(a <= m.start() < b for a, b in contracts))):
                found.append(("calls", m[1], line(m.start())))
        if language == "go":
            for m in re.finditer(r'(?m)^import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?("[^"\n]*"))', blank):
                block = code[m.start() : m.end()]
                found += [("imports", s[1], line(m.start() + s.start())) for s in re.finditer(r'"([^"\n]+)"', block)]
        elif language == "rust":
            for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+(?:::\*)?)\s*;", blank):
                found.append(("imports", m[1], line(m.start(1))))
        else:
            for m in re.finditer(r"(?m)(?<![\w$.])import\b[^;'\"()]*?(['\"])", blank):
                stop = code.find(m[1], m.end())
                if stop > m.end():
                    found.append(("imports", code[m.end() : stop], line(m.end())))
            for m in re.finditer(r"(?<![\w$.])class\s+[A-Za-z_$][\w$]*(?:<[^{]*?>)?\s*([^{]*)\{", blank):
                if e := re.search(r"\bextends\s+([A-Za-z_$][\w$]*)(?![\w$.(])", m[1]):
                    found.append(("inherits", e[1], line(m.start(1))))
                if language == "typescript" and (i := re.search(r"\bimplements\s+(.*)", m[1], re.S)):
                    found += [("inherits", x, line(m.start(1))) for x in re.findall(r"(?:^|,)\s*([A-Za-z_$][\w$]*)\s*(?=,|$)", i[1].strip())]
    out: dict[tuple[str, str], int] = {}
    for kind, name, at in found:
        clean = name.strip().strip("\"'")
        if clean:
            out.setdefault((kind, clean), at)
    order = {"calls": 0, "imports": 1, "inherits": 2}
    return sorted(((k, n, at) for (k, n), at in out.items()), key=lambda r: order[r[0]])


def _python_relations(code: str) -> Iterator[tuple[str, str, int]]:
    import textwrap

    try:
        tree = ast.parse(textwrap.dedent(code))
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                yield "calls", node.func.id, node.lineno
            elif isinstance(node.func, ast.Attribute):
                yield "calls", node.func.attr, node.lineno
        elif isinstance(node, ast.Import):
            for a in node.names:
                if not a.asname:
                    yield "imports", a.name, node.lineno
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            yield "imports", node.module, node.lineno
        elif isinstance(node, ast.ClassDef):
            for b in node.bases:
                if isinstance(b, ast.Name):
                    yield "inherits", b.id, node.lineno


SYMBOLS = "filename string, modified_at timestamp, position int, symbol_name string, symbol_type string, language string, start_line int, end_line int, parent_symbol string, content string"
RELATIONS = "filename string, position int, relation_type string, target_name string, target_file string, confidence double"


def _batched(df: DataFrame, schema: str, rows) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [r for x in b.to_pylist() for r in rows(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def symbol_rows(files: DataFrame) -> DataFrame:
    """A row a symbol of files with filename, modified_at, text; signatures are added by functions.code_text."""
    from marlstone.functions.code_text import signature

    def rows(x: dict) -> Iterator[tuple]:
        language = LANGUAGES.get(x["filename"].rpartition(".")[2])
        if language is None or x["text"] is None:
            return
        ends = [m.start() for m in re.finditer("\n", x["text"])]
        for n, s in enumerate(symbols(x["text"], language)):
            a, b = bisect.bisect_left(ends, s.start) + 1, bisect.bisect_left(ends, max(s.start, s.end - 1)) + 1
            yield x["filename"], x["modified_at"], n, s.name, s.kind, language, a, b, s.parent, x["text"][s.start : s.end]

    made = _batched(files.select("filename", "modified_at", "text"), SYMBOLS, rows)
    return made.withColumn("signature", signature(F.col("content"), F.col("language")))


def relation_rows(symbols_: DataFrame) -> DataFrame:
    """Relations of each symbol's own text, with the symbol as their source."""

    def rows(x: dict) -> Iterator[tuple]:
        for kind, name, _ in relations(x["content"] or "", x["language"]):
            yield x["filename"], x["position"], kind, name, None, 1.0

    return _batched(symbols_.select("filename", "position", "language", "content"), RELATIONS, rows)
