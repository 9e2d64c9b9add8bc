from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import code_text, dictionary, frontmatter
from marlstone.functions import text as T
from marlstone.functions import vectors as V


def test_chunks_hold_all_and_stay_short():
    text = "\n\n".join(f"Paragraph {i} says something. " * (i % 5 + 1) for i in range(60)) + "x" * 2000
    parts = T.chunked(text, 200)
    assert all(len(p) <= 201 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n。é", max_size=400), st.integers(3, 60))
def test_chunks_lose_nothing(text, size):
    parts = T.chunked(text, size)
    assert all(p and p == p.strip(T.WHITE) for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_chunk_cases():
    assert T.chunked("  short ", 500) == ["short"]
    assert T.chunked(" \n ", 500) == [] and T.chunked("", 500) == []
    assert T.chunked("aaaa. bbbb. cccc", 6) == ["aaaa.", "bbbb.", "cccc"]
    assert len(T.chunked("a" * 5 + "。" + "b" * 5, 5)[0]) == 6  # one more than the size


def test_globs(spark):
    rows = spark.createDataFrame([("docs/a.md",), ("docs\\b.MD",), ("docsx/a.md",), ("x/docs/a_1.rs",)], "n string")
    n = F.col("n")
    got = rows.select("n", T.in_directory(n, "docs/").alias("d"), T.matches_glob(n, "*.md").alias("g"), T.matches_glob(n, "a_?.rs").alias("u")).collect()
    assert [(r.d, r.g, r.u) for r in got] == [(True, True, False), (True, True, False), (False, True, False), (False, False, True)]


def test_language(spark):
    cases = {"": "unknown", "12 !": "unknown", "Hello there": "en", "这是中文文本": "zh", "これはテストです": "ja", "이것은 시험": "ko", "Größe über allés ñandú": "mixed", None: None}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, w string")
    assert all(r[0] == r[1] for r in rows.select(T.detect_language(F.col("t")), "w").collect())


def test_identifiers(spark):
    rows = spark.createDataFrame([("camelCase",), ("PascalCase",), ("snake_case_x",), ("HTTPServer",), ("_a__b",)], "s string")
    got = [r[0] for r in rows.select(F.array_join(T.split_identifier(F.col("s")), ",")).collect()]
    assert got == ["camel,case", "pascal,case", "snake,case,x", "h,t,t,p,server", "a,b"]


def test_frontmatter_round(spark):
    meta = frontmatter.of({"domain": "a b", "tags": ["x", "y: z"], "project": ""})
    text = "Body\nline\nend"
    row = spark.createDataFrame([(text,)], "t string").select(frontmatter.added(F.col("t"), meta).alias("t")).select("t", frontmatter.parsed(F.col("t")).alias("m"), frontmatter.body(F.col("t")).alias("b")).first()
    assert row["t"] == '---\ndomain: a b\ntags: [x, "y: z"]\n---\n\nBody\nline\nend'
    assert row["m"]["domain"] == "a b" and row["m"]["docType"] == "" and row["b"].lstrip("\n") == text
    again = spark.createDataFrame([(row["t"],)], "t string").select(frontmatter.added(F.col("t"), meta)).first()[0]
    assert again is None


def test_signatures(spark):
    cases = [
        ("rust", "pub fn f(\n a: u8) -> u8 {\n x }", "pub fn f( a: u8) -> u8"), ("go", "type X int", "type X int"), ("python", "def f(a,\n  b):\n  pass", "def f(a, b)"),
        ("python", "class A:\n  x", "class A"), ("javascript", "const f = (a) => {\n}", "const f = (a) =>"), ("typescript", "function f() { return () => 1 }", "function f() { return () =>"),
    ]
    rows = spark.createDataFrame(cases, "l string, c string, w string")
    assert all(r[0] == r[1] for r in rows.select(code_text.signature(F.col("c"), F.col("l")), "w").collect())


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], 1), ([0.0, 2.0], 2), ([-1.0, 0.0], 3), ([0.0, 0.0], 4), ([1.0], 5), (None, 6)], "v array<float>, i int")
    got = {r["i"]: r["s"] for r in rows.select("i", V.similarity(V.cosine_distance(F.col("v"), V.query_vector([1, 0]))).alias("s")).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0, 4: None, 5: None, 6: None}
    h = rows.select(V.hash_embedding(F.lit("x"), 16).alias("a"), V.hash_embedding(F.lit("y"), 16).alias("b")).first()
    assert h.a != h.b and abs(sum(x * x for x in h.a) - 1) < 1e-5


def test_dictionary(spark):
    docs = spark.createDataFrame([(1, "符号表 (SymbolTable) 缓存[Cache] 测试（Test）"), (2, None), (3, "")], "d bigint, t string")
    got = {(r.source_word, r.target_word, r.confidence) for r in dictionary.mined(docs, "d", "t").collect()}
    assert got == {("符号表", "symboltable", 1.0), ("符号表", "symbol", 0.8), ("符号表", "table", 0.8), ("缓存", "cache", 0.9), ("测试", "test", 1.0), ("测试", "test", 0.8)}
    known = spark.createDataFrame([("a", "b", "zh", 0.5, "old"), ("c", "d", "zh", 0.9, "old")], "source_word string, target_word string, source_lang string, confidence double, source_document string")
    new = spark.createDataFrame([("a", "b", "zh", 0.4, "new")], known.schema)
    assert {tuple(r) for r in dictionary.merged(known, new).collect()} == {("a", "b", "zh", 0.5, "new"), ("c", "d", "zh", 0.9, "old")}
    lines = spark.createDataFrame([("f", 1, "// 本地表"), ("f", 2, "let localTable = 1")], "document string, line_no int, line string")
    symbols = spark.createDataFrame([("f", "localTable")], "document string, symbol string")
    assert {(r.source_word, r.target_word) for r in dictionary.mined_from_comments(lines, symbols).collect()} == {("本地表", "local"), ("本地表", "table")}
