from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from marlstone.llm import comments, files, handwritten, markup, quality

MARKUP = [
    ("<p>One</p>", {"html"}), ("a &amp; b", {"html"}), ("x <!-- note --> y", {"html"}), ("<DIV CLASS=\"a\">x</DIV>", {"html"}), ("<br>", {"html"}),
    ("# Title\ntext", {"markdown"}), ("Title\n-----\ntext", {"markdown"}), ("Title\n===\n", {"markdown"}), ("a **b** c", {"markdown"}), ("use `x`", {"markdown"}), ("> said", {"markdown"}),
    ("| a | b |\n|---|:-:|\n| 1 | 2 |", {"markdown"}), ("- [x] done", {"markdown"}), ("* * *", {"markdown"}), ("[a](b.md)", {"markdown"}), ("see[^1]", {"markdown"}), ("[a][b]\n[b]: c", {"markdown"}),
    ("__版本__ x", {"markdown"}), ("~~~rust\nx\n~~~", {"markdown"}), ("![a](b.png)", {"markdown"}),
    ("[[A|b]]", {"wiki"}), ("'''b'''", {"wiki"}), ("''i''", {"wiki"}), ("== H ==", {"wiki"}), ("{| class=\"w\"\n|-\n| a || b\n|}", {"wiki"}), ("{{note|x}}", {"wiki"}),
    ("\\section{A}", {"latex"}), ("$x^2$", {"latex"}), ("\\[ a \\]", {"latex"}), ("\\begin{x}\n\\item a\n\\end{x}", {"latex"}), ("a~\\cite{b}", {"latex"}),
    ("It costs $17 to $93 per run", set()), ("Press [Enter] twice, layer[2]", set()), ("D:\\alias\\policy is fine", set()), ("5 * 4 * 2", set()), ("a < b and c > d", set()), ("R&D", set()),
    ("- a\n- b\n1. c", set()), ("x == y holds", set()), ("Use {buffer} here", set()), ("a | b | c", set()), ("ticket #4458", set()), ("snake_case_name _x", set()), ("it's d'un", set()), ("", set()),
    ("写し\\emph{がまだ}用意", {"latex"}), ("查询$x^2$数", {"latex"}), ("可以**手动**修改", {"markdown"}), ("可以__手动__修改", {"markdown"}), ("点击[链接](a.md)后", {"markdown"}), ("a__b__c", set()),
    ("**a** [[b]]\n<p>", {"markdown", "wiki", "html"}),
]


@pytest.mark.parametrize("text,kinds", MARKUP)
def test_kinds(text, kinds):
    assert {k for *_, k in markup.spans(text)} == kinds


def test_plain_keeps_structure():
    text = "<h2>Head</h2><p>One &amp; two</p><ul><li>a</li><li>b</li></ul><pre><code>x = 1 &lt; 2\n</code></pre><script>var a;</script>"
    assert markup.plain(text) == "# Head\n\nOne & two\n\n- a\n- b\n\n```\nx = 1 < 2\n```"
    assert markup.plain("Title\n---\nSee **this** [link](x.md)[^1] and $x^2$.\n```py\na_b*c*\n```") == "# Title\nSee this link and $x^2$.\n```\na_b*c*\n```"
    assert markup.plain("== H ==\n'''b''' [[A|c]] {{x}}") == "# H\nb c"
    assert markup.plain("\\section{A} \\emph{b}~\\cite{c} \\begin{itemize}\n\\item d\n\\end{itemize}").split() == ["#", "A", "b", "-", "d"]


def test_best_run_is_the_greatest():
    import itertools

    for scores in itertools.product((-2.0, -1.0, 1.0), repeat=6):
        a, b = markup.best_run(scores)
        best = max([0.0, *[sum(scores[i:j]) for i in range(6) for j in range(i + 1, 7)]])
        assert sum(scores[a:b]) == best


def test_content_leaves_navigation_out():
    text = '<div><a href="/a">x</a><a href="/b">y</a></div><p>The reader keeps its place when the file is opened again.</p><div><a href="/c">z</a></div>'
    a, b = markup.content(text, markup.WEIGHTS)
    assert "reader keeps" in text[a:b] and "href" not in text[a:b]


def test_cleaned_rows(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>"), (2, None), (3, ""), (4, "plain"), (4, "plain"), (5, "word " * 100_000 + "**x**")], "id bigint, t string").withColumn("markup", F.lit(1)).withColumn("text", F.lit(2))
    got = {r["id"]: r for r in markup.cleaned(rows, "id", "t").collect()}
    assert got[1]["markup"] == ["html"] and got[1]["clean"] == "a"
    assert got[2]["markup"] == [] and got[2]["clean"] is None and got[3]["clean"] == "" and got[4]["clean"] == "plain" and got[5]["markup"] == ["markdown"]
    assert markup.cleaned(rows.limit(0), "id", "t").count() == 0


SENTENCES = [
    ("we keep the lease here because the pool often refreshes it", "en"), ("gibt den Block zurück oder nichts, wenn der Bereich fehlt", "de"), ("renvoie le jeton ou rien du tout si le signal est vide", "fr"),
    ("aquí se guarda el permiso porque el orden lo copia después", "es"), ("не вызывать, пока общий поток ещё не был объединён", "ru"), ("이 목록은 최대 925개의 노드을 한 번에 바꿉니다.", "ko"),
    ("这里必须先刷新批次，否则空的符号会出错", "zh"), ("一度に最大で256件の検索を保存します", "ja"),
    ("select quota from clock where plan = ?", None), ("insert into clock (rule) values (?, rule)", None), ("/timer/index/:cursor", None), ("^a[a-z]+_b\\d{c}$", None), ("%s:%d cell.key.path", None),
    ("let data = Query { a: 1, b: base.c };", None), ("edge: 70, shard: 74", None), ("TODO(branch-67)", None), ("SPDX-License-Identifier: Apache-2.0", None), ("局所符号桶 (LocalTokenBucket)", None), ("the shard", None),
    ("// Code generated by {}. DO NOT EDIT.", "en"), ("if left is None and right in plan:", None),
]


@pytest.mark.parametrize("text,lang", SENTENCES)
def test_languages(text, lang):
    assert comments.languages(text) == ((lang,) if lang else ())


def test_spans():
    code = "x = 'it\\'s'  # one\n# two\n\"\"\"doc\nstring\"\"\"\nr'raw\\n'\ns = '\\u4e2d\\u6587'"
    assert [(k, t.strip()) for k, t, _ in comments.spans(code, "py")] == [("string", "it's"), ("comment", "one\ntwo"), ("string", "doc\nstring"), ("string", "raw\\n"), ("string", "中文")]
    rust = "let a = 'x'; fn f<'a>() {} // c\n/* b\n * d */ let s = r#\"q \"z\" \"#; \"\\u{4e2d}\""
    assert [t.strip() for _, t, _ in comments.spans(rust, "rs")] == ["c", "b\nd", 'q "z"', "中"]
    assert [t for _, t, _ in comments.spans("const u = 'http://x'; `a ${b}`", "js")] == ["http://x", "a ${b}"]
    assert [k for k, *_ in comments.spans("ends here */ x = 1", "go")] == ["comment"]


def test_hidden_language_rows(spark):
    said = "# we keep the lease here because the pool often refreshes it\n"
    rows = [(1, 1, said + "x = 1", "py"), (2, 1, said + said, "py"), (2, 1, said + said, "py"), (3, 2, None, "py"), (4, 2, "", "py"), (5, 3, "// 这里必须先刷新批次，否则空的符号会出错\n" * 50_000, "go"), (None, 3, said, "py")]
    df = spark.createDataFrame(rows, "id bigint, doc bigint, t string, ending string").withColumn("lang", F.lit("clash")).withColumn("h1", F.lit(1))
    held = comments.hidden_language(df, "id", "doc", "t", "ending")
    assert {(r["id"], r["lang"]) for r in held.collect()} == {(1, "en"), (2, "en"), (5, "zh")}
    share = {(r["file"], r["lang"]): r["share"] for r in comments.shares(held, df, "id", "doc", "t").collect()}
    assert 0.9 < share[(1, "en")] <= 1 and 0.9 < share[(3, "zh")] <= 1
    assert comments.hidden_language(df.limit(0), "id", "doc", "t", "ending").count() == 0


def exact_beliefs(tree: dict[str, list[str]], potentials: dict[str, list[float]], root: str) -> dict[str, list[float]]:
    """Beliefs of a small tree by trying every assignment: what the passes must equal."""
    nodes = [root, *[c for v in tree.values() for c in v]]
    parent = {c: p for p, v in tree.items() for c in v}
    out = {n: [0.0] * len(handwritten.LABELS) for n in nodes}
    for xs in itertools.product(range(len(handwritten.LABELS)), repeat=len(nodes)):
        at = dict(zip(nodes, xs, strict=True))
        w = handwritten.PRIOR[at[root]] * math.exp(sum(potentials[n][at[n]] for n in nodes))
        for c, p in parent.items():
            w *= handwritten.FIT[at[p]][at[c]]
        for n in nodes:
            out[n][at[n]] += w
    return {n: [x / sum(v) for x in v] for n, v in out.items()}


def test_beliefs_are_exact(spark):
    gen, plain, vend = "# @generated by x 1.0\ny = 1\n", "x = 1\n", "# Vendored from a 1.0\nz = 1\n"
    paths = {1: "r/a/f.py", 2: "r/a/g.py", 3: "r/vendor/h.py", 4: "r/b.py"}
    body = {1: gen, 2: plain, 3: plain, 4: vend}
    docs = spark.createDataFrame([(i, p) for i, p in paths.items()], "doc_id bigint, filename string")
    chunks = spark.createDataFrame([(i, i, 0, t) for i, t in body.items()], "id bigint, document_id bigint, position int, content string")
    evidence = handwritten.file_evidence(handwritten.chunk_evidence(chunks, "id", "document_id", "position", "content"))
    got = {r["file"]: (r["label"], r["p_handwritten"]) for r in handwritten.labels(docs, "doc_id", "filename", evidence).collect()}
    P, S = handwritten.PLAIN, handwritten.SURE
    pot = {"r": [0] * 5, "a": [0] * 5, "v": [0, 0, 0, 2 * S, 0], "1": [P, S, 0, 0, 0], "2": [P, 0, 0, 0, 0], "3": [P, 0, 0, 0, 0], "4": [P, 0, 0, S, 0]}
    want = exact_beliefs({"r": ["a", "v", "4"], "a": ["1", "2"], "v": ["3"]}, pot, "r")
    for i, (label, p) in got.items():
        assert abs(p - want[str(i)][0]) < 1e-6
        assert label == handwritten.LABELS[max(range(5), key=lambda k: want[str(i)][k])]
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["generated", "handwritten", "vendored", "vendored"]


def test_file_labels_by_evidence(spark):
    cases = {
        "p/src/a.min.js": ("!function(e,t){" + "a.b=c=>c.d(1);" * 60 + "}", "minified"), "p/src/words.go": ("var X = []int{" + "17, 2931, 77, " * 200 + "}", "blob"),
        "p/src/q_pb2.py": ("import x\n", "generated"), "p/src/minify.ts": ("function minify(x: string) {\n  return x;\n}\n", "handwritten"), "p/vendor_portal/x.rs": ("fn a() {}\n", "handwritten"),
        "p/src/tpl.go": ('const tpl = "// Code generated by {}. DO NOT EDIT."\nfunc f() {}\n', "handwritten"), "p/src/w.py": ("# Writes the generated files; nobody should edit those by hand.\nx = 1\n", "handwritten"),
        "p/x/node_modules/l/src/i.js": ("export const a = 1;\n", "vendored"), "p/src/z.rs": ("fn a() {}\n\n// 本文件由 x 自动生成，请勿手动修改。", "generated"), "p/src/empty.py": (None, "handwritten"), "p/src/none.py": ("", "handwritten"),
    }
    docs = [(i, p) for i, p in enumerate(cases)] + [(0, "p/src/a.min.js"), (99, None)]
    chunks = [(i, i, 0, t) for i, (t, _) in enumerate(cases.values())] + [(0, 0, 0, cases["p/src/a.min.js"][0])]
    d = spark.createDataFrame(docs, "doc_id bigint, filename string").withColumn("path", F.lit("clash")).withColumn("file", F.lit("clash"))
    c = spark.createDataFrame(chunks, "id bigint, document_id bigint, position int, content string")
    evidence = handwritten.file_evidence(handwritten.chunk_evidence(c, "id", "document_id", "position", "content"))
    got = {r["file"]: r["label"] for r in handwritten.labels(d, "doc_id", "filename", evidence).collect()}
    assert got == {**{i: label for i, (_, label) in enumerate(cases.values())}, 99: "handwritten"}
    assert handwritten.labels(d.limit(0), "doc_id", "filename", evidence).count() == 0


def test_marks_in_whole_comment_blocks(spark):
    licence = "".join(f"// line {i} of the licence\n" for i in range(12))
    mark, code = "// Code generated by x. DO NOT EDIT.", "func f() {\n  a()\n}\n"
    cases = [
        ([licence + mark + "\n" + code], "generated"), ([licence, mark + "\n" + code, code], "generated"), ([code, code + "\n" + mark + "\n" + licence], "generated"), ([code, mark, licence], "generated"),
        (["/*\nCopyright of x\n" + "no warranty\n" * 9 + "Code generated by x. DO NOT EDIT.\n*/\n" + code], "generated"), (["/*\nCopyright\n" + "no warranty\n" * 9, "Vendored from x 1.0\n*/\n" + code], "vendored"),
        ([code + mark + "\n" + code], "handwritten"), ([licence + code, mark + "\n" + code], "handwritten"), ([code, "x = 1\n" + mark + "\n" + code, code], "handwritten"),
        (["/* open */ int a;\n" + mark + "\n" + code], "handwritten"),
    ]
    docs = spark.createDataFrame([(i, f"p{i}/a.go") for i in range(len(cases))], "doc_id bigint, filename string")
    rows = [(100 * i + k, i, k, t) for i, (parts, _) in enumerate(cases) for k, t in enumerate(parts)]
    chunks = spark.createDataFrame(rows[::-1], "id bigint, document_id bigint, position int, content string")
    evidence = handwritten.file_evidence(handwritten.chunk_evidence(chunks, "id", "document_id", "position", "content"))
    got = {r["file"]: r["label"] for r in handwritten.labels(docs, "doc_id", "filename", evidence).collect()}
    assert got == {i: label for i, (_, label) in enumerate(cases)}


def test_quality(spark):
    prose = "If the reader was closed, then the next page must be opened, and nobody has to look for it.\n" * 6
    bare = prose.lower().replace(",", "").replace(".", "")
    lists = "".join(f"- stone river lamp_{i}\n" for i in range(30))
    table = "".join(f"key_{i}\t{i * 37}\t{i / 7:.2f}\tyes\n" for i in range(30))
    junk = "Qb7xTf0aZk3LmPq9Rw2sVd8uYhJ4nCe6GiKo1XtB5rDvEyNzWjHgAlSfUpMkOcIx+/q7\n" * 8
    cases = {1: (prose, False), 2: (bare, False), 3: (lists, True), 4: (table, True), 5: (junk, True), 6: (prose + lists[:60], False), 7: ("<p>" + prose + "</p>", False), 8: ("如果页面已经不存在，那么下一个页面就会打开。" * 9, False)}
    rows = [(100 * k + i, t) for k, (t, _) in cases.items() for i in range(12)] + [(1, None), (2, ""), (3, "<br>"), (100, prose), (None, prose)]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("kind", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = {r["id"] for r in quality.not_prose(quality.judged(df, "id", "t")).collect()}
    assert got == {100 * k + i for k, (_, bad) in cases.items() if bad for i in range(12)} | {3}
    assert quality.judged(df.limit(0), "id", "t").count() == 0


def test_mixture_steps_raise_the_likelihood():
    import numpy as np

    x = np.concatenate([np.random.default_rng(1).normal(m, 0.3, (200, 2)) for m in (0, 3)])
    mix = quality.Mixture(np.zeros(2), np.ones(2), np.array([[1.0, 1.0], [2.0, 2.0]]))
    for _ in range(20):
        p = mix.responsibilities(x)
        mix.step(p.sum(0), p.T @ x, p.T @ x**2)
    assert np.allclose(sorted(mix.means[:, 0]), [0, 3], atol=0.1) and np.allclose(mix.weights, 0.5, atol=0.02)


def test_chunks_of_files(spark):
    docs = spark.createDataFrame([(1, "a/x.PY"), (2, "b.md"), (3, None), (1, "a/x.PY")], "doc_id bigint, filename string")
    chunks = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None)], "id bigint, document_id bigint")
    assert [r["id"] for r in files.chunks_of(chunks, docs, files.SOURCE).collect()] == [1]
    assert [r["id"] for r in files.chunks_of(chunks, docs, files.TEXT, "filename").collect()] == [2]


WHOLE = [
    "<h1>Limits</h1>\nA shard holds many rows.", "A shard holds many rows.\n<h2>Limits</h2>", "<ul>\n<li>path</li>\n<li>file</li>\n</ul>", "<pre><code>a = 1\nb = a</code></pre>\nThen it stops.",
    "<p>There are four cases.</p>\n" + "".join(f"<tr><td>key</td><td>{i}</td></tr>\n" for i in range(9)), "<table><tr><td>a</td><td>b</td></tr></table>", "\\section{Limits} A shard holds rows.",
    "\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", "\\begin{equation}\na = b\n\\end{equation}\nIt holds.", "```\nx\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "== Limits ==\nText here.", "<a href=\"/w\">The</a> writer stops.", "It stops at the <a href=\"/w\">writer</a>",
    "one</li>\n<li>two</li>\n</ul>\n<p>Next</p>", "# Limits\n- one\n- two\n$x^2$", "Words here.\n<h3><a href=\"/x\">Limits</a></h3>",
]


@pytest.mark.parametrize("text", WHOLE)
def test_content_keeps_structure_at_its_ends(text):
    a, b = markup.content(text, markup.WEIGHTS)
    assert markup.plain(text[a:b]) == markup.plain(text)


@pytest.mark.parametrize("page", markup.LABELLED[:3])
def test_content_ends_where_the_label_does(page):
    a, b = markup.content(page.replace("«", "").replace("»", ""), markup.WEIGHTS)
    assert (a, b) == (page.index("«"), page.index("»") - 1)


def test_cleaned_keeps_structure(spark):
    rows = spark.createDataFrame(list(enumerate(WHOLE)), "id bigint, t string")
    assert {r["id"]: r["clean"] for r in markup.cleaned(rows, "id", "t").collect()} == {i: markup.plain(t) for i, t in enumerate(WHOLE)}
