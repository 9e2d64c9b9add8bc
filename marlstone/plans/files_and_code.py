"""Named queries for readers, code symbols, relations and the store, over files made from whole tables, each with its SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import frontmatter
from marlstone.operators.store import Store
from marlstone.session import scratch, table
from marlstone.sources import code, formats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A file of each language; ``{n}`` is the customer's key. A method's own text, read alone, begins like a call of it.
SOURCES = {
    "py": "import os\n\nclass Box_{n}(Base):\n    def put_{n}(self, x):\n        return helper_{n}(x)\n\ndef run_{n}(y):\n    import json_{n}\n    return os.path.join(y)\n",
    "rs": "struct Box{n} {{\n    x: u32,\n}}\n\nimpl Box{n} {{\n    fn put_{n}(&self) {{\n        helper_{n}(1);\n    }}\n}}\n\nfn run_{n}() {{\n    use a::b_{n};\n    inner_{n}();\n}}\n",
    "go": 'package m\n\nimport "fmt"\n\ntype Box{n} struct {{\n\tx int\n}}\n\nfunc (b *Box{n}) Put{n}() {{\n\tlen(1)\n\thelper{n}(1)\n}}\n\nfunc Run{n}() {{\n\tfmt.Println(1)\n}}\n',
    "js": "class Box{n} extends Base{n} {{\n  put{n}(x) {{\n    return helper{n}(x);\n  }}\n}}\n\nfunction run{n}() {{\n  return inner{n}();\n}}\n",
    "ts": "interface Shape{n} {{\n  side: number;\n}}\n\nclass Box{n} extends Base{n} implements Shape{n} {{\n  put{n}(x) {{\n    return helper{n}(x);\n  }}\n}}\n\nconst run{n} = (a: number) => {{\n  return inner{n}(a);\n}};\n",
    "md": "# Box {n}\n\ndef run_{n}(y):\n",
}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A file of each language for each customer."""
    kinds = spark.createDataFrame([(k, v.replace("{n}", "\x01").replace("{{", "{").replace("}}", "}")) for k, v in SOURCES.items()], "ending string, body string")
    n = F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer").select("c_custkey").distinct().join(F.broadcast(kinds))  # six rows
    return rows.select(F.concat(F.lit("src/"), n, F.lit("."), "ending").alias("filename"), F.lit(None).cast("timestamp").alias("modified_at"), F.replace("body", F.lit("\x01"), n).alias("text"))


@query("""
WITH want(ending, language, position, name, kind, a, b, parent, signature) AS (VALUES
  ('py', 'python', 0, 'Box_#', 'class', 3, 5, NULL, 'class Box_#(Base)'), ('py', 'python', 1, 'put_#', 'function', 4, 5, 'Box_#', 'def put_#(self, x)'), ('py', 'python', 2, 'run_#', 'function', 7, 9, NULL, 'def run_#(y)'),
  ('rs', 'rust', 0, 'Box#', 'struct', 1, 3, NULL, 'struct Box#'), ('rs', 'rust', 1, 'Box#', 'struct', 5, 9, NULL, 'impl Box#'), ('rs', 'rust', 2, 'put_#', 'function', 6, 8, 'Box#', 'fn put_#(&self)'),
  ('rs', 'rust', 3, 'run_#', 'function', 11, 14, NULL, 'fn run_#()'),
  ('go', 'go', 0, 'Box#', 'struct', 5, 7, NULL, 'type Box# struct'), ('go', 'go', 1, 'Put#', 'method', 9, 12, NULL, 'func (b *Box#) Put#()'), ('go', 'go', 2, 'Run#', 'function', 14, 16, NULL, 'func Run#()'),
  ('js', 'javascript', 0, 'Box#', 'class', 1, 5, NULL, 'class Box# extends Base#'), ('js', 'javascript', 1, 'put#', 'method', 2, 4, 'Box#', 'put#(x)'), ('js', 'javascript', 2, 'run#', 'function', 7, 9, NULL, 'function run#()'),
  ('ts', 'typescript', 0, 'Shape#', 'interface', 1, 3, NULL, 'interface Shape#'), ('ts', 'typescript', 1, 'Box#', 'class', 5, 9, NULL, 'class Box# extends Base# implements Shape#'),
  ('ts', 'typescript', 2, 'put#', 'method', 6, 8, 'Box#', 'put#(x)'), ('ts', 'typescript', 3, 'run#', 'function', 11, 13, NULL, 'const run# = (a: number) =>')),
c AS (SELECT DISTINCT c_custkey::VARCHAR AS n FROM customer)
SELECT 'src/' || n || '.' || ending AS filename, CAST(position AS INTEGER) AS position, replace(name, '#', n) AS symbol_name, kind AS symbol_type, language, CAST(a AS INTEGER) AS start_line,
       CAST(b AS INTEGER) AS end_line, replace(parent, '#', n) AS parent_symbol, replace(signature, '#', n) AS signature FROM want, c""")
def symbols_by_language(spark: SparkSession, d: str) -> DataFrame:
    return code.symbol_rows(_sources(spark, d)).drop("content", "modified_at")


@query("""
WITH want(ending, position, kind, name) AS (VALUES
  ('py', 0, 'inherits', 'Base'), ('py', 0, 'calls', 'helper_#'), ('py', 1, 'calls', 'helper_#'), ('py', 2, 'calls', 'join'), ('py', 2, 'imports', 'json_#'),
  ('rs', 1, 'calls', 'helper_#'), ('rs', 2, 'calls', 'helper_#'), ('rs', 3, 'calls', 'inner_#'), ('rs', 3, 'imports', 'a::b_#'),
  ('go', 1, 'calls', 'helper#'), ('go', 2, 'calls', 'Println'),
  ('js', 0, 'inherits', 'Base#'), ('js', 0, 'calls', 'helper#'), ('js', 1, 'calls', 'helper#'), ('js', 1, 'calls', 'put#'), ('js', 2, 'calls', 'inner#'),
  ('ts', 1, 'inherits', 'Base#'), ('ts', 1, 'inherits', 'Shape#'), ('ts', 1, 'calls', 'helper#'), ('ts', 2, 'calls', 'helper#'), ('ts', 2, 'calls', 'put#'), ('ts', 3, 'calls', 'inner#')),
c AS (SELECT DISTINCT c_custkey::VARCHAR AS n FROM customer)
SELECT 'src/' || n || '.' || ending AS filename, CAST(position AS INTEGER) AS position, kind AS relation_type, replace(name, '#', n) AS target_name, NULL::VARCHAR AS target_file, 1.0::DOUBLE AS confidence FROM want, c""")
def relations_by_language(spark: SparkSession, d: str) -> DataFrame:
    return code.relation_rows(code.symbol_rows(_sources(spark, d)))


_TEXTS = {
    "txt": "{s}\r\nline two \n", "log": "{s} started", "md": "# {s}\n\ntext\n", "json": '{{"name": "{s}", "at": {{"keys": [{n}, {{"x": true}}]}}, "none": null}}',
    "yaml": "name: {s}\nat:\n  key: {n}\n  on: [a, {{y: no}}]\n", "toml": 'name = "{s}"\n[at]\nkey = {n}\n', "csv": 'a,b\n"{s}, x",{n}\n',
    "html": "<html><body><h1>{s}</h1><p>One <b>two</b> &amp; three</p><script>var a = 1;</script></body></html>", "xyz": "{s}",
}
_WORD, _SHEET = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, text in members.items():
            file.writestr(name, text)
    return out.getvalue()


def _made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A file of each kind for each supplier."""
    for rows in parts:
        out = []
        for n, s in zip(rows["s_suppkey"], rows["s_name"], strict=True):
            out += [(f"in/{n}.{k}", v.format(n=n, s=s).encode()) for k, v in _TEXTS.items()]
            out.append((f"in/{n}.docx", _zipped({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body><w:p><w:r><w:t>{s}</w:t></w:r></w:p><w:p><w:r><w:t>number {n}</w:t></w:r></w:p></w:body></w:document>'})))
            out.append((f"in/{n}.xlsx", _zipped({
                "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_REL}"><sheets><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
                "xl/worksheets/s.xml": f'<worksheet xmlns="{_SHEET}"><sheetData><row><c r="A1" t="inlineStr"><is><t>{s}</t></is></c><c r="C1"><v>{n}.0</v></c></row></sheetData></worksheet>',
            })))
            out.append((f"in/{n}.toml.json", b"{broken"))
        yield pd.DataFrame(out, columns=["filename", "content"])


@query(r"""
WITH s AS (SELECT DISTINCT s_suppkey::VARCHAR AS n, s_name AS s FROM supplier), nl AS (SELECT chr(10) AS l, chr(10) || chr(10) AS p, chr(9) AS t),
f AS (
  SELECT n || '.txt' AS f, s || chr(13) || l || 'line two' AS x FROM s, nl UNION ALL SELECT n || '.log', s || ' started' FROM s UNION ALL SELECT n || '.md', '# ' || s || p || 'text' FROM s, nl
  UNION ALL SELECT n || '.json', 'at.keys[1].x: true' || p || 'name: ' || s FROM s, nl
  UNION ALL SELECT n || '.yaml', 'name: ' || s || p || 'at.key: ' || n || p || 'at.on[1].y: no' FROM s, nl
  UNION ALL SELECT n || '.toml', 'at.key: ' || n || p || 'name: ' || s FROM s, nl UNION ALL SELECT n || '.csv', 'a' || t || 'b' || l || s || ', x' || t || n FROM s, nl
  UNION ALL SELECT n || '.html', s || p || 'One two & three' FROM s, nl UNION ALL SELECT n || '.docx', s || p || 'number ' || n FROM s, nl
  UNION ALL SELECT n || '.xlsx', '[Sheet: A]' || l || s || t || t || n FROM s, nl UNION ALL SELECT n || '.xyz', NULL FROM s UNION ALL SELECT n || '.toml.json', NULL FROM s)
SELECT 'in/' || f AS filename, x AS text, x IS NULL AS failed FROM f""")
def readers_by_kind(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "supplier").select("s_suppkey", "s_name").distinct().mapInPandas(_made, "filename string, content binary")
    return formats.texts(made.withColumn("modified_at", F.lit(None).cast("timestamp"))).select("filename", "text", F.col("error").isNotNull().alias("failed"))


_UNDER = "D:/kb/harbor-core"


@query(f"""
WITH docs AS (SELECT DISTINCT doc_id, filename FROM documents WHERE NOT (filename ILIKE '{_UNDER}/%' OR filename = '{_UNDER}')),
c AS (SELECT DISTINCT id, document_id, position, content FROM chunks WHERE document_id IN (SELECT doc_id FROM docs)),
m AS (SELECT DISTINCT id FROM code_metadata WHERE chunk_id IN (SELECT id FROM c)), r AS (SELECT DISTINCT id FROM code_relations WHERE source_chunk_id IN (SELECT id FROM c))
SELECT 'documents' AS tbl, count(*) AS n FROM docs UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'code_metadata', count(*) FROM m UNION ALL SELECT 'code_relations', count(*) FROM r""")
def store_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """All documents with chunks, metadata and relations put into a store, then a directory deleted: rows that are left."""
    s = Store(spark, scratch(spark, "store"))
    docs = table(spark, d, "documents").select("doc_id", "filename", "modified_at", "indexed_at").dropDuplicates(["doc_id"])
    place = table(spark, d, "chunks").dropDuplicates(["id"]).join(docs.select(F.col("doc_id").alias("document_id"), "filename"), "document_id")
    at = place.select(F.col("id").alias("chunk_id"), "filename", "position")
    meta = table(spark, d, "code_metadata").dropDuplicates(["id"]).join(at, "chunk_id")
    edges = table(spark, d, "code_relations").dropDuplicates(["id"]).join(at.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id")
    s.replace_files(docs.drop("doc_id"), place.withColumn("embedding", F.lit(None).cast("array<float>")), meta, edges)
    s.delete_below(_UNDER)
    counts = [s.table(t).agg(F.lit(t).alias("tbl"), F.count("*").alias("n")) for t in ("documents", "chunks", "code_metadata", "code_relations")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(r"""
SELECT doc_id, CASE WHEN text LIKE '---' || chr(10) || '%' OR text LIKE '---' || chr(13) || chr(10) || '%' THEN NULL
  ELSE md5('---' || chr(10) || 'domain: ' || source || chr(10) || 'docType: note' || chr(10) || 'tags: [a, b]' || chr(10) || '---' || chr(10) || chr(10) || text) END AS digest
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def frontmatter_add(spark: SparkSession, d: str) -> DataFrame:
    meta = F.struct(F.col("source").alias("domain"), F.lit("note").alias("docType"), F.lit("").alias("language"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.lit("").alias("project"))
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & F.col("source").isNotNull()).select("doc_id", "text", meta.alias("m"))
    return docs.select("doc_id", F.md5(F.encode(frontmatter.added(F.col("text"), F.col("m")), "UTF-8")).alias("digest"))
