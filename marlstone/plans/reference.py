"""Named queries for the engine's own operators, over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import code_text, dictionary, frontmatter
from marlstone.functions import text as T
from marlstone.functions import vectors as V
from marlstone.operators import embedding, graph, search, store, sync
from marlstone.session import table
from marlstone.sources import code, formats, walk
from marlstone.streaming.watch import debounced

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- vector search

def _first_vector(spark: SparkSession, d: str) -> list[float]:
    """The stored vector that serves as the query: the first usable one by id."""
    v = table(spark, d, "vec_chunks").where((F.size("embedding") == DIM) & F.exists("embedding", lambda x: x != 0))
    return v.orderBy("chunk_id").first()["embedding"]


_VEC = f"""
WITH v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM vec_chunks
           WHERE len(embedding) = {DIM} AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
q AS (SELECT e AS qe FROM v ORDER BY chunk_id LIMIT 1),
c AS (SELECT DISTINCT id, document_id, position, content FROM chunks),
m AS (SELECT chunk_id, min(id) AS mid FROM code_metadata GROUP BY chunk_id),
meta AS (SELECT DISTINCT code_metadata.* FROM code_metadata JOIN m ON code_metadata.id = m.mid),
r AS (SELECT v.chunk_id AS id, d.filename AS document_name, c.content, c.position, round(1 - list_cosine_similarity(e, qe), 9) AS distance
      FROM v, q, c, documents d WHERE c.id = v.chunk_id AND d.doc_id = c.document_id),
top AS (SELECT * FROM r WHERE (%s) ORDER BY distance, document_name, position LIMIT 10)
SELECT top.id, document_name, content, position, round(1 - distance / 2, 6) AS similarity, symbol_name, symbol_type, language, start_line, end_line,
       parent_symbol, signature FROM top LEFT JOIN meta ON meta.chunk_id = top.id
"""


def _near(spark: SparkSession, d: str, **filters: str) -> DataFrame:
    return search.vector_search(
        table(spark, d, "vec_chunks"), table(spark, d, "chunks"), table(spark, d, "documents"), table(spark, d, "code_metadata"), _first_vector(spark, d), 10, **filters
    )


@query(_VEC % "true")
def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


@query(_VEC % "document_name ILIKE 'D:/kb/harbor-core/%'")
def vec_topk_dir(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, directory="D:/kb/harbor-core/")


@query(_VEC % "document_name ILIKE '%/%.py' OR document_name ILIKE '%.py'")
def vec_topk_glob(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, file_pattern="*.py")


@query(_VEC % "document_name ILIKE 'D:/kb/%' AND (document_name ILIKE '%/%.md' OR document_name ILIKE '%.md')")
def vec_topk_both(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, directory="D:/kb", file_pattern="*.md")


@query(f"""
WITH v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM vec_chunks
           WHERE len(embedding) = {DIM} AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
q AS (SELECT e AS qe FROM v ORDER BY chunk_id LIMIT 1)
SELECT chunk_id, round(1 - (1 - list_cosine_similarity(e, qe)) / 2, 6) AS similarity FROM v, q""")
def vec_similarity_all(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vec_chunks").where(F.size("embedding") == DIM).distinct()
    distance = V.cosine_distance(F.col("embedding"), V.query_vector(_first_vector(spark, d)))
    return v.select("chunk_id", F.round(V.similarity(distance), 6).alias("similarity")).where(F.col("similarity").isNotNull())


@query(f"""
WITH v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM vec_chunks
           WHERE len(embedding) = {DIM} AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
q AS (SELECT DISTINCT chunk_id AS query_id, e AS qe FROM v JOIN knn_probes USING (chunk_id)),
s AS (SELECT query_id, chunk_id AS id, round(1 - list_cosine_similarity(e, qe), 9) AS distance FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s)
SELECT query_id, id, round(1 - distance / 2, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def vec_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vec_chunks").where(F.size("embedding") == DIM)
    asked = v.join(table(spark, d, "knn_probes").distinct(), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), "embedding")
    return search.batch_search(v, asked, 5)


@query("SELECT DISTINCT id, replace(substring(content, 1, 120), chr(10), ' ') AS preview FROM chunks")
def vec_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").distinct().select("id", T.preview(F.col("content")).alias("preview"))


_SYM = """
WITH c AS (SELECT DISTINCT id, document_id, position, content FROM chunks),
hit AS (SELECT DISTINCT * FROM code_metadata WHERE lower(symbol_name) LIKE '%commit%' OR lower(symbol_name) LIKE '%batch%'),
m AS (SELECT chunk_id, min(id) AS mid FROM hit GROUP BY chunk_id),
sym AS (SELECT c.id, d.filename AS document_name, content, position, 1.0::DOUBLE AS similarity, symbol_name, symbol_type, language, start_line, end_line, parent_symbol, signature
        FROM hit JOIN m ON hit.id = m.mid JOIN c ON c.id = hit.chunk_id JOIN documents d ON d.doc_id = c.document_id
        ORDER BY document_name, position LIMIT 10)
"""


@query(_SYM + "SELECT * FROM sym")
def symbol_keyword(spark: SparkSession, d: str) -> DataFrame:
    return search.symbol_search(table(spark, d, "code_metadata"), table(spark, d, "chunks"), table(spark, d, "documents"), "Commit in BATCH", 10)


@query("""SELECT w, strlen(w) >= 3 AS passes FROM (SELECT unnest(['ab', 'abc', '词', 'é', 'éa', 'x']) AS w)""")
def symbol_keyword_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(w,) for w in ("ab", "abc", "词", "é", "éa", "x")], "w string")
    return rows.select("w", (F.octet_length("w") >= 3).alias("passes"))


_HEAD, _TAIL = (_VEC % "true").strip().rsplit("SELECT top.id", 1)


@query(
    _HEAD.rstrip() + ", near AS (SELECT top.id" + _TAIL + "), "
    + _SYM.strip().removeprefix("WITH c AS (SELECT DISTINCT id, document_id, position, content FROM chunks),").replace("m AS (SELECT chunk_id", "m2 AS (SELECT chunk_id").replace("JOIN m ON hit.id = m.mid", "JOIN m2 ON hit.id = m2.mid")
    + """, a AS (SELECT 0 AS src, document_name, position, similarity, row_number() OVER (ORDER BY similarity DESC, document_name, position) AS rank FROM near
         UNION ALL SELECT 1, document_name, position, similarity, row_number() OVER (ORDER BY similarity DESC, document_name, position) FROM sym),
       b AS (SELECT *, row_number() OVER (PARTITION BY document_name, position ORDER BY src, rank) AS n FROM a)
    SELECT document_name, position, printf('%.4f', similarity) AS similarity, CAST(src AS INTEGER) AS src, CAST(rank AS INTEGER) AS rank FROM b WHERE n = 1"""
)
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    both = search.merged(_near(spark, d), symbol_keyword(spark, d))
    return both.select("document_name", "position", F.format_string("%.4f", F.col("similarity")).alias("similarity"), "src", "rank")


# -- chunking

_WHITE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_CHUNKS = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
small AS (SELECT doc_id, trim(text, {_WHITE}) AS content FROM docs WHERE length(text) <= 500),
para AS (SELECT doc_id, generate_subscripts(p, 1) AS n, unnest(p) AS t FROM (
           SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, {_WHITE})), lambda x: x <> '') AS p
           FROM docs WHERE length(text) > 500)),
cut(doc_id, n, k, piece, rest) AS (
  SELECT doc_id, n, 0, NULL::VARCHAR, t FROM para WHERE length(t) > 500
  UNION ALL
  SELECT doc_id, n, k + 1, trim(left(rest, c), {_WHITE}), trim(substring(rest, c + 1), {_WHITE}) FROM (
    SELECT *, coalesce(list_max(list_filter(range(250, 501), lambda i: contains('.!?。' || chr(10), substring(rest, i + 1, 1)) AND i < length(rest))) + 1, 500) AS c
    FROM cut WHERE length(rest) > 500)),
unit AS (
  SELECT doc_id, n, 0 AS k, t, false AS alone FROM para WHERE length(t) <= 500
  UNION ALL SELECT doc_id, n, k, piece, true FROM cut WHERE piece <> ''
  UNION ALL SELECT doc_id, n, k + 1, rest, true FROM cut WHERE length(rest) <= 500 AND rest <> ''),
num AS (SELECT doc_id, t, alone, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS u FROM unit),
pack(doc_id, u, t, alone, held, chunk) AS (
  SELECT doc_id, u, t, alone, CASE WHEN alone THEN 0 ELSE length(t) END, 0 FROM num WHERE u = 1
  UNION ALL
  SELECT num.doc_id, num.u, num.t, num.alone,
    CASE WHEN num.alone THEN 0 WHEN held > 0 AND held + length(num.t) + 2 <= 500 THEN held + length(num.t) + 2 ELSE length(num.t) END,
    CASE WHEN NOT num.alone AND held > 0 AND held + length(num.t) + 2 <= 500 THEN chunk ELSE chunk + 1 END
  FROM pack JOIN num ON num.doc_id = pack.doc_id AND num.u = pack.u + 1),
chunked AS (
  SELECT doc_id, 0 AS position, content FROM small WHERE content <> ''
  UNION ALL SELECT doc_id, chunk, string_agg(t, chr(10) || chr(10) ORDER BY u) FROM pack GROUP BY doc_id, chunk)
"""


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("position", "content"))


@query(_CHUNKS + "SELECT doc_id, CAST(position AS INTEGER) AS position, md5(content) AS digest FROM chunked")
def chunk_positions(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).select("doc_id", "position", F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query(_CHUNKS + "SELECT doc_id, count(*) AS n_chunks, CAST(max(length(content)) AS INTEGER) AS longest, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM chunked GROUP BY doc_id")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("content")
    return _chunked(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(n).alias("longest"), F.sum(n).alias("n_chars"))


@query("""SELECT document_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY position)) AS digest FROM (SELECT DISTINCT id, document_id, position, content FROM chunks) GROUP BY document_id""")
def chunk_packed(spark: SparkSession, d: str) -> DataFrame:
    """Texts put together again from stored chunks."""
    own = table(spark, d, "chunks").distinct().groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["content"]), "\n\n")
    return own.select("document_id", F.md5(F.encode(joined, "UTF-8")).alias("digest"))


# -- scalar text functions

@query("SELECT DISTINCT id, CAST(ceil(strlen(content) / 3.0) AS INTEGER) AS tokens FROM chunks")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").distinct().select("id", T.estimated_tokens(F.col("content")).alias("tokens"))


@query("""
WITH RECURSIVE c AS (SELECT document_id, CAST(ceil(strlen(content) / 3.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY document_id ORDER BY position) AS k
                     FROM (SELECT DISTINCT id, document_id, position, content FROM chunks)),
b(document_id, k, n, total, batch) AS (
  SELECT document_id, k, 1, cost, 0 FROM c WHERE k = 1
  UNION ALL
  SELECT c.document_id, c.k, CASE WHEN n = 8 OR total + cost > 800 THEN 1 ELSE n + 1 END, CASE WHEN n = 8 OR total + cost > 800 THEN cost ELSE total + cost END,
         CASE WHEN n = 8 OR total + cost > 800 THEN batch + 1 ELSE batch END
  FROM b JOIN c ON c.document_id = b.document_id AND c.k = b.k + 1)
SELECT document_id, CAST(batch AS INTEGER) AS batch, count(*) AS n_texts FROM b GROUP BY document_id, batch""")
def smart_batches(spark: SparkSession, d: str) -> DataFrame:
    cost = T.estimated_tokens(F.col("content")).cast("bigint")
    own = table(spark, d, "chunks").distinct().groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", cost.alias("cost")))).alias("c"))
    numbers = embedding.batch_number(F.transform("c", lambda x: x["cost"]), 8, 800)
    return own.select("document_id", F.explode(numbers).alias("batch")).groupBy("document_id", "batch").agg(F.count("*").alias("n_texts"))


_LANG = r"""
CASE WHEN total = 0 THEN 'unknown' WHEN kana > han AND kana > hangul AND (han + kana + hangul) / total > 0.1 THEN 'ja'
     WHEN hangul > 0 AND (han + kana + hangul) / total > 0.1 THEN 'ko' WHEN (han + kana + hangul) / total > 0.3 THEN 'zh'
     WHEN latin / total > 0.8 THEN 'en' ELSE 'mixed' END"""


@query(rf"""
WITH n AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{{L}}\p{{Nl}}]', '', 'g'))::DOUBLE AS total, length(regexp_replace(text, '[^\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}]', '', 'g')) AS han,
  length(regexp_replace(text, '[^\x{{3041}}-\x{{3096}}\x{{309d}}-\x{{309f}}\x{{30a1}}-\x{{30fa}}\x{{30fc}}-\x{{30ff}}]', '', 'g')) AS kana,
  length(regexp_replace(text, '[^\x{{ac00}}-\x{{d7a3}}]', '', 'g')) AS hangul, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM documents WHERE text IS NOT NULL)
SELECT doc_id, {_LANG} AS language FROM n""")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query(r"SELECT DISTINCT id, regexp_matches(content, '[\x{4e00}-\x{9fff}]') AS han FROM chunks")
def has_han(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").distinct().select("id", T.has_han(F.col("content")).alias("han"))


@query(r"""
SELECT DISTINCT symbol_name, array_to_string(list_transform(list_filter(CASE WHEN contains(symbol_name, '_') THEN string_split(symbol_name, '_')
  ELSE string_split(regexp_replace(symbol_name, '(\p{Lu})', ' \1', 'g'), ' ') END, lambda x: x <> ''), lambda x: lower(x)), ' ') AS parts
FROM code_metadata WHERE symbol_name IS NOT NULL""")
def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "code_metadata").where(F.col("symbol_name").isNotNull()).select("symbol_name").distinct()
    return names.select("symbol_name", F.array_join(T.split_identifier(F.col("symbol_name")), " ").alias("parts"))


# -- dictionary

_MINE = r"""
WITH c AS (SELECT DISTINCT id, document_id, content FROM chunks),
hits AS (
  SELECT document_id AS document, 0 AS kind, unnest(regexp_extract_all(content, '(\p{Han}+)\s*[（(]([a-zA-Z][a-zA-Z0-9_]*)[)）]', 1)) AS han,
         unnest(regexp_extract_all(content, '(\p{Han}+)\s*[（(]([a-zA-Z][a-zA-Z0-9_]*)[)）]', 2)) AS word FROM c
  UNION ALL
  SELECT document_id, 1, unnest(regexp_extract_all(content, '(\p{Han}+)\s*\[([a-zA-Z][a-zA-Z0-9_]*)\]', 1)),
         unnest(regexp_extract_all(content, '(\p{Han}+)\s*\[([a-zA-Z][a-zA-Z0-9_]*)\]', 2)) FROM c),
h AS (SELECT document, han, word, min(kind) AS kind FROM hits GROUP BY ALL),
p AS (
  SELECT document, han AS source_word, word AS spelling, lower(word) AS target_word, CASE kind WHEN 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM h
  UNION ALL
  SELECT document, source_word, spelling, spelling, 0.8::DOUBLE FROM (
    SELECT document, han AS source_word, word, unnest(list_distinct(list_transform(list_filter(CASE WHEN contains(word, '_') THEN string_split(word, '_')
      ELSE string_split(regexp_replace(word, '(\p{Lu})', ' \1', 'g'), ' ') END, lambda x: x <> ''), lambda x: lower(x)))) AS spelling FROM h WHERE kind = 0)
  WHERE spelling <> word),
mined AS (SELECT document, source_word, any_value(target_word) AS target_word, max(confidence) AS confidence FROM p GROUP BY document, source_word, spelling)
"""


def _mined(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.mined(table(spark, d, "chunks").distinct(), "document_id", "content")


@query(_MINE + "SELECT * FROM mined")
def dict_mine(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d)


@query(r"""
WITH l AS (SELECT doc_id AS document, generate_subscripts(s, 1) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS s FROM documents WHERE text IS NOT NULL)),
b AS (SELECT document, line, lag(line) OVER (PARTITION BY document ORDER BY line_no) AS before FROM l),
s AS (SELECT DISTINCT c.document_id AS document, m.symbol_name AS symbol FROM code_metadata m JOIN chunks c ON c.id = m.chunk_id WHERE m.symbol_name IS NOT NULL),
f AS (SELECT b.document, symbol, unnest(regexp_extract_all(before, '(?://|#)\s*(\p{Han}+)', 1)) AS source_word FROM b JOIN s ON s.document = b.document AND contains(b.line, s.symbol) WHERE before IS NOT NULL),
p AS (SELECT document, source_word, unnest(list_transform(list_filter(CASE WHEN contains(symbol, '_') THEN string_split(symbol, '_')
  ELSE string_split(regexp_replace(symbol, '(\p{Lu})', ' \1', 'g'), ' ') END, lambda x: x <> ''), lambda x: lower(x))) AS target_word FROM f WHERE length(source_word) > 1)
SELECT DISTINCT document, source_word, target_word, 0.6::DOUBLE AS confidence FROM p WHERE strlen(target_word) > 1""")
def dict_comment(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    place = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), F.col("document_id").alias("document")).distinct()
    symbols = table(spark, d, "code_metadata").where(F.col("symbol_name").isNotNull()).join(place, "chunk_id").select("document", F.col("symbol_name").alias("symbol")).distinct()
    return dictionary.mined_from_comments(lines, symbols)


@query(_MINE + """, known AS (SELECT DISTINCT source_word, target_word, source_lang, confidence, source_document, 0 AS seq FROM word_mapping WHERE source_lang IS NOT NULL),
neu AS (SELECT source_word, target_word, 'zh' AS source_lang, confidence, CAST(document AS VARCHAR) AS source_document, 1 AS seq FROM mined),
al AS (SELECT * FROM known UNION ALL SELECT * FROM neu)
SELECT source_word, target_word, source_lang, round(max(confidence), 6) AS confidence FROM al GROUP BY 1, 2, 3""")
def dict_merge(spark: SparkSession, d: str) -> DataFrame:
    new = _mined(spark, d).select("source_word", "target_word", F.lit("zh").alias("source_lang"), "confidence", F.col("document").cast("string").alias("source_document"))
    known = table(spark, d, "word_mapping").where(F.col("source_lang").isNotNull()).distinct()
    return dictionary.merged(known, new).select(*dictionary.KEY, F.round("confidence", 6).alias("confidence"))


@query("SELECT DISTINCT id, target_word, confidence FROM word_mapping WHERE source_word = '连接池' AND source_lang = 'zh'")
def dict_lookup(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.looked_up(table(spark, d, "word_mapping").distinct(), "连接池", "zh").select("id", "target_word", "confidence")


@query("SELECT count(DISTINCT id) AS n FROM word_mapping")
def dict_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "word_mapping").agg(F.count_distinct("id").alias("n"))


# -- frontmatter

_FM_VALUES = (
    ("plain", "No header here.\nSecond line.\nThird."), ("full", "---\ndomain: search\ndocType: guide\nlanguage: en\ntags: [a, b c, ]\nproject: one: two\n# note: x\n---\nBody\nMore"),
    ("open", "---\ndomain: x\nno end"), ("empty", "---\n---\n\n\nBody"), ("twice", "---\ndomain: a\ndomain: b\n---\nB"), ("crlf", "---\r\ndomain: w\r\n---\r\nBody\r\nend"),
)
_FM_SQL = """
WITH f(name, status, domain, docType, tags, project, body) AS (VALUES
  ('plain', 'none', NULL, NULL, NULL, NULL, 'No header here.' || chr(10) || 'Second line.' || chr(10) || 'Third.'),
  ('full', 'ok', 'search', 'guide', 'a|b c', 'one: two', 'Body' || chr(10) || 'More'), ('open', 'unclosed', NULL, NULL, NULL, NULL, '---' || chr(10) || 'domain: x' || chr(10) || 'no end'),
  ('empty', 'ok', '', '', '', '', chr(10) || chr(10) || 'Body'), ('twice', 'ok', 'b', '', '', '', 'B'), ('crlf', 'ok', 'w', '', '', '', 'Body' || chr(10) || 'end'))
SELECT * FROM f"""


def _fm(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_FM_VALUES), "name string, text string")


@query(_FM_SQL)
def frontmatter_parse(spark: SparkSession, d: str) -> DataFrame:
    p = _fm(spark).select("name", "text", frontmatter.parsed(F.col("text")).alias("m"))
    return p.select("name", frontmatter.status(F.col("text")).alias("status"), "m.domain", "m.docType", F.array_join("m.tags", "|").alias("tags"), "m.project", frontmatter.body(F.col("text")).alias("body"))


@query(r"""
SELECT doc_id, '---' || chr(10) || CASE WHEN source <> '' THEN 'domain: ' || source || chr(10) ELSE '' END || CASE WHEN lang IS NOT NULL AND lang <> '' THEN 'language: ' || lang || chr(10) ELSE '' END
  || 'tags: [' || CASE WHEN regexp_matches(filename, '[:#\[\]{}"'']') THEN '"' || replace(filename, '"', '\"') || '"' ELSE filename END || ', x]' || chr(10) || '---' || chr(10) AS header FROM documents""")
def frontmatter_generate(spark: SparkSession, d: str) -> DataFrame:
    meta = F.struct(F.col("source").alias("domain"), F.lit("").alias("docType"), F.coalesce("lang", F.lit("")).alias("language"), F.array("filename", F.lit("x")).alias("tags"), F.lit("").alias("project"))
    return table(spark, d, "documents").select("doc_id", meta.alias("m")).select("doc_id", frontmatter.generated(F.col("m")).alias("header"))


@query("""
WITH f(name, text) AS (VALUES
 ('plain', '---' || chr(10) || 'domain: new' || chr(10) || 'tags: [t]' || chr(10) || '---' || chr(10) || chr(10) || 'No header here.' || chr(10) || 'Second line.' || chr(10) || 'Third.'),
 ('full', '---' || chr(10) || 'domain: new' || chr(10) || 'docType: guide' || chr(10) || 'language: en' || chr(10) || 'tags: [t]' || chr(10) || 'project: "one: two"' || chr(10) || '---' || chr(10) || chr(10) || 'Body' || chr(10) || 'More'),
 ('open', NULL), ('empty', '---' || chr(10) || 'domain: new' || chr(10) || 'tags: [t]' || chr(10) || '---' || chr(10) || chr(10) || 'Body'),
 ('twice', '---' || chr(10) || 'domain: new' || chr(10) || 'tags: [t]' || chr(10) || '---' || chr(10) || chr(10) || 'B'),
 ('crlf', '---' || chr(10) || 'domain: new' || chr(10) || 'tags: [t]' || chr(10) || '---' || chr(10) || chr(10) || 'Body' || chr(10) || 'end'))
SELECT * FROM f""")
def frontmatter_update(spark: SparkSession, d: str) -> DataFrame:
    return _fm(spark).select("name", frontmatter.updated(F.col("text"), frontmatter.of({"domain": "new", "tags": ["t"]})).alias("text"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(filename || ', ,' || source, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM documents")
def tag_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(frontmatter.tag_list(F.concat("filename", F.lit(", ,"), "source")), "|").alias("tags"))


# -- sources

@query(r"""
SELECT doc_id, regexp_extract(filename, '\.([^./]+)$', 1) AS extension, CASE WHEN regexp_matches(filename, '\.md$') THEN 'markdown' WHEN regexp_matches(filename, '\.(rs|go|py|js|mjs|cjs|jsx|ts|mts|cts|tsx)$') THEN 'code'
  WHEN regexp_matches(filename, '\.(txt|json|yaml|yml|toml|csv|log|html|htm|pdf|docx|xls|xlsx|xlsb|ods)$') THEN 'text' END AS kind FROM documents""")
def route_extension(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("filename")
    return table(spark, d, "documents").select("doc_id", T.extension(name).alias("extension"), T.file_kind(name).alias("kind"))


@query(r"SELECT DISTINCT scan_id, regexp_replace(replace(filename, '\', '/'), '^/+\?/+', '') AS path FROM file_scan")
def normalize_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_scan").select("scan_id", T.normal_path(F.col("filename")).alias("path")).distinct()


@query("SELECT doc_id, regexp_matches(filename, '(^|/)(node_modules|target|\\.git)/') AS excluded FROM documents")
def exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", walk.excluded(F.col("filename")).alias("excluded"))


@query("SELECT filename, modified_at FROM documents")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("filename", "modified_at")


# -- store and sync

_SEEN = r"""
WITH s AS (SELECT regexp_replace(regexp_replace(replace(filename, '\', '/'), '^/+\?/+', ''), '/{2,}', '/', 'g') AS filename, change, modified_at, seen_at, scan_id FROM file_scan),
k AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY seen_at DESC NULLS LAST, scan_id DESC) AS n FROM s),
seen AS (SELECT filename, modified_at FROM k WHERE n = 1 AND change = 'present'),
act AS (SELECT coalesce(a.filename, b.filename) AS filename, CASE WHEN a.filename IS NULL THEN 'remove' WHEN b.filename IS NULL THEN 'add'
          WHEN date_trunc('second', a.modified_at) IS DISTINCT FROM date_trunc('second', b.modified_at) THEN 'update' ELSE 'skip' END AS action
        FROM seen a FULL JOIN documents b ON a.filename = b.filename WHERE a.filename IS NOT NULL OR b.filename LIKE 'D:/kb/%')
"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.changes import latest_sightings

    return sync.diff(latest_sightings(table(spark, d, "file_scan")), table(spark, d, "documents"), "D:/kb")


@query(_SEEN + "SELECT filename, action FROM act")
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


@query(_SEEN + """SELECT count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'remove') AS removed,
  count(*) FILTER (action = 'skip') AS skipped, 0::BIGINT AS failed, count(*) FILTER (action IN ('add', 'update')) AS indexed FROM act""")
def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return sync.counts(_diff(spark, d).withColumn("failed", F.lit(False)))


@query(_SEEN + "SELECT filename FROM documents WHERE NOT (filename LIKE 'D:/kb/%' AND filename NOT IN (SELECT filename FROM seen))")
def stale_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = _diff(spark, d).where(F.col("action") == "remove")
    return store.without(table(spark, d, "documents"), "filename", gone, "filename").select("filename")


@query("SELECT filename FROM documents WHERE NOT (filename ILIKE 'D:/kb/harbor-core/%' OR filename = 'D:/kb/harbor-core')")
def delete_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(~store.below(F.col("filename"), "D:\\kb\\harbor-core\\")).select("filename")


@query("""
WITH lost AS (SELECT id FROM chunks JOIN documents ON doc_id = document_id WHERE source = 'pier-api'),
rel AS (SELECT DISTINCT id, source_chunk_id, target_chunk_id FROM code_relations WHERE source_chunk_id NOT IN (SELECT id FROM lost))
SELECT 'chunks' AS tbl, count(*) AS n, count(DISTINCT id) AS n_targets FROM chunks WHERE id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'vec_chunks', count(*), count(DISTINCT chunk_id) FROM vec_chunks WHERE chunk_id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'code_metadata', count(*), count(DISTINCT chunk_id) FROM code_metadata WHERE chunk_id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'code_relations', count(*), count(DISTINCT target_chunk_id) FILTER (target_chunk_id NOT IN (SELECT id FROM lost)) FROM rel""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "documents").where(F.col("source") == "pier-api")
    left = store.cascaded(gone, table(spark, d, "chunks"), table(spark, d, "vec_chunks"), table(spark, d, "code_metadata"), table(spark, d, "code_relations").drop("created_at").distinct())
    of = {"chunks": "id", "vec_chunks": "chunk_id", "code_metadata": "chunk_id", "code_relations": "target_chunk_id"}
    parts = [left[t].agg(F.count("*").alias("n"), F.count_distinct(c).alias("n_targets")).select(F.lit(t).alias("tbl"), "n", "n_targets") for t, c in of.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(_SEEN + "SELECT filename, modified_at FROM documents WHERE filename NOT IN (SELECT filename FROM seen) UNION ALL SELECT filename, modified_at FROM seen")
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.changes import latest_sightings

    return store.upserted(table(spark, d, "documents").select("filename", "modified_at"), latest_sightings(table(spark, d, "file_scan")))


@query("""SELECT filename, modified_at, (SELECT count(*) FROM documents) AS total_count, (SELECT count(*) > 500 FROM documents) AS has_more FROM documents ORDER BY filename LIMIT 500""")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = docs.count()
    return docs.orderBy("filename").limit(500).select("filename", "modified_at", F.lit(n).cast("bigint").alias("total_count"), F.lit(n > 500).alias("has_more"))


# -- graph

_REL = """
WITH r AS (SELECT DISTINCT id, source_chunk_id, target_chunk_id, relation_type, target_name, target_file, confidence FROM code_relations),
m AS (SELECT DISTINCT chunk_id, symbol_name AS source_name FROM code_metadata), c AS (SELECT DISTINCT id AS cid, document_id FROM chunks)
SELECT r.*, source_name, filename AS source_file FROM r JOIN m ON m.chunk_id = source_chunk_id JOIN c ON cid = source_chunk_id JOIN documents ON doc_id = document_id
"""


def _relations(spark: SparkSession, d: str, direction: str, relation_type: str | None = None) -> DataFrame:
    return graph.of_symbol(table(spark, d, "code_relations"), table(spark, d, "code_metadata"), table(spark, d, "chunks"), table(spark, d, "documents"), "commit_batch", direction, relation_type)


@query(_REL + "WHERE target_name = 'commit_batch'")
def rel_incoming(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d, "incoming")


@query(_REL + "WHERE source_name = 'commit_batch'")
def rel_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d, "outgoing")


@query(_REL + "WHERE target_name = 'commit_batch' OR source_name = 'commit_batch'")
def rel_both(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d, "both")


@query(_REL + "WHERE (target_name = 'commit_batch' OR source_name = 'commit_batch') AND relation_type = 'calls'")
def rel_typed(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d, "both", "calls")


_EDGE = "SELECT DISTINCT id, source_chunk_id, target_chunk_id, relation_type, target_name, target_file, confidence FROM code_relations WHERE "


@query(_EDGE + "source_chunk_id = 2 AND relation_type = 'calls'")
def rel_from_chunk(spark: SparkSession, d: str) -> DataFrame:
    return graph.from_chunk(table(spark, d, "code_relations"), 2, "calls")


@query(_EDGE + "target_chunk_id = 2")
def rel_to_chunk(spark: SparkSession, d: str) -> DataFrame:
    return graph.to_chunk(table(spark, d, "code_relations"), 2)


_DOC1 = "(SELECT filename FROM documents JOIN chunks ON doc_id = document_id JOIN code_metadata ON chunk_id = chunks.id WHERE symbol_name = 'commit_batch' ORDER BY filename LIMIT 1)"


@query(f"""SELECT min(m.chunk_id) AS chunk_id FROM code_metadata m JOIN chunks c ON c.id = m.chunk_id JOIN documents d ON d.doc_id = c.document_id
WHERE symbol_name = 'commit_batch' AND filename = {_DOC1} HAVING min(m.chunk_id) IS NOT NULL""")
def chunk_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    metadata, chunks, documents = (table(spark, d, t) for t in ("code_metadata", "chunks", "documents"))
    named = metadata.where(F.col("symbol_name") == "commit_batch").select(F.col("chunk_id").alias("id"))
    file = documents.join(chunks.join(named, "id", "left_semi"), F.col("doc_id") == F.col("document_id"), "left_semi").agg(F.min("filename")).first()[0]
    return graph.chunk_of_symbol(metadata, chunks, documents, file or "", "commit_batch")


@query("SELECT DISTINCT * FROM code_metadata WHERE chunk_id = 2")
def meta_by_chunk(spark: SparkSession, d: str) -> DataFrame:
    return graph.metadata_of(table(spark, d, "code_metadata"), 2)


# -- code text

_SIG = r"""
WITH m AS (SELECT DISTINCT m.id, m.language, m.symbol_name, trim(c.content, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM code_metadata m JOIN chunks c ON c.id = m.chunk_id),
s AS (SELECT *, trim(string_split(t, chr(10))[1], ' ' || chr(9) || chr(13)) AS f, trim(regexp_replace(string_split(t, '{')[1], '\s+', ' ', 'g')) AS brace,
  CASE WHEN contains(t, '{') THEN trim(regexp_replace(string_split(t, '{')[1], '\s+', ' ', 'g')) ELSE string_split(t, chr(10))[1] END AS upto FROM m)
SELECT id, CASE WHEN language = 'python' THEN CASE WHEN f LIKE '%:' THEN left(f, length(f) - 1) WHEN contains(t, '):') THEN trim(regexp_replace(string_split(t, '):')[1] || ')', '\s+', ' ', 'g')) ELSE f END
  WHEN language IN ('typescript', 'javascript') THEN CASE WHEN contains(t, '=>') THEN trim(regexp_replace(string_split(t, '=>')[1] || '=>', '\s+', ' ', 'g')) ELSE upto END
  ELSE upto END AS signature FROM s"""


def _symbol_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "content").distinct()
    return table(spark, d, "code_metadata").select("id", "chunk_id", "language", "symbol_name").distinct().join(c, "chunk_id")


@query(_SIG)
def signatures(spark: SparkSession, d: str) -> DataFrame:
    return _symbol_texts(spark, d).select("id", code_text.signature(F.col("content"), F.col("language")).alias("signature"))


@query("SELECT DISTINCT m.id, language || ' ' || symbol_name || ': ' || content AS said FROM code_metadata m JOIN chunks c ON c.id = m.chunk_id")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return _symbol_texts(spark, d).select("id", code_text.embedding_text(F.col("language"), F.col("symbol_name"), F.col("content")).alias("said"))


@query("""
WITH b AS (SELECT id, list_transform(range(8), lambda i: CAST('0x' || substring(md5(content), CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER) / 255.0::DOUBLE) AS v FROM (SELECT DISTINCT id, content FROM chunks)),
n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM b)
SELECT id, round((v[1] / norm)::FLOAT::DOUBLE, 5) AS first, round((v[8] / norm)::FLOAT::DOUBLE, 5) AS last FROM n""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = V.hash_embedding(F.col("content"), 8)
    rows = table(spark, d, "chunks").select("id", "content").distinct().select("id", v.alias("v"))
    return rows.select("id", F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.get("v", F.lit(7)).cast("double"), 5).alias("last"))


# -- structured text

@query("""SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS line FROM events""")
def flatten_json(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def flat(props):
        import json

        return props.map(lambda p: None if p is None else "\n\n".join(formats.flattened(json.loads(p))))

    return table(spark, d, "events").select("event_id", flat("props").alias("line"))


@query("""SELECT n_nationkey, n_nationkey::VARCHAR || chr(9) || n_name || chr(9) || n_regionkey::VARCHAR AS line FROM nation""")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation")
    raw = F.concat(F.lit('a,b,c\n'), F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit('",'), F.col("n_regionkey").cast("string"))

    @F.pandas_udf("string")
    def read(files):
        return files.map(lambda t: formats.from_csv(t.encode()))

    return rows.select("n_nationkey", F.split(read(raw), "\n")[1].alias("line"))


@query()
def read_documents(spark: SparkSession, d: str) -> DataFrame:
    """All stored texts through the reader of their ending: how many can be read, and their chunks."""
    files_ = table(spark, d, "documents").where(F.col("text").isNotNull()).select("filename", "modified_at", F.encode("text", "UTF-8").alias("content"))
    read = formats.texts(files_)
    ending = T.extension(F.col("filename")).alias("ending")
    return read.select(ending, F.col("error").isNull().alias("ok"), F.size(T.chunks(F.coalesce("text", F.lit("")))).alias("n")).groupBy("ending", "ok").agg(
        F.count("*").alias("n_files"), F.sum("n").alias("n_chunks")
    )


@query()
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    files_ = table(spark, d, "documents").where(T.file_kind(F.col("filename")) == "code").select("filename", "modified_at", "text")
    return code.symbol_rows(files_).drop("content", "modified_at")


@query()
def code_relation_rows(spark: SparkSession, d: str) -> DataFrame:
    files_ = table(spark, d, "documents").where(T.file_kind(F.col("filename")) == "code").select("filename", "modified_at", "text")
    return code.relation_rows(code.symbol_rows(files_))


@query("""SELECT v, CASE WHEN regexp_matches(v, '^v?[0-9]') THEN list_transform(string_split(ltrim(v, 'v') || '.0.0', '.')[1:3], lambda x: CAST(x AS INTEGER)) > [3, 0, 0] END AS newer
FROM (SELECT unnest(['v3.0.1', '2.9.9', '3.0.0', '10.0', 'v3', 'none']) AS v)""")
def version_newer(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(v,) for v in ("v3.0.1", "2.9.9", "3.0.0", "10.0", "v3", "none")], "v string")
    return rows.select("v", (T.version_key(F.col("v")) > T.version_key(F.lit("3.0.0"))).alias("newer"))


# -- stream

@query("""SELECT to_timestamp(floor(epoch_us(ts) / 500000) * 0.5)::TIMESTAMP AS window_start, user_id AS key, count(*) AS n FROM events GROUP BY ALL""")
def debounce_windows(spark: SparkSession, d: str) -> DataFrame:
    return debounced(table(spark, d, "events"), "ts", "user_id")
