"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import comments, files, handwritten, leaks, markup, mixing, nearest, neardup, quality
from marlstone.session import table


def _file_labels(spark: SparkSession, d: str) -> DataFrame:
    documents = files.documents_of(table(spark, d, "documents"), files.SOURCE)
    code = files.chunks_of(table(spark, d, "chunks"), documents, files.SOURCE)
    evidence = handwritten.file_evidence(handwritten.chunk_evidence(code, "id", "document_id", "position", "content"))
    return handwritten.labels(documents, "doc_id", "filename", evidence)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _file_labels(spark, d).where(F.col("label") != "handwritten").select(F.col("file").alias("doc_id"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return _file_labels(spark, d).withColumnRenamed("file", "doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "vec_chunks").select(F.col("chunk_id").alias("id"), "embedding")
    probes = table(spark, d, "knn_probes").select(F.col("chunk_id").alias("id"))
    found = nearest.nearest(vectors, probes, "id", "embedding")
    return found.select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(spark, d, "chunks"), "id", "content").select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "chunks"), "id", "content")


def _text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return files.chunks_of(table(spark, d, "chunks"), table(spark, d, "documents"), files.TEXT)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    held = markup.cleaned(_text_chunks(spark, d), "id", "content")
    return held.select(F.col("id").alias("chunk_id"), F.explode("markup").alias("markup")).distinct()


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(_text_chunks(spark, d), "id", "content").withColumnRenamed("id", "chunk_id")


def _code_chunks(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").withColumn("ending", files.ending(F.col("filename")))
    return files.chunks_of(table(spark, d, "chunks"), documents, files.SOURCE, "ending")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    held = comments.hidden_language(_code_chunks(spark, d), "id", "document_id", "content", "ending")
    return held.select(F.col("id").alias("chunk_id"), F.col("lang").alias("comment_lang")).distinct()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of natural language by file and language, and their share of the file."""
    code = _code_chunks(spark, d)
    held = comments.hidden_language(code, "id", "document_id", "content", "ending")
    return comments.shares(held, code, "id", "document_id", "content").withColumnRenamed("file", "doc_id")


def _leaks(spark: SparkSession, d: str, tile: int) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", tile)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, 13).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item, the documents that hold tiles of eight words that cover at least a third of it."""
    held = _leaks(spark, d, 8).where(F.col("covered") * 3 >= F.col("item_words"))
    return leaks.leak_report(held).withColumnRenamed("item", "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets")).withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixed(table(spark, d, "documents"), targets), targets)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return quality.judged(files.documents_of(table(spark, d, "documents"), files.TEXT), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(_judged(spark, d)).select(F.col("id").alias("doc_id"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_labels": p1_labels, "p2_found": p2_found, "p3_found": p3_found, "p3_groups": p3_groups, "p6_found": p6_found, "p6_clean": p6_clean, "p7_found": p7_found, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_statistics": p10_statistics,
}

SQL: dict[str, str] = {
    "p2_found": """
WITH v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM vec_chunks
           WHERE len(embedding) = 64 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
q AS (SELECT DISTINCT chunk_id AS p, e AS qe FROM v JOIN knn_probes USING (chunk_id)),
s AS (SELECT p, chunk_id, row_number() OVER (PARTITION BY p ORDER BY list_cosine_similarity(e, qe) DESC, chunk_id) AS k FROM v, q WHERE chunk_id <> p)
SELECT p AS chunk_id, chunk_id AS neighbour_id FROM s WHERE k <= 10""",
    # exact: texts that share enough of their rarest substrings, then all substrings counted
    "p3_found": r"""
WITH t AS (SELECT DISTINCT id, content FROM chunks WHERE id IS NOT NULL AND length(content) >= 200),
s AS (SELECT id, trim(regexp_replace(lower(content), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS s FROM t),
g AS (SELECT id, unnest(list_distinct(list_transform(range(1, length(s) - 3), lambda i: hash(substring(s, i, 5))))) AS g FROM s),
f AS (SELECT g, count(*) AS f FROM g GROUP BY g),
r AS (SELECT id, g, row_number() OVER (PARTITION BY id ORDER BY f, g) AS k, count(*) OVER (PARTITION BY id) AS n FROM g JOIN f USING (g)),
p AS (SELECT * FROM r WHERE k <= n - ceil(0.7 * n) + least(20, ceil(0.7 * n))),
c AS (SELECT a.id AS chunk_a, b.id AS chunk_b, any_value(a.n) AS na, any_value(b.n) AS nb FROM p a JOIN p b USING (g) WHERE a.id < b.id AND a.n >= 0.69 * b.n AND b.n >= 0.69 * a.n
      GROUP BY ALL HAVING count(*) >= least(20, ceil(0.7 * least(any_value(a.n), any_value(b.n))))),
m AS (SELECT chunk_a, chunk_b, any_value(na + nb) AS n, count(*) AS common FROM c JOIN g x ON x.id = chunk_a JOIN g y ON y.id = chunk_b AND y.g = x.g GROUP BY chunk_a, chunk_b)
SELECT chunk_a, chunk_b FROM m WHERE common >= 0.7::DOUBLE * (n - common)""",
}

# as the problem states it; of NFKC, which DuckDB has not, composition and the wide forms of ASCII letters and digits
_WIDE, _PLAIN = ("".join(chr(k + shift) for k in range(48, 123) if chr(k).isalnum()) for shift in (0xFEE0, 0))
SQL["p8_found"] = r"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(nfc_normalize(translate(text, 'WIDE', 'PLAIN'))), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(nfc_normalize(translate(text, 'WIDE', 'PLAIN'))), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ir AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k + 12]))) AS h FROM i WHERE len(w) >= 13),
dr AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k + 12]))) AS h FROM d WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (h)""".replace("WIDE", _WIDE).replace("PLAIN", _PLAIN)

_PAIRS, _, _ALIKE = SQL["p3_found"].rpartition("SELECT chunk_a, chunk_b FROM m")
SQL["p3_groups"] = _PAIRS.replace("WITH t", "WITH RECURSIVE t", 1).rstrip() + f""",
z AS (SELECT chunk_a, chunk_b FROM m {_ALIKE}),
e AS (SELECT chunk_a AS a, chunk_b AS b FROM z UNION ALL SELECT chunk_b, chunk_a FROM z),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
l AS (SELECT a AS id, min(b) AS least FROM reach GROUP BY a),
d AS (SELECT e.a AS id, count(DISTINCT y.s) AS n FROM e JOIN s x ON x.id = e.a JOIN s y ON y.id = e.b WHERE x.s <> y.s GROUP BY e.a)
SELECT id, least(id, coalesce(l.least, id)) AS group_id, coalesce(d.n, 0) AS n_links FROM s LEFT JOIN l USING (id) LEFT JOIN d USING (id) WHERE length(s.s) >= 5"""
