"""Queries of the general data problems (4 and 5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import changes, references
from marlstone.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.files_to_process(table(spark, d, "file_scan"), table(spark, d, "documents"), table(spark, d, "sync_runs")).select("filename")


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """How many files are new, and how many are known but come again."""
    rows = changes.files_to_process(table(spark, d, "file_scan"), table(spark, d, "documents"), table(spark, d, "sync_runs"))
    known = table(spark, d, "documents").select("filename").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "filename", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("n_files"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, list[references.Reference]]:
    relations = table(spark, d, "code_relations")
    return relations, references.relation_references(relations, table(spark, d, "chunks"), table(spark, d, "code_metadata"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    relations, refs = _references(spark, d)
    return references.orphans(relations, "id", refs).select(F.col("id").alias("relation_id"), "ref_kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    relations, refs = _references(spark, d)
    return references.orphan_report(relations, "id", refs, "created_at")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found, "p4_changes": p4_changes, "p5_found": p5_found, "p5_report": p5_report,
}

_LAST = r"""
WITH seen AS (
  SELECT regexp_replace(regexp_replace(replace(filename, '\', '/'), '^/+\?/+', ''), '/{2,}', '/', 'g') AS filename, change, modified_at,
         row_number() OVER (PARTITION BY regexp_replace(regexp_replace(replace(filename, '\', '/'), '^/+\?/+', ''), '/{2,}', '/', 'g')
                            ORDER BY seen_at DESC NULLS LAST, scan_id DESC) AS k
  FROM file_scan),
runs AS (
  SELECT started_at, coalesce(finished_at, lead(started_at) OVER (ORDER BY started_at, run_id), TIMESTAMP '9999-01-01') AS end_at, status
  FROM (SELECT DISTINCT * FROM sync_runs)),
docs AS (SELECT DISTINCT filename, modified_at, indexed_at FROM documents),
found AS (
  SELECT s.filename, d.filename IS NOT NULL AS known FROM seen s LEFT JOIN docs d USING (filename)
  WHERE k = 1 AND change = 'present' AND (
    d.filename IS NULL OR date_trunc('second', s.modified_at) IS DISTINCT FROM date_trunc('second', d.modified_at) OR d.indexed_at IS NULL
    OR EXISTS (SELECT 1 FROM runs r WHERE r.status <> 'ok' AND d.indexed_at BETWEEN r.started_at AND r.end_at)))
"""

_REFS = """
WITH rel AS (SELECT DISTINCT id, source_chunk_id, target_chunk_id, relation_type, target_name, created_at FROM code_relations),
refs AS (
  SELECT id, 'source' AS ref_kind, created_at, source_chunk_id NOT IN (SELECT id FROM chunks) AS lost FROM rel WHERE source_chunk_id IS NOT NULL
  UNION ALL
  SELECT id, 'target', created_at, target_chunk_id NOT IN (SELECT id FROM chunks) FROM rel WHERE target_chunk_id IS NOT NULL
  UNION ALL
  SELECT id, 'name', created_at, target_name NOT IN (SELECT symbol_name FROM code_metadata WHERE symbol_name IS NOT NULL) FROM rel
  WHERE target_chunk_id IS NULL AND relation_type IN ('calls', 'inherits') AND target_name IS NOT NULL)
"""

SQL: dict[str, str] = {
    "p4_found": _LAST + "SELECT filename FROM found",
    "p4_changes": _LAST + "SELECT known, count(*) AS n_files FROM found GROUP BY known",
    "p5_found": _REFS + "SELECT id AS relation_id, ref_kind FROM refs WHERE lost",
    "p5_report": _REFS + """SELECT ref_kind, strftime(created_at, '%Y-%m') AS period, count(*) AS n_refs,
       CAST(count(*) FILTER (lost) AS BIGINT) AS n_orphans FROM refs GROUP BY 1, 2""",
}
