"""One-hop lookups in the graph of code relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = ("id", "source_chunk_id", "target_chunk_id", "relation_type", "target_name", "target_file", "confidence")


def _typed(rows: DataFrame, relation_type: str | None) -> DataFrame:
    return rows if relation_type is None else rows.where(F.col("relation_type") == relation_type)


def of_symbol(relations: DataFrame, metadata: DataFrame, chunks: DataFrame, documents: DataFrame, symbol: str, direction: str = "both", relation_type: str | None = None) -> DataFrame:
    """Relations to (``incoming``), from (``outgoing``) or to and from a symbol, with the source's name and file.

    A relation whose source chunk has no metadata isn't found; repeated rows count once.
    """
    if not symbol:
        raise ValueError("symbol must not be empty")
    sources = metadata.select(F.col("chunk_id").alias("source_chunk_id"), F.col("symbol_name").alias("source_name")).distinct()
    to, frm = F.col("target_name") == symbol, F.col("source_name") == symbol
    wanted = {"incoming": to, "outgoing": frm}.get(direction, to | frm)
    edges = _typed(relations.select(*EDGE), relation_type)
    edges = edges.where(to) if direction == "incoming" else edges
    sources = sources.where(frm) if direction == "outgoing" else sources
    places = chunks.select(F.col("id").alias("source_chunk_id"), "document_id").distinct()
    files = documents.select(F.col("doc_id").alias("document_id"), F.col("filename").alias("source_file"))
    found = edges.distinct().join(sources, "source_chunk_id").where(F.coalesce(wanted, F.lit(False)))
    return found.join(places, "source_chunk_id").join(files, "document_id").select(*EDGE, "source_name", "source_file")


def from_chunk(relations: DataFrame, chunk_id: int, relation_type: str | None = None) -> DataFrame:
    return _typed(relations.where(F.col("source_chunk_id") == chunk_id), relation_type).select(*EDGE).distinct()


def to_chunk(relations: DataFrame, chunk_id: int, relation_type: str | None = None) -> DataFrame:
    return _typed(relations.where(F.col("target_chunk_id") == chunk_id), relation_type).select(*EDGE).distinct()


def chunk_of_symbol(metadata: DataFrame, chunks: DataFrame, documents: DataFrame, filename: str, symbol: str) -> DataFrame:
    """The least chunk id of a symbol in a file."""
    doc = documents.where(F.col("filename") == filename).select(F.col("doc_id").alias("document_id"))
    own = chunks.join(doc, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return metadata.where(F.col("symbol_name") == symbol).join(own, "chunk_id", "left_semi").agg(F.min("chunk_id").alias("chunk_id")).where(F.col("chunk_id").isNotNull())


def metadata_of(metadata: DataFrame, chunk_id: int) -> DataFrame:
    return metadata.where(F.col("chunk_id") == chunk_id).distinct()
