"""Kinds of files by name, and the chunks of files of a kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File endings of source and of text.
SOURCE = "rs go py js mjs cjs jsx ts mts cts tsx".split()
TEXT = "md txt html htm".split()
#: File ids up to this number are broadcast (about 40 bytes each in a task); beyond, a shuffle join.
BROADCAST_ROWS = 1_000_000


def ending(filename: Column) -> Column:
    """The last extension, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))


def documents_of(documents: DataFrame, endings: list[str]) -> DataFrame:
    return documents.where(ending(F.col("filename")).isin(endings))


def chunks_of(chunks: DataFrame, documents: DataFrame, endings: list[str], *columns: str) -> DataFrame:
    """Chunks of the documents with these endings, with ``columns`` of the documents."""
    docs = documents_of(documents, endings).select(F.col("doc_id").alias("document_id"), *columns).dropDuplicates(["document_id"])
    small = docs.count() <= BROADCAST_ROWS
    return chunks.join(F.broadcast(docs) if small else docs, "document_id", "inner" if columns else "left_semi")
