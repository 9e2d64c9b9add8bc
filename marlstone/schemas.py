"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

SYMBOL_COLUMNS = ("symbol_name", "symbol_type", "language", "start_line", "end_line", "parent_symbol", "signature")

STORE: dict[str, str] = {
    "documents": "doc_id bigint, filename string, modified_at timestamp, indexed_at timestamp",
    "chunks": "id bigint, document_id bigint, filename string, position int, content string, embedding array<float>",
    "code_metadata": "chunk_id bigint, filename string, symbol_name string, symbol_type string, language string, start_line int, end_line int, parent_symbol string, signature string",
    "code_relations": "source_chunk_id bigint, filename string, target_chunk_id bigint, relation_type string, target_name string, target_file string, confidence double",
    "word_mapping": "source_word string, target_word string, source_lang string, confidence double, source_document string",
}


def stored(name: str) -> StructType:
    """A table's schema; needs a session, which parses it."""
    return StructType.fromDDL(STORE[name])
