"""Retrieval and document-analytics operators on PySpark DataFrames."""
