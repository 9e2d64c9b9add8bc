"""Relational operators: search, graph lookups, store, sync, change tracking, references."""
