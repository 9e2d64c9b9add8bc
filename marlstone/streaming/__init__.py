"""Structured Streaming: the file watcher and event windows."""
