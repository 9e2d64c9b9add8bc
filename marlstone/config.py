"""Configuration: JSON with a default for every field."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from marlstone.functions.text import EXTENSIONS
from marlstone.sources.walk import EXCLUDES


@dataclass
class Embedding:
    api_url: str = ""
    api_model: str = "text-embedding-v4"
    api_key: str = ""
    dimensions: int = 1024
    batch_size: int = 32
    timeout_secs: float = 30.0
    max_concurrent: int = 5


@dataclass
class Config:
    document_patterns: list[str] = field(default_factory=lambda: ["./"])
    exclude_patterns: list[str] = field(default_factory=lambda: list(EXCLUDES))
    file_extensions: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    chunk_size: int = 500
    search_top_k: int = 5
    embedding: Embedding = field(default_factory=Embedding)
    data_dir: str = "~/.marlstone"

    @property
    def store_dir(self) -> str:
        return os.path.join(os.path.expanduser(self.data_dir), "store")

    def problems(self) -> list[str]:
        """What is wrong with the values; nothing where all are right."""
        e = self.embedding
        rules = (
            (self.chunk_size >= 1, "chunk_size must be at least 1"),
            (1 <= self.search_top_k <= 1000, "search_top_k must lie between 1 and 1000"),
            (bool(self.document_patterns), "document_patterns must not be empty"),
            (bool(self.file_extensions), "file_extensions must not be empty"),
            (not set(self.file_extensions) - set(EXTENSIONS), "file_extensions holds an unknown one"),
            (e.dimensions >= 1, "embedding.dimensions must be at least 1"),
            (e.batch_size >= 1, "embedding.batch_size must be at least 1"),
            (e.timeout_secs > 0, "embedding.timeout_secs must be above 0"),
            (e.max_concurrent >= 1, "embedding.max_concurrent must be at least 1"),
        )
        return [said for ok, said in rules if not ok]

    def settings(self) -> dict[str, Any]:
        """What stored rows depend on."""
        return {
            "exclude": sorted(self.exclude_patterns), "extensions": sorted(self.file_extensions), "chunk_size": self.chunk_size,
            "model": self.embedding.api_model, "dimensions": self.embedding.dimensions,
        }


def from_dict(values: dict[str, Any]) -> Config:
    """Unknown keys are left out; the old ``documents_dir`` becomes a pattern where none is given."""
    own = {f.name for f in fields(Config)} - {"embedding"}
    config = Config(**{k: v for k, v in values.items() if k in own})
    inner = {f.name for f in fields(Embedding)}
    config.embedding = Embedding(**{k: v for k, v in (values.get("embedding") or {}).items() if k in inner})
    if values.get("documents_dir") and "document_patterns" not in values:
        config.document_patterns = [values["documents_dir"]]
    return config


def load(path: str) -> Config:
    """The file's configuration; without a file the defaults, which are written there."""
    path = os.path.expanduser(path)
    if not os.path.exists(path):
        config = Config()
        save(config, path)
        return config
    with open(path, encoding="utf-8") as file:
        config = from_dict(json.load(file))
    if problems := config.problems():
        raise ValueError("; ".join(problems))
    return config


def save(config: Config, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(asdict(config), file, indent=2)
