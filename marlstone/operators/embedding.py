"""Embedding of texts: back ends, batching and retry."""

from __future__ import annotations

import json
import logging
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.vectors import hash_embedding

#: Most estimated tokens of one request; attempts of one; first wait in seconds.
REQUEST_TOKENS, ATTEMPTS, FIRST_WAIT = 8000, 3, 0.1


def estimate(text: str) -> int:
    return -(-len(text.encode()) // 3)


def batches(texts: Iterable[str], size: int = 32, tokens: int = REQUEST_TOKENS) -> Iterator[list[str]]:
    """Texts in order, in batches of at most ``size`` texts and ``tokens`` tokens; a longer text goes alone."""
    held: list[str] = []
    total = 0
    for t in texts:
        n = estimate(t)
        if held and (len(held) == size or total + n > tokens):
            yield held
            held, total = [], 0
        held.append(t)
        total += n
    if held:
        yield held


def batch_number(costs: Column, size: int = 32, tokens: int = REQUEST_TOKENS) -> Column:
    """For an array of token costs in order, the number of each one's batch, from 0."""
    state = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] == size) | (s["sum"] + x > tokens))
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(
            F.concat(s["out"], F.array(batch)).alias("out"), batch.alias("batch"),
            F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, F.lit(0).cast("bigint")).otherwise(s["sum"]).__add__(x).alias("sum"),
        )

    return F.aggregate(costs, state, step)["out"]


class Embedder(Protocol):
    name: str
    dimensions: int

    def columns(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with ``embedding``."""


@dataclass(frozen=True)
class HashEmbedder:
    """Vectors from a digest: for tests and for runs without a service."""

    dimensions: int = 1024
    name: str = "hash-md5"

    def columns(self, rows: DataFrame, text: str) -> DataFrame:
        return rows.withColumn("embedding", hash_embedding(F.col(text), self.dimensions))


def _post(url: str, key: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return json.load(response)


def retried(call: Callable[[], dict], sleep: Callable[[float], None] = time.sleep) -> dict:
    """Tries again after time-outs, lost connections and answers that ask for it."""
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if attempt + 1 == ATTEMPTS or not (e.code >= 500 or e.code in (408, 429)):
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt + 1 == ATTEMPTS:
                raise
        sleep(FIRST_WAIT * 2**attempt)
    raise AssertionError


def vectors_of(answer: dict, n: int, dim: int) -> list[list[float]]:
    """Vectors by index, checked for number and length."""
    data = sorted(answer["data"], key=lambda x: x["index"])
    if len(data) != n:
        raise ValueError(f"{len(data)} vectors for {n} texts")
    if any(len(x["embedding"]) != dim for x in data):
        raise ValueError(f"a vector is not of length {dim}")
    return [x["embedding"] for x in data]


@dataclass(frozen=True)
class HttpEmbedder:
    """An embedding service; partitions call it side by side, at most ``concurrent`` of them."""

    url: str
    model: str
    key: str = field(repr=False)
    dimensions: int = 1024
    size: int = 32
    timeout: float = 30.0
    concurrent: int = 5

    @property
    def name(self) -> str:
        return f"http:{self.model}"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for b in batches(texts, self.size):
            body = {"model": self.model, "input": b, "dimensions": self.dimensions}
            out += vectors_of(retried(lambda body=body: _post(self.url, self.key, body, self.timeout)), len(b), self.dimensions)
        return out

    def columns(self, rows: DataFrame, text: str) -> DataFrame:
        own = self

        @F.pandas_udf("array<float>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                yield pd.Series(own.embed(texts.tolist()))

        return rows.repartition(self.concurrent).withColumn("embedding", embed(text))


#: Where a key may stand, the first one counts.
KEY_VARIABLES = ("MARLSTONE_API_KEY", "EMBEDDING_API_KEY")


def from_config(config: dict) -> Embedder:
    """The service where a key is known, else the hash back end."""
    key = next((os.environ[k] for k in KEY_VARIABLES if os.environ.get(k)), config.get("api_key"))
    dim = int(config.get("dimensions", 1024))
    if not key or not config.get("api_url"):
        logging.getLogger(__name__).warning("no key or address of an embedding service: vectors come from a hash and carry no meaning")
        return HashEmbedder(dim)
    return HttpEmbedder(config["api_url"], config.get("api_model", ""), key, dim, int(config.get("batch_size", 32)), float(config.get("timeout_secs", 30)), int(config.get("max_concurrent", 5)))


def same_embedder(stored: str | None, embedder: Embedder) -> bool:
    """Vectors of two back ends or widths must not be mixed in a store."""
    return stored is None or stored == f"{embedder.name}/{embedder.dimensions}"
