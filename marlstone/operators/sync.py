"""Differential sync of a directory with the store."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.store import below


def fingerprint(settings: dict) -> str:
    """Of all settings on which stored rows depend: excludes, extensions, chunk size, embedder."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def diff(seen: DataFrame, stored: DataFrame, directory: str, force: bool = False) -> DataFrame:
    """``filename, action``: add, update, skip, or remove for stored files below ``directory`` that weren't seen.

    Both have filename and modified_at; whole seconds are compared, as file
    systems and stores keep fractions differently.
    """
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    s = seen.groupBy("filename").agg(F.max("modified_at").alias("now"))
    o = stored.select("filename", F.col("modified_at").alias("was"), F.lit(True).alias("known"))
    both = s.withColumn("found", F.lit(True)).join(o, "filename", "full_outer")
    action = (
        F.when(F.col("found").isNull(), F.when(below(F.col("filename"), directory), "remove"))
        .when(F.col("known").isNull(), "add")
        .when(F.lit(force) | ~second("now").eqNullSafe(second("was")), "update").otherwise("skip")
    )
    return both.select("filename", action.alias("action")).where(F.col("action").isNotNull())


def counts(results: DataFrame) -> DataFrame:
    """One row: added, updated, removed, skipped, failed, indexed.

    ``results`` has action and failed; a failed file is neither added nor updated.
    """
    done = ~F.coalesce(F.col("failed"), F.lit(False))
    n = lambda c: F.count_if(c)
    return results.agg(
        n((F.col("action") == "add") & done).alias("added"), n((F.col("action") == "update") & done).alias("updated"),
        n(F.col("action") == "remove").alias("removed"), n(F.col("action") == "skip").alias("skipped"), n(~done).alias("failed"),
        n(F.col("action").isin("add", "update") & done).alias("indexed"),
    )


def must_purge(stored: str | None, current: str, force: bool) -> bool:
    """Rows made under other settings go, unless everything is made anew anyhow."""
    return stored is not None and stored != current and not force


def request_files(filepath: str | None, filepaths: str | None, directory: str | None) -> tuple[str, Sequence[str]]:
    """What an index request names: one file before a list, a list before a directory."""
    if filepath:
        return "files", [filepath]
    if filepaths:
        return "files", [p for p in (x.strip() for x in filepaths.split(",")) if p]
    if directory:
        return "directory", [directory]
    raise ValueError("one of filepath, filepaths, directory is needed")
