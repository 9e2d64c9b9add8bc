"""The file watcher as a stream, and windows over event streams.

A file source sees new files only, not edits or deletions. So ticks drive it:
each micro-batch compares a listing of the directories with the store and
applies the difference, all of a batch in one commit.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone import config as configs
from marlstone.session import scratch
from marlstone.sources.walk import base_directories

#: How long changes are gathered; files of one batch.
DEBOUNCE, MOST_FILES = "500 milliseconds", 1000


def watch(
    engine, directories: Sequence[str], debounce: str = DEBOUNCE, checkpoint: str | None = None, once: bool = False, config_path: str | None = None
) -> StreamingQuery:
    """Starts the watcher; each batch lists the directories and applies what differs from the store.

    Where ``config_path`` names the configuration's file, an edit of it is loaded
    before a batch: other embedder, excludes and directories count from then on;
    a file that can't be read leaves all as it was.
    """
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    state = {"directories": list(directories), "at": _edited(config_path)}

    def apply(batch: DataFrame, epoch: int) -> None:
        now = _edited(config_path)
        if now != state["at"]:
            state["at"] = now
            try:
                engine.reload(configs.load(config_path))
                state["directories"] = base_directories(engine.config.document_patterns)
            except (OSError, ValueError) as e:
                logging.getLogger(__name__).error("the configuration stays as it was: %s", e)
        for d in state["directories"]:
            engine.sync(d)

    writer = ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint or scratch(engine.spark, "watch"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def _edited(path: str | None) -> float | None:
    return os.stat(path).st_mtime if path and os.path.exists(path) else None


def new_files(spark, directory: str, most: int = MOST_FILES) -> DataFrame:
    """A stream of files as they appear, at most ``most`` a batch; it doesn't see edits or deletions."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).load(directory)


def debounced(events: DataFrame, at: str, key: str, window: str = DEBOUNCE) -> DataFrame:
    """Changes per window and key once: ``window_start, key, n``. For a stream, set a watermark before."""
    return events.groupBy(F.window(at, window).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "key", "n")
