"""Versioned Parquet tables: upsert, delete with cascade, merge; one commit per change.

A version is a manifest of folders; a commit names the live one and fails where
another writer was faster (``versions``). Each version's tables are split by a hash of the filename's bucket;
a change rewrites the buckets that it touches and points at the old files for the
rest, so its cost follows the change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone import schemas
from marlstone.functions.text import NO_ESCAPE
from marlstone.operators.versions import Versions

#: Buckets at least, and files of one; beyond four times as many files the tables are cut anew into more buckets.
BUCKETS, FILES = 32, 20_000
#: Tables of files, all with ``bucket``; and the column by which each knows its document.
FILE_TABLES = ("documents", "chunks", "code_metadata", "code_relations")


def bucket_of(filename: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(filename), F.lit(buckets)).cast("int")


def document_id(filename: Column) -> Column:
    return F.xxhash64(filename)


def chunk_id(filename: Column, position: Column) -> Column:
    return F.xxhash64(filename, position.cast("int"))


# Pure operators on tables as DataFrames; the Store below writes what they give.

def upserted(documents: DataFrame, changed: DataFrame) -> DataFrame:
    """``documents`` (filename unique) with ``changed`` in place of rows of the same name."""
    return documents.join(changed.select("filename"), "filename", "left_anti").unionByName(changed)


def without(table: DataFrame, column: str, gone: DataFrame, gone_column: str) -> DataFrame:
    return table.join(gone.select(F.col(gone_column).alias(column)).distinct(), column, "left_anti")


def cascaded(gone: DataFrame, chunks: DataFrame, vectors: DataFrame, metadata: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """What is left when the documents in ``gone`` (doc_id) go: their chunks with vectors, metadata
    and relations go too; relations to such a chunk stay and lose their target."""
    lost = chunks.join(gone.select(F.col("doc_id").alias("document_id")).distinct(), "document_id", "left_semi").select(F.col("id").alias("lost")).distinct()
    kept = relations.join(lost, F.col("source_chunk_id") == F.col("lost"), "left_anti")
    kept = kept.join(lost, F.col("target_chunk_id") == F.col("lost"), "left").withColumn(
        "target_chunk_id", F.when(F.col("lost").isNull(), F.col("target_chunk_id"))
    ).drop("lost")
    return {
        "chunks": without(chunks, "id", lost, "lost"), "vec_chunks": without(vectors, "chunk_id", lost, "lost"),
        "code_metadata": without(metadata, "chunk_id", lost, "lost"), "code_relations": kept,
    }


def below(filename: Column, prefix: str) -> Column:
    """The path itself and what is below it; ``/a/b`` doesn't take ``/a/bc`` with it."""
    base = prefix.replace("\\", "/").rstrip("/")
    name = F.replace(filename, F.lit("\\"), F.lit("/"))
    return (name == base) | F.ilike(name, F.lit(f"{base}/%"), F.lit(NO_ESCAPE))


class Store:
    """Tables under ``root``. Every change is one new version or nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, root)

    # -- versions: a manifest names, for each table, the folder of each bucket

    def manifest(self) -> dict:
        """The live manifest, with the number of its commit as ``base``."""
        number, at = self.versions.current()
        held = json.loads(self.versions.read_text(f"{at}/manifest.json")) if at else {"tables": {}, "values": {}}
        return {**held, "base": number}

    def _commit(self, manifest: dict) -> None:
        version = f"v-{uuid.uuid4().hex}"
        held = {k: v for k, v in manifest.items() if k != "base"}
        self.versions.write_text(f"{version}/manifest.json", json.dumps(held))
        self.versions.commit(version, manifest["base"])

    def table(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = schemas.stored(name)
        folders = self.manifest()["tables"].get(name, {})
        wanted = sorted({v for k, v in folders.items() if buckets is None or int(k) in buckets})
        if not wanted:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(full).option("recursiveFileLookup", "false")
        parts = []
        for folder in wanted:
            own = [int(k) for k, v in folders.items() if v == folder and (buckets is None or int(k) in buckets)]
            parts.append(rows.parquet(f"{self.root}/{folder}").where(F.col("bucket").isin(own)).drop("bucket"))
        return reduce(DataFrame.unionByName, parts)

    def _rewrite(self, manifest: dict, name: str, rows: DataFrame, bucket: Column, buckets: Sequence[int]) -> None:
        """Puts ``rows`` in place of the given buckets of a table."""
        folder = f"t-{uuid.uuid4().hex}/{name}"
        cols = [f.name for f in schemas.stored(name)]
        rows.select(*cols, bucket.alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        folders = manifest["tables"].setdefault(name, {})
        for b in buckets:
            folders.pop(str(b), None)
        for entry in self.versions.fs.listStatus(self.versions.path(folder)):  # a folder a bucket
            kind, _, value = entry.getPath().getName().partition("=")
            if kind == "bucket":
                folders[value] = folder

    def _buckets(self, manifest: dict, more: DataFrame) -> tuple[int, bool]:
        """How many buckets the tables of files have with ``more`` files, and whether that is another number than now."""
        has = manifest.get("buckets", 0)
        n = (self.table("documents").count() if has else 0) + more.count()
        if not has or n > 4 * FILES * has:
            return max(BUCKETS, n // FILES), bool(has)
        return has, False

    # -- changes

    def replace_files(self, documents: DataFrame, chunks: DataFrame, metadata: DataFrame | None = None, relations: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """New versions of files, and removal of files, in one commit.

        ``documents`` has filename, modified_at, indexed_at; ``chunks`` filename,
        position, content, embedding; ``metadata`` filename, position and symbol
        columns; ``relations`` filename, position and edge columns; ``gone`` filename.
        Ids come from names and positions, so a file keeps them.
        """
        manifest = self.manifest()
        names = documents.select("filename")
        every = names if gone is None else names.unionByName(gone.select("filename"))
        every = every.distinct()
        n_buckets, anew = self._buckets(manifest, every)
        manifest["buckets"] = n_buckets
        bucket = bucket_of(F.col("filename"), n_buckets)
        buckets = sorted(r[0] for r in every.select(bucket.alias("b")).distinct().collect())  # n_buckets at most
        if not buckets:
            return
        new = {
            "documents": documents.select(document_id(F.col("filename")).alias("doc_id"), "filename", "modified_at", "indexed_at"),
            "chunks": chunks.select(chunk_id(F.col("filename"), F.col("position")).alias("id"), document_id(F.col("filename")).alias("document_id"), "filename", "position", "content", "embedding"),
        }
        if metadata is not None:
            new["code_metadata"] = metadata.select(chunk_id(F.col("filename"), F.col("position")).alias("chunk_id"), "filename", *schemas.SYMBOL_COLUMNS)
        if relations is not None:
            new["code_relations"] = relations.select(
                chunk_id(F.col("filename"), F.col("position")).alias("source_chunk_id"), "filename",
                F.lit(None).cast("bigint").alias("target_chunk_id"), "relation_type", "target_name", "target_file", "confidence",
            )
        for name in FILE_TABLES:
            kept = self.table(name, None if anew else buckets).join(every, "filename", "left_anti")
            rows = kept.unionByName(new[name]) if name in new else kept
            if anew:
                manifest["tables"].pop(name, None)
            self._rewrite(manifest, name, rows, bucket, buckets)
        self._commit(manifest)

    def delete(self, filenames: Sequence[str]) -> int:
        """Removes files with all that hangs on them; the number that were there."""
        if not filenames:
            return 0
        gone = self.spark.createDataFrame([(f,) for f in sorted(set(filenames))], "filename string")
        n = self.table("documents").join(gone, "filename", "left_semi").count()
        if n:
            none = self.spark.createDataFrame([], schemas.stored("documents"))
            self.replace_files(none.select("filename", "modified_at", "indexed_at"), self.table("chunks", []).limit(0), gone=gone)
        return n

    def delete_below(self, prefix: str) -> int:
        gone = self.table("documents").where(below(F.col("filename"), prefix)).select("filename")
        n = gone.count()
        if n:
            none = self.spark.createDataFrame([], schemas.stored("documents"))
            self.replace_files(none.select("filename", "modified_at", "indexed_at"), self.table("chunks", []).limit(0), gone=gone)
        return n

    def merge_words(self, new: DataFrame) -> None:
        """The dictionary with new pairs; see functions.dictionary.merged."""
        from marlstone.functions.dictionary import merged

        manifest = self.manifest()
        bucket = bucket_of(F.col("source_word"))
        buckets = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())
        if buckets:
            rows = merged(self.table("word_mapping", buckets), new)
            self._rewrite(manifest, "word_mapping", rows, bucket, buckets)
            self._commit(manifest)

    def get(self, key: str) -> str | None:
        return self.manifest()["values"].get(key)

    def set(self, key: str, value: str) -> None:
        manifest = self.manifest()
        manifest["values"][key] = value
        self._commit(manifest)

    # -- views with the columns that search and graph expect

    def documents(self) -> DataFrame:
        return self.table("documents")

    def vectors(self) -> DataFrame:
        return self.table("chunks").select(F.col("id").alias("chunk_id"), "embedding")

    def metadata(self) -> DataFrame:
        return self.table("code_metadata").select(F.col("chunk_id").alias("id"), "*")

    def relations(self) -> DataFrame:
        edge = F.xxhash64("source_chunk_id", "relation_type", "target_name")
        return self.table("code_relations").select(edge.alias("id"), "*")
