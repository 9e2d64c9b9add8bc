"""The engine: seven requests over one store."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import Config
from marlstone.functions import dictionary, frontmatter
from marlstone.functions import text as T
from marlstone.functions.code_text import embedding_text
from marlstone.operators import embedding, graph, search, sync
from marlstone.operators.store import Store
from marlstone.session import written
from marlstone.sources import code, formats, walk


class Engine:
    def __init__(self, spark: SparkSession, config: Config, embedder: embedding.Embedder | None = None):
        self.spark = spark
        self.store = Store(spark, config.store_dir)
        self._take(config, embedder)

    def _take(self, config: Config, embedder: embedding.Embedder | None) -> None:
        e = config.embedding
        new = embedder or embedding.from_config({
            "api_url": e.api_url, "api_model": e.api_model, "api_key": e.api_key, "dimensions": e.dimensions, "batch_size": e.batch_size,
            "timeout_secs": e.timeout_secs, "max_concurrent": e.max_concurrent,
        })
        if not embedding.same_embedder(self.store.get("embedder"), new):
            raise ValueError(f"the store's vectors are of {self.store.get('embedder')}")
        self.config, self.embedder = config, new

    def reload(self, config: Config) -> None:
        """Another configuration from now on, with its embedder; the store stays. An error changes nothing."""
        if config.store_dir != self.config.store_dir:
            raise ValueError("the store can't be changed while running")
        self._take(config, None)

    def apply_paths(self, paths: Sequence[str]) -> DataFrame:
        """``filename, action`` of single paths that changed: indexed, deleted or passed over.

        A path counts when its extension is known and neither it nor a directory
        above it is excluded; one that is gone is deleted from the store.
        """
        full = list(dict.fromkeys(os.path.abspath(os.path.expanduser(p)).replace(os.sep, "/") for p in paths))
        rows = self.spark.createDataFrame([(p,) for p in full], "filename string")
        known = T.extension(F.col("filename")).isin(list(self.config.file_extensions))
        wanted = {r[0] for r in rows.where(known & ~walk.excluded(F.col("filename"), self.config.exclude_patterns)).collect()}
        gone = sorted(p for p in wanted if not os.path.exists(p))
        self.store.delete(gone)
        here = [p for p in full if p in wanted and p not in gone]
        done = {r["filename"]: r["success"] for r in self.index_files(here).collect()} if here else {}
        action = lambda p: "passed over" if p not in wanted else "deleted" if p in gone else "indexed" if done[p] else "failed"
        return self.spark.createDataFrame([(p, action(p)) for p in full], "filename string, action string")

    # -- index

    def _apply(self, files: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """Reads, cuts and embeds files and puts them into the store: ``filename, failed``."""
        read = written(formats.texts(files), "texts")
        good = read.where(F.col("error").isNull())
        plain = good.where(T.file_kind(F.col("filename")) != "code")
        pieces = plain.select("filename", "modified_at", F.posexplode(T.chunks(F.col("text"), self.config.chunk_size)).alias("position", "content"))
        found = written(code.symbol_rows(good.where(T.file_kind(F.col("filename")) == "code")), "symbols")
        both = pieces.select("filename", "position", "content", F.col("content").alias("said")).unionByName(
            found.select("filename", "position", "content", embedding_text(F.col("language"), F.col("symbol_name"), F.col("content")).alias("said"))
        )
        chunks = written(self.embedder.columns(both, "said").select("filename", "position", "content", "embedding"), "chunks")
        documents = good.select("filename", "modified_at", F.current_timestamp().alias("indexed_at"))
        self.store.replace_files(documents, chunks, found, code.relation_rows(found), gone)
        if self.store.get("embedder") is None:
            self.store.set("embedder", f"{self.embedder.name}/{self.embedder.dimensions}")
        return read.select("filename", F.col("error").isNotNull().alias("failed"))

    def _scan(self, directory: str, content: bool) -> DataFrame:
        return walk.scan(self.spark, directory, self.config.exclude_patterns, self.config.file_extensions, content)

    def sync(self, directory: str, force: bool = False) -> dict[str, int]:
        """Brings the store in line with a directory: added, updated, removed, skipped, failed, indexed."""
        directory = os.path.abspath(os.path.expanduser(directory)).replace(os.sep, "/")
        key, current = f"settings:{directory}", sync.fingerprint(self.config.settings())
        if sync.must_purge(self.store.get(key), current, force):
            self.store.delete_below(directory)
        plan = written(sync.diff(self._scan(directory, False), self.store.documents(), directory, force), "plan")
        work = plan.where(F.col("action").isin("add", "update"))
        gone = plan.where(F.col("action") == "remove").select("filename")
        results = plan.withColumn("failed", F.lit(False))
        if not work.isEmpty() or not gone.isEmpty():
            done = self._apply(self._scan(directory, True).join(work.select("filename"), "filename", "left_semi"), gone)
            results = plan.join(done, "filename", "left")
        self.store.set(key, current)
        return sync.counts(results).first().asDict()

    def index_files(self, paths: Sequence[str]) -> DataFrame:
        """``filename, success`` of single files; ones that are missing or of no known kind fail."""
        full = [os.path.abspath(os.path.expanduser(p)).replace(os.sep, "/") for p in paths]
        good = [p for p in full if os.path.isfile(p) and p.rpartition(".")[2] in self.config.file_extensions]
        done: dict[str, bool] = {}
        if good:
            raw = self.spark.read.format("binaryFile").load([f"file://{p}" for p in good])
            name = T.normal_path(F.regexp_replace("path", "^file:/+", "/"))
            done = {r[0]: not r[1] for r in self._apply(raw.select(name.alias("filename"), F.col("modificationTime").alias("modified_at"), "content")).collect()}
        return self.spark.createDataFrame([(p, done.get(p, False)) for p in full], "filename string, success boolean")

    def index(self, filepath: str | None = None, filepaths: str | None = None, directory: str | None = None, force: bool = False) -> DataFrame:
        kind, what = sync.request_files(filepath, filepaths, directory)
        if kind == "files":
            return self.index_files(what)
        return self.spark.createDataFrame([tuple(self.sync(what[0], force).values())], "added bigint, updated bigint, removed bigint, skipped bigint, failed bigint, indexed bigint")

    # -- search and lists

    def search(self, query: str, top_k: int | None = None, directory: str | None = None, file_pattern: str | None = None) -> DataFrame:
        if not query.strip():
            raise ValueError("query must not be empty")
        k = top_k or self.config.search_top_k
        asked = self.embedder.columns(self.spark.createDataFrame([(query,)], "q string"), "q").first()["embedding"]
        chunks, documents, metadata = self.store.table("chunks"), self.store.documents(), self.store.metadata()
        near = search.vector_search(self.store.vectors(), chunks, documents, metadata, asked, k, directory, file_pattern)
        named = search.symbol_search(metadata, chunks, documents, query, k)
        return search.as_response(search.merged(near, named).orderBy("src", "rank"))

    def list_documents(self, limit: int = 500) -> DataFrame:
        """``filename, modified_at, total_count, has_more``: the first names in order."""
        docs = self.store.documents()
        n = docs.count()
        return docs.orderBy("filename").limit(limit).select("filename", "modified_at", F.lit(n).alias("total_count"), F.lit(n > limit).alias("has_more"))

    def manage_document(self, filename: str, action: str = "delete") -> bool:
        """``delete`` succeeds for files that aren't there; ``reindex`` needs the file and checks that first."""
        if action == "reindex":
            if not os.path.isfile(filename):
                raise FileNotFoundError(filename)
            return bool(self.index_files([filename]).first()["success"])
        if action != "delete":
            raise ValueError(f"no such action: {action}")
        self.store.delete([filename])
        return True

    def search_relations(self, symbol: str, relation_type: str | None = None, direction: str = "both") -> DataFrame:
        s = self.store
        return graph.of_symbol(s.relations(), s.metadata(), s.table("chunks"), s.documents(), symbol, direction, relation_type)

    def build_dictionary(self, source_lang: str = "ja", document: str | None = None, limit: int = 100) -> dict:
        """Mines pairs from stored documents: a named one, or the first ``limit`` by name in the wanted language."""
        docs = self.store.documents()
        names = docs.where(F.col("filename") == document) if document else docs.orderBy("filename").limit(limit)
        if document and names.isEmpty():
            raise ValueError(f"not indexed: {document}")
        # chunk by chunk, then once a pair and document: no document is put together for it
        own = self.store.table("chunks").join(names.select("filename"), "filename", "left_semi")
        rows = own if document else dictionary.gated(own, "content", source_lang)
        pairs = dictionary.mined(rows, "filename", "content")
        new = written(pairs.select("source_word", "target_word", F.lit(source_lang).alias("source_lang"), "confidence", F.col("document").alias("source_document")), "pairs")
        if not new.isEmpty():
            self.store.merge_words(new)
        words = self.store.table("word_mapping")
        sample = [r.asDict() for r in new.orderBy("source_word", "target_word").limit(10).collect()]
        return {"extracted_count": new.count(), "total": words.count(), "sample": sample}

    def frontmatter(self, filepath: str, mode: str = "update", **values: object) -> str:
        """Adds or updates the header of a file; the new text."""
        with open(filepath, encoding="utf-8") as file:
            text = file.read()
        if isinstance(values.get("tags"), str):
            values["tags"] = [t.strip() for t in str(values["tags"]).split(",") if t.strip()]
        make = {"add": frontmatter.added, "update": frontmatter.updated}[mode]
        row = self.spark.createDataFrame([(text,)], "t string").select(make(F.col("t"), frontmatter.of(values)).alias("t"), frontmatter.status(F.col("t")).alias("s")).first()
        if row["t"] is None:
            raise ValueError("frontmatter is not closed" if row["s"] == "unclosed" else "frontmatter already exists")
        with open(filepath, "w", encoding="utf-8") as file:
            file.write(row["t"])
        return row["t"]


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))
