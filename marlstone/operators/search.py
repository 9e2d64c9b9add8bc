"""Search: exact vector ranking with path filters, symbol keywords, and both merged.

Tables have the columns of ``documents`` (doc_id, filename), ``chunks`` (id,
document_id, position, content), ``vec_chunks`` (chunk_id, embedding) and
``code_metadata``. Ranking is one scan of the vectors with the best few per task;
only those are looked up in chunks and documents, by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vectors as V

#: Vectors that are looked at beyond the wanted ones, for ties and vectors without a chunk.
MARGIN = 50
_SCORED = "query_id bigint, id bigint, distance double"
METADATA = ("symbol_name", "symbol_type", "language", "start_line", "end_line", "parent_symbol", "signature")


def path_filter(name: Column, directory: str | None = None, file_pattern: str | None = None) -> Column | None:
    parts = [T.in_directory(name, directory)] if directory else []
    parts += [T.matches_glob(name, file_pattern)] if file_pattern else []
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def _metadata(code_metadata: DataFrame) -> DataFrame:
    """One row a chunk: the first by id."""
    return code_metadata.groupBy("chunk_id").agg(F.min_by(F.struct(*METADATA), "id").alias("m")).select(F.col("chunk_id").alias("id"), "m.*")


def _once(chunks: DataFrame) -> DataFrame:
    return chunks.dropDuplicates(["id"])


def shown(ranked: DataFrame, code_metadata: DataFrame) -> DataFrame:
    """Adds metadata, as nulls where a chunk has none."""
    return ranked.join(_metadata(code_metadata), "id", "left")


def vector_search(
    vectors: DataFrame, chunks: DataFrame, documents: DataFrame, code_metadata: DataFrame, query: Sequence[float], k: int = 5,
    directory: str | None = None, file_pattern: str | None = None,
) -> DataFrame:
    """``id, document_name, content, position, similarity`` and metadata of the ``k`` nearest chunks.

    Vectors that are null, zero or of another length take no part; of equal
    distances the lesser document and position come first.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    docs = documents.select(F.col("doc_id").alias("document_id"), F.col("filename").alias("document_name"))
    wanted = path_filter(F.col("document_name"), directory, file_pattern)
    rows = vectors.select(F.col("chunk_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    if wanted is not None:
        docs = docs.where(wanted)
        own = chunks.select("id", "document_id").join(docs.select("document_id"), "document_id", "left_semi")
    m = k + MARGIN
    while True:
        # one scan, the best m of a batch go on, the best m of a task are sent; only a filter by path needs ids of all
        near = rows.mapInArrow(_scorer({0: list(query)}, m if wanted is None else None), _SCORED).select("id", "distance")
        if wanted is not None:
            near = near.join(own.select("id"), "id", "left_semi")
        best = near.orderBy("distance", "id").limit(m).collect()
        distances = {r["id"]: r["distance"] for r in best}
        places = _once(chunks.where(F.col("id").isin(list(distances))).select("id", "document_id", "position"))  # m ids at most
        placed = docs.join(F.broadcast(places), "document_id").select("id", "document_name", "position").collect()
        found = [(distances[r["id"]], r["document_name"], r["position"], r["id"]) for r in placed]
        top = sorted(found, key=lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or 0, t[3]))[:k]  # nulls first
        # complete when all vectors were seen, or when what was not seen lies beyond the last one
        if len(best) < m or (len(top) == k and top[-1][0] < best[-1]["distance"]):
            break
        m *= 8
    ranked = chunks.sparkSession.createDataFrame([(i, name, position, d) for d, name, position, i in top], "id bigint, document_name string, position int, distance double")
    texts = _once(chunks.where(F.col("id").isin([t[3] for t in top])).select("id", "content"))  # k rows
    found = texts.join(F.broadcast(ranked), "id").select("id", "document_name", "content", "position", F.round(V.similarity(F.col("distance")), 6).alias("similarity"))
    return shown(found, code_metadata.where(F.col("chunk_id").isin([t[3] for t in top])))


def batch_search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """``query_id, id, similarity, rank`` for many queries (``query_id, embedding``).

    A stated set of queries against all rows, in blocks of ``block`` queries:
    each block is small, one scan, and every task holds it; a batch of rows sends
    its best k only. Null and zero vectors and unlike lengths take no part.
    """
    width = F.size("embedding")
    rows = vectors.select(F.col("chunk_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where(width > 0)
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding").where(width > 0).dropDuplicates(["query_id"])
    n_parts = max(1, -(-asked.count() // block))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_parts)))
    found = None
    for p in range(n_parts):
        held = asked.where(F.col("part") == p).select("query_id", "embedding").collect()  # about a block of queries
        if held:
            best = rows.mapInArrow(_scorer({r[0]: r[1] for r in held}, k), _SCORED)
            found = best if found is None else found.unionByName(best)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    ranked = found.dropDuplicates(["query_id", "id"]).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", F.round(V.similarity(F.col("distance")), 6).alias("similarity"), "rank")


def _scorer(queries: dict[int, Sequence[float]], k: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distances of a batch's vectors to the queries of their length, some queries at a time as one product; the best k of a batch go on, or all."""
    by_width: dict[int, list[int]] = {}
    for q, v in queries.items():
        by_width.setdefault(len(v), []).append(q)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(divide="ignore", invalid="ignore"):
            sides = {w: (np.array(qs), unit(np.array([queries[q] for q in qs], np.float64))) for w, qs in by_width.items()}
            for b in batches:
                ids, column = b["id"].to_numpy(zero_copy_only=False), b["embedding"]
                widths = column.value_lengths().to_numpy(zero_copy_only=False)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for w, (names, q) in sides.items():
                    at = np.flatnonzero(widths == w)
                    x = unit(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, w))
                    own, first = np.unique(ids[at], return_index=True)
                    y = x[first].T
                    for at_q in range(0, len(q), 256):
                        for name, d in zip(names[at_q : at_q + 256], np.round(1 - q[at_q : at_q + 256] @ y, 9), strict=True):
                            good = np.flatnonzero(np.isfinite(d))
                            if k is not None and len(good) > k:
                                good = good[d[good] <= np.partition(d[good], k - 1)[k - 1]]  # ties with the last stay in
                            out.append((np.full(len(good), name), own[good], d[good]))
                if out:
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "id", "distance"])

    return run


def keywords(query: str) -> list[str]:
    """Words of a query of at least three bytes, lower case."""
    return [w.lower() for w in query.split() if len(w.encode()) >= 3]


def symbol_search(code_metadata: DataFrame, chunks: DataFrame, documents: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Chunks whose symbol holds one of the query's words, by document and position; similarity 1.

    Path filters don't apply to symbols. A query without a word gives no rows.
    """
    words = keywords(query)
    name = F.lower("symbol_name")
    hit = F.lit(False)
    for w in words:
        hit = hit | T.like(name, f"%{w}%")
    named = _metadata(code_metadata.where(hit))
    docs = documents.select(F.col("doc_id").alias("document_id"), F.col("filename").alias("document_name"))
    places = _once(chunks.select("id", "document_id", "position").join(named.select("id"), "id", "left_semi"))
    top = named.join(places, "id").join(docs, "document_id").orderBy("document_name", "position").limit(k)
    texts = _once(chunks.select("id", "content").join(F.broadcast(top.select("id")), "id", "left_semi"))  # k rows
    return top.join(texts, "id").select("id", "document_name", "content", "position", F.lit(1.0).alias("similarity"), *METADATA)


def merged(vector_rows: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """Vector results, then symbol results, each place once: up to twice k rows, with ``src`` and ``rank``."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "document_name", "position")  # over k rows
    tagged = [
        x.withColumn("src", F.lit(i)).withColumn("rank", F.row_number().over(order)) for i, x in enumerate((vector_rows, symbol_rows))
    ]
    first = F.row_number().over(Window.partitionBy("document_name", "position").orderBy("src", "rank"))
    return tagged[0].unionByName(tagged[1]).withColumn("n", first).where(F.col("n") == 1).drop("n")


def as_response(rows: DataFrame) -> DataFrame:
    """Similarity as text with four decimals, metadata as a struct where a symbol type is known."""
    return rows.select(
        "document_name", "content", "position", F.format_string("%.4f", F.col("similarity")).alias("similarity"),
        F.when(F.col("symbol_type").isNotNull(), F.struct(*METADATA)).alias("metadata"),
    )
