"""Most similar vectors by cosine, over an inverted multi-index.

Vectors are cut into two halves and each half is put to the nearest of its
centroids, so a pair of centroids names a cell. For a query, cells are visited
in the order of their summed distances, kept by a heap over the two sorted lists
(the multi-sequence walk), until they hold enough vectors; those are reranked by
their exact cosine.

The codebooks are fitted on a bounded sample; every vector is indexed. Cells are
packed into blocks of bounded size, near cells together, and a cell with more
vectors than that is split. A query goes to the blocks of its cells, in bounded
groups by block: no task gathers more than one block and one group, and a block
is sent as often as its own queries ask for.

Centroids and visited vectors grow with the number of vectors N, as the root of
N and as N to the two thirds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.arrow import map_columns
from marlstone.session import written

#: Centroids of each half at most; vectors the codebooks are fitted on; vectors of a block; queries of a group.
CENTROIDS, SAMPLE, BLOCK, QUERIES = 1024, 40_000, 60_000, 100_000


def visited(n: int) -> int:
    """Vectors whose exact cosine is taken, per query, at least, of ``n``."""
    return max(200, round(n ** (2 / 3)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return (y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.float32)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * (x @ centroids.T), axis=1)


def _fit_half(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations; an empty centroid takes the point that is worst served.

    The centroids are put in a chain from neighbour to neighbour, so that cells
    near each other get near numbers and share blocks.
    """
    k = min(k, len(x))
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        sums = np.zeros((k, x.shape[1]))
        sums[n > 0] = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0], axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
        for j in np.flatnonzero(n == 0):
            c[j] = x[int(np.argmax(((x - c[at]) ** 2).sum(1)))]
    chain, left = [0], set(range(1, k))
    while left:
        rest = np.fromiter(left, np.int64)
        chain.append(int(rest[np.argmin(((c[rest] - c[chain[-1]]) ** 2).sum(1))]))
        left.remove(chain[-1])
    return c[chain]


@dataclass(frozen=True)
class Index:
    left: np.ndarray
    right: np.ndarray
    #: Vectors of each cell, the first block of each cell, and the blocks that it is split over.
    counts: np.ndarray
    block: np.ndarray
    splits: np.ndarray

    def cells(self, unit: np.ndarray) -> np.ndarray:
        h = unit.shape[1] // 2
        return _nearest(unit[:, :h], self.left) * len(self.right) + _nearest(unit[:, h:], self.right)

    def walk(self, query: np.ndarray, least: int) -> list[int]:
        """Cells in the order of their summed distances until they hold ``least`` vectors."""
        h = len(query) // 2
        a, b = ((self.left - query[:h]) ** 2).sum(1), ((self.right - query[h:]) ** 2).sum(1)
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i], b[j]
        heap, pushed, out, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
        while heap and held < least:
            _, x, y = heapq.heappop(heap)
            cell = int(i[x]) * len(b) + int(j[y])
            if self.counts[cell]:
                out.append(cell)
                held += int(self.counts[cell])
            for n in ((x + 1, y), (x, y + 1)):
                if n[0] < len(a) and n[1] < len(b) and n not in pushed:
                    pushed.add(n)
                    heapq.heappush(heap, (a[n[0]] + b[n[1]], *n))
        return out

    def reach(self, query: np.ndarray, cells: list[int]) -> float:
        """The greatest summed distance among ``cells``: what lies within it is visited."""
        h, at = len(query) // 2, np.array(cells)
        a, b = ((self.left - query[:h]) ** 2).sum(1), ((self.right - query[h:]) ** 2).sum(1)
        return float((a[at // len(b)] + b[at % len(b)]).max())


def _morton(i: np.ndarray, j: np.ndarray, bits: int = 16) -> np.ndarray:
    """Places of (i, j) on a curve that keeps near ones together."""
    z = np.zeros(len(i), np.int64)
    for k in range(bits):
        z |= (i >> k & 1) << (2 * k) | (j >> k & 1) << (2 * k + 1)
    return z


def usable(vectors: DataFrame, row_id: str, vector: str, dim: int) -> DataFrame:
    """``id, vector``: not null, of ``dim`` finite numbers, not all zero."""
    v = F.col(vector).cast("array<float>")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (
        vectors.select(F.col(row_id).cast("bigint").alias("id"), v.alias("vector"))
        .where(F.col("id").isNotNull() & (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
        .where((norm > 0) & (norm < float("inf")))
    )


def build(rows: DataFrame, dim: int) -> Index | None:
    """The index over ``usable`` rows; None where there are none."""
    total = rows.count()
    if not total:
        return None
    share = min(1.0, SAMPLE / total)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE).toArrow()
    if not picked.num_rows:
        picked = rows.limit(SAMPLE).toArrow()
    x = _unit(_matrix(picked["vector"], dim))
    h = dim // 2
    k = min(CENTROIDS, max(4, round((total / 4) ** 0.5)))
    left, right = _fit_half(x[:, :h], k), _fit_half(x[:, h:], k)
    bare = Index(left, right, np.zeros(0), np.zeros(0), np.zeros(0))

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        cell, n = np.unique(bare.cells(_unit(_matrix(b["vector"], dim))), return_counts=True)
        return {"cell": cell, "n": n}

    counts = np.zeros(len(left) * len(right), np.int64)
    for cell, n in map_columns(rows.select("vector"), f, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect():  # a row a cell
        counts[cell] = n
    block, splits, at, filled = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    each = np.arange(len(counts))
    for cell in np.argsort(_morton(each // len(right), each % len(right)), kind="stable").tolist():
        n = int(counts[cell])
        if n > BLOCK:
            at += 1 if filled else 0
            block[cell], splits[cell] = at, -(-n // BLOCK)
            at, filled = at + int(splits[cell]), 0
        else:
            if filled + n > BLOCK:
                at, filled = at + 1, 0
            block[cell] = at
            filled += n
    return Index(left, right, counts, block, splits)


def nearest(vectors: DataFrame, queries: DataFrame, row_id: str, vector: str, dim: int = 64, k: int = 10, visit: int | None = None) -> DataFrame:
    """``id, neighbour, cosine``: for each id of ``queries`` the ``k`` other vectors most like it.

    ``visit`` is by default ``visited`` of the number of vectors. Null, zero, not
    finite or otherwise long vectors take no part, as query or as neighbour; a
    repeated id counts once; of equal cosines the lesser id comes first; fewer
    than ``k`` others give fewer rows.
    """
    spark = vectors.sparkSession
    schema = "id bigint, neighbour bigint, cosine double"
    rows = usable(vectors, row_id, vector, dim)
    index = build(rows, dim)
    if index is None:
        return spark.createDataFrame([], schema)
    least = visited(int(index.counts.sum())) if visit is None else visit

    def visits(b: dict[str, pa.Array]) -> dict[str, object]:
        out: dict[str, list] = {"block": [], "id": [], "vector": [], "reach": []}
        x = _matrix(b["vector"], dim)
        for i, raw, q in zip(b["id"].to_pylist(), x, _unit(x), strict=True):
            cells = index.walk(q, max(least, k + 1))
            reach = index.reach(q, cells)
            first, n = index.block[cells], index.splits[cells]
            for block in np.unique(np.concatenate([first, *[f + np.arange(m) for f, m in zip(first[n > 1], n[n > 1], strict=True)]])).tolist():
                for key, v in zip(out, (block, i, raw.tobytes(), reach), strict=True):
                    out[key].append(v)
        return out

    asked = queries.select(F.col(row_id).cast("bigint").alias("id")).where(F.col("id").isNotNull()).distinct()
    n_asked = asked.count()
    # a query's walk costs milliseconds but few bytes: by bytes alone they would all end up in one task
    spread = rows.join(asked, "id", "left_semi").dropDuplicates(["id"]).repartition(min(10_000, max(1, n_asked // 100)), "id")
    sent = written(map_columns(spread, visits, "block int, id bigint, vector binary, reach double"), "queries")
    # groups of queries, as many as a block's own number asks for; a row a block comes here
    groups = np.zeros(int((index.block + index.splits).max()), np.int64)
    for block, n in sent.groupBy("block").agg(F.count("*").alias("n")).collect():
        groups[block] = -(-n // QUERIES)
    tasks = int(max(1, groups.sum()))

    def place(b: dict[str, pa.Array]) -> dict[str, object]:
        x = _matrix(b["vector"], dim)
        cell = index.cells(_unit(x))
        ids = b["id"].to_numpy(zero_copy_only=False)
        block = index.block[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % index.splits[cell]
        of = np.repeat(np.arange(len(x)), groups[block])  # a block that no query visits isn't sent
        part = np.arange(len(of)) - np.repeat(np.cumsum(groups[block]) - groups[block], groups[block])
        width = x.shape[1] * 4
        packed = pa.Array.from_buffers(pa.binary(width), len(of), [None, pa.py_buffer(np.ascontiguousarray(x[of]).tobytes())])
        return {"block": block[of], "part": part, "cell": cell[of], "id": ids[of], "vector": packed.cast(pa.binary())}

    placed = map_columns(rows, place, "block int, part int, cell int, id bigint, vector binary")
    n_groups = F.element_at(F.lit(groups.tolist()), F.col("block") + 1)
    part = F.pmod(F.xxhash64("id"), n_groups).cast("int").alias("part")
    left, right = (x.repartition(tasks, "block", "part").groupBy("block", "part") for x in (placed, sent.select("*", part)))

    def rerank(vs: pa.Table, qs: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = list(_reranked(index, vs, qs, dim, k))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"id": pa.array(cols[0], pa.int64()), "neighbour": pa.array(cols[1], pa.int64()), "cosine": pa.array(cols[2], pa.float64())})

    best = left.cogroup(right).applyInArrow(rerank, schema)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return best.withColumn("k", rank).where(F.col("k") <= k).select("id", "neighbour", "cosine")


def _reranked(index: Index, vs: pa.Table, qs: pa.Table, dim: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query, its ``k`` best of the cells of this block that lie within its reach."""
    if not vs.num_rows or not qs.num_rows:
        return
    vs, qs = vs.combine_chunks(), qs.combine_chunks()
    ids, first = np.unique(vs["id"].to_numpy(), return_index=True)
    cell = vs["cell"].to_numpy()[first]
    order = np.argsort(cell, kind="stable")
    ids, cell = ids[order], cell[order]
    x = np.frombuffer(b"".join(vs["vector"].to_pylist()), np.float32).reshape(-1, dim)[first][order].astype(np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    names, start, n = np.unique(cell, return_index=True, return_counts=True)
    i_left, i_right, h = names // len(index.right), names % len(index.right), dim // 2
    raw = np.frombuffer(b"".join(qs["vector"].to_pylist()), np.float32).reshape(-1, dim)
    for i, q, single, reach in zip(qs["id"].to_pylist(), raw.astype(np.float64), _unit(raw), qs["reach"].to_pylist(), strict=True):
        a, b = ((index.left - single[:h]) ** 2).sum(1), ((index.right - single[h:]) ** 2).sum(1)
        near = np.flatnonzero(a[i_left] + b[i_right] <= reach)
        if not len(near):
            continue
        m = n[near]
        at = np.repeat(start[near] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        cos, who = x[at] @ (q / np.sqrt(q @ q)), ids[at]
        other = who != i
        cos, who = cos[other], who[other]
        if len(cos) > k:
            edge = -np.partition(-cos, k - 1)[k - 1]
            keep = cos >= edge  # all that tie with the last stay in; the final rank decides
            cos, who = cos[keep], who[keep]
        yield np.full(len(who), i, np.int64), who, cos
