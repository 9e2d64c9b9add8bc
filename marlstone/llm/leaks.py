"""Evaluation texts leaking into training text.

Greedy string tiling of every document with every held-out item that shares a
seed with it. A seed is a run of ``tile`` words, met by a rolling (Karp-Rabin)
hash over word numbers; words that no item has break a run, so most of a corpus
is passed over without hashing. Then the longest common run not yet marked is
marked, again and again, so passages that were cut up and reordered still cover
their item.

The items are a held-out set that is met in blocks of at most BLOCK_WORDS words;
a block is a bounded table that every task holds, and each block is one pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.arrow import map_columns

#: Words of items in one pass: about 40 bytes each in a task.
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC and lower-casing."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


def run_hashes(numbers: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` numbers, by start."""
    n = len(numbers) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    x = numbers.astype(np.uint64) + np.uint64(1)
    for k in range(width):
        h = (h * _BASE) ^ (x[k : k + n] * np.uint64(0xBF58476D1CE4E5B9))
        h ^= h >> np.uint64(29)
    return h


class Items:
    """One block of items: words as numbers, and where each seed lies."""

    def __init__(self, rows: list[tuple[int, str]], tile: int):
        self.tile, self.number, self.tokens = tile, {}, {}
        for i, text in rows:
            self.tokens[i] = np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], np.int64)
        at: dict[int, set[int]] = defaultdict(set)
        for i, t in self.tokens.items():
            for h in run_hashes(t, tile).tolist():
                at[h].add(i)
        self.seeds = np.array(sorted(at), np.uint64)
        self.owners = {h: tuple(sorted(v)) for h, v in at.items()}

    def candidates(self, text: str) -> tuple[np.ndarray, set[int]]:
        """The document's word numbers (-1: in no item) and the items that share a seed."""
        get = self.number.get
        doc = np.array([get(w, -1) for w in words(text)], np.int64)
        if len(doc) < self.tile or not len(self.seeds):
            return doc, set()
        unknown = np.concatenate([[0], np.cumsum(doc < 0)])
        start = np.flatnonzero(unknown[self.tile :] == unknown[: -self.tile])
        if not len(start):
            return doc, set()
        h = run_hashes(doc, self.tile)[start]
        at = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        hit = np.unique(h[self.seeds[at] == h])
        return doc, {i for x in hit.tolist() for i in self.owners[x]}

    def tiles(self, doc: np.ndarray, item: int) -> Iterator[tuple[int, int, int]]:
        """``(item start, document start, words)`` of the marked runs, longest first."""
        text, w = self.tokens[item], self.tile
        where: dict[int, list[int]] = defaultdict(list)
        for p, h in enumerate(run_hashes(text, w).tolist()):
            where[h].append(p)
        pairs = [(p, q) for q, h in enumerate(run_hashes(doc, w).tolist()) if h in where for p in where[h]]
        used_item, used_doc = np.zeros(len(text), bool), np.zeros(len(doc), bool)
        while pairs:
            best, left = (0, 0, 0), []
            reach: dict[int, int] = {}  # by diagonal, how far a run that was measured goes
            for p, q in pairs:
                if used_item[p] or used_doc[q]:
                    continue
                if reach.get(q - p, -1) > q:
                    left.append((p, q))
                    continue
                n = min(len(text) - p, len(doc) - q)
                stop = np.flatnonzero((text[p : p + n] != doc[q : q + n]) | used_item[p : p + n] | used_doc[q : q + n])
                k = int(stop[0]) if len(stop) else n
                reach[q - p] = q + k
                if k >= w:
                    left.append((p, q))
                    if k > best[2]:
                        best = (p, q, k)
            if best[2] < w:
                return
            p, q, k = best
            used_item[p : p + k] = used_doc[q : q + k] = True
            yield best
            pairs = left


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    rows = items.select(item_id, text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).dropDuplicates([item_id]).orderBy(item_id)
    for i, t in rows.toLocalIterator():
        n = len(words(t))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += n
    if block:
        yield block


SCHEMA = "doc bigint, item bigint, longest int, covered int, item_words int, n_tiles int"


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, tile: int = 13) -> DataFrame:
    """One row per document and item that share a run of at least ``tile`` words.

    ``longest`` is the longest common run, ``covered`` the item's words in tiles,
    of ``item_words``. Null ids and texts take no part, repeated rows count
    once, items under ``tile`` words can't leak; no items or no documents give
    no rows. Whole texts are read, however long.
    """
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    found = None
    for rows in _blocks(items, item_id, item_text):
        block = Items(rows, tile)

        def f(b: dict[str, pa.Array], block: Items = block) -> dict[str, object]:
            out: dict[str, list] = {k: [] for k in ("doc", "item", "longest", "covered", "item_words", "n_tiles")}
            for d, t in zip(b["doc"], b["text"], strict=True):
                numbers, near = block.candidates(t.as_py())
                for i in sorted(near):
                    runs = [k for _, _, k in block.tiles(numbers, i)]
                    if runs:
                        for k, v in zip(out, (d.as_py(), i, runs[0], sum(runs), len(block.tokens[i]), len(runs)), strict=True):
                            out[k].append(v)
            return out

        part = map_columns(docs, f, SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], SCHEMA)
    return found.dropDuplicates(["doc", "item"])


def leak_report(found: DataFrame) -> DataFrame:
    """Per item: documents it leaked into, and the greatest share of it in one."""
    share = F.col("covered") / F.col("item_words")
    return found.groupBy("item").agg(F.count("*").alias("n_docs"), F.max(share).alias("most_covered"), F.max("longest").alias("longest"))
