"""Near-duplicate records with small edits.

One-permutation hashing: each text's set of character substrings is hashed once,
the hash space is cut into bins, and each bin keeps its least value; empty bins
borrow from a filled one chosen by an independent hash per bin and attempt
(optimal densification). Bands of bins give buckets. In a bucket the members like
its hub are linked to it (a star); members unlike it are held against the others
under a sketch of 128 bits that comes with them. Leaves of a large bucket meet
through their hub only. A second sketch, then the exact similarity decide.

Copies of a text are one node throughout. Records of bands are exchanged packed,
in parts whose number follows the number of rows; keys that a sample shows to be
hot are split into blocks, of which every two meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.arrow import map_columns
from marlstone.session import written

#: A pair at similarity 0.7 shares none of 28 bands of 4 with probability 0.0005; the bins beyond serve the sketch.
BINS, ROWS, BANDS = 128, 4, 28
#: Sketch bits that agree: a pair at similarity 0.7 has 108.8 of 128 on average, with a deviation of 4.
AGREE = 95
#: Bits of a bin in the second sketch, and bins that agree in all: a pair at 0.7 has 94.4 on average, with a deviation of 5.
PLANES, SAME = 3, 75
#: Members beyond which leaves of a bucket's hub meet through the hub; records of a part; members of a block of a hot key; texts sampled for hot keys.
STAR, PART_RECORDS, CELL, SAMPLE = 256, 400_000, 30_000, 20_000
#: Needed ids up to this number are broadcast (8 bytes each); beyond, a shuffle join.
BROADCAST_ROWS = 1_000_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _mix(h: np.ndarray) -> np.ndarray:
    """A finaliser with the constants of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _donors() -> np.ndarray:
    """For bin and attempt, the bin to borrow from: the same for every text."""
    bins, tries = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, 65, dtype=np.uint64), indexing="ij")
    return (_mix(bins * np.uint64(1_000_003) + tries * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)


DONORS = _donors()


def signatures(texts: list[str], width: int = 5) -> np.ndarray:
    """``len(texts) x BINS`` least hashes of the texts' substrings of ``width`` characters.

    All texts of a batch are hashed as one array. Each has at least ``width`` characters.
    """
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    n = len(joined) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + joined[i : i + n]
    h = _mix(h)
    owner = np.repeat(np.arange(len(texts)), lengths)[:n]
    inside = np.arange(n) <= (starts + lengths - width)[owner]
    h, owner = h[inside], owner[inside]
    out = np.full(len(texts) * BINS, _FULL)
    np.minimum.at(out, owner * BINS + (h >> np.uint64(57)).astype(np.int64), h << np.uint64(7))
    out = out.reshape(len(texts), BINS)
    filled = out != _FULL
    source = out.copy()
    row, col = np.nonzero(~filled)
    for k in range(DONORS.shape[1]):
        if not len(row):
            break
        donor = DONORS[col, k]
        ok = filled[row, donor]
        out[row[ok], col[ok]] = source[row[ok], donor[ok]]
        row, col = row[~ok], col[~ok]
    for r, c in zip(row, col, strict=True):  # nearly empty texts: the next filled bin
        out[r, c] = source[r, np.flatnonzero(filled[r])[0]]
    return out


def bands_and_sketch(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and two 64-bit words of one bit a bin."""
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), np.uint64(b + 1))
        for r in range(ROWS):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
        keys[:, b] = h
    return keys.view(np.int64), planes(sig, 1)


def planes(sig: np.ndarray, n: int = PLANES) -> np.ndarray:
    """``n`` bits of each bin's least hash: two 64-bit words a plane, plane by plane."""
    h = _mix(sig)
    bits = [np.packbits((h >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64) for k in range(n)]
    return np.concatenate(bits, axis=1) if len(sig) else np.zeros((0, 2 * n), np.int64)


def _parts(texts: list[str], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Signatures of any number of texts, some at a time, with the place of the first."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or (end - at < 2000 and size + len(texts[end]) <= 2_000_000)):
            size, end = size + len(texts[end]), end + 1
        yield at, signatures(texts[at:end], width)
        at = end


def _node_of(texts: Iterable[str]) -> list[int]:
    return [xxhash.xxh3_128_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]


def _low(h: list[int], shift: int = 0) -> np.ndarray:
    return np.array([x >> shift & 0xFFFFFFFFFFFFFFFF for x in h], np.uint64).view(np.int64)


def _usable(rows: DataFrame, row_id: str, text: str, least: int) -> DataFrame:
    return rows.select(F.col(row_id).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= least))


W = [f"w{k}" for k in range(2 * PLANES)]


def text_nodes(rows: DataFrame, row_id: str, text: str, least: int, width: int = 5) -> DataFrame:
    """``id, node, more`` and the words of ``planes``: 128 bits of a hash of the normalised text, so equal texts share them."""

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        kept = [(i, t) for i, t in zip(b["id"].to_pylist(), map(normal, b["text"].to_pylist()), strict=True) if len(t) >= width]
        texts = {t: k for k, t in enumerate(dict.fromkeys(t for _, t in kept))}
        of = np.array([texts[t] for _, t in kept], np.int64)
        h = _node_of(texts)
        w = np.concatenate([np.zeros((0, len(W)), np.int64), *[planes(s) for _, s in _parts(list(texts), width)]])
        return {"id": [i for i, _ in kept], "node": _low(h)[of], "more": _low(h, 64)[of], **{c: w[of, k] for k, c in enumerate(W)}}

    return map_columns(_usable(rows, row_id, text, least), f, "id bigint, node bigint, more bigint, " + ", ".join(f"{c} bigint" for c in W))


#: One band of one text as it is exchanged: packed, as a row of its own would double it.
RECORD = np.dtype([("key", "<u4"), ("node", "<i8"), ("s1", "<u8"), ("s2", "<u8")])


def _keys(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [bands_and_sketch(s) for _, s in _parts(texts, width)]
    if not parts:
        return np.zeros((0, BANDS), np.uint64), np.zeros((0, 2), np.int64)
    return np.concatenate([k for k, _ in parts]).view(np.uint64), np.concatenate([s for _, s in parts])


def hot_keys(rows: DataFrame, n: int, row_id: str, text: str, least: int, width: int = 5) -> dict[int, int]:
    """Band keys that, by a sample of about SAMPLE texts, have more than CELL members, and over how many blocks they go.

    ``n`` is the number of rows. Only the way of a record depends on it, not
    whether a pair is found.
    """
    if n <= CELL:
        return {}
    step = max(1, n // SAMPLE)
    seen = max(40, CELL // step)

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        texts = list({t: None for t in map(normal, b["text"].to_pylist()) if len(t) >= width})
        return {"key": _keys(texts, width)[0].view(np.int64).ravel()}

    some = _usable(rows, row_id, text, least).where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(step)) == 0)
    found = map_columns(some, f, "key bigint").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= seen).collect()  # at most some thousands, as a key takes 40 of the sample
    return {k & 0xFFFFFFFFFFFFFFFF: max(2, -(-m * step // CELL)) for k, m in found}


def band_records(rows: DataFrame, row_id: str, text: str, least: int, n: int, hot: dict[int, int], width: int = 5) -> DataFrame:
    """``part, records``: the bands of each distinct text of a batch, packed by part; parts grow with ``n``.

    A hot key's members are split into blocks by their node; every two blocks
    make a bucket of their own, so each pair still meets and no bucket is
    beyond two blocks.
    """
    n_parts = max(1, -(-n * BANDS // PART_RECORDS))
    names = np.array(sorted(hot), np.uint64)

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        texts = list({t: None for t in map(normal, b["text"].to_pylist()) if len(t) >= width})
        keys, sketch = _keys(texts, width)
        key, of = keys.ravel(), np.repeat(np.arange(len(texts)), BANDS)
        node = _low(_node_of(texts))
        if len(names):
            at = np.minimum(np.searchsorted(names, key), len(names) - 1)
            split = np.flatnonzero(names[at] == key)
            made_key, made_of = [np.delete(key, split)], [np.delete(of, split)]
            for x in split.tolist():
                blocks = hot[int(key[x])]
                own = int(node[of[x]].view(np.uint64) % np.uint64(blocks))
                other = np.delete(np.arange(blocks, dtype=np.uint64), own)
                low, high = np.minimum(other, np.uint64(own)), np.maximum(other, np.uint64(own))
                made_key.append(_mix(key[x] + low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xBF58476D1CE4E5B9)))
                made_of.append(np.full(len(other), of[x]))
            key, of = np.concatenate(made_key), np.concatenate(made_of)
        part = (key >> np.uint64(32)) % np.uint64(n_parts)
        records = np.zeros(len(key), RECORD)
        records["key"], records["node"] = key & np.uint64(0xFFFFFFFF), node[of]
        records["s1"], records["s2"] = sketch[of].view(np.uint64).T
        order = np.argsort(part, kind="stable")
        part, records = part[order], records[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        return {"part": part[first].astype(np.int64), "records": [x.tobytes() for x in np.split(records, first[1:])] if len(part) else []}

    return map_columns(_usable(rows, row_id, text, least), f, "part bigint, records binary").repartition(n_parts, "part")


def _agree(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    return 128 - (np.bitwise_count(s["s1"] ^ t["s1"]).astype(np.int16) + np.bitwise_count(s["s2"] ^ t["s2"]))


def bucket_links(records: np.ndarray, most: int = STAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``p, q, star`` of the candidate links in the buckets of ``records``.

    A bucket's hub is its least node, and members whose sketch agrees with the
    hub's are its leaves. Leaves of a bucket beyond ``most`` members aren't held
    against each other here: their links to the hub come out marked, for
    ``closed``. All other pairs of a bucket are held against each other under
    the sketch, offset by offset over all buckets at once.
    """
    r = records[np.lexsort((records["node"], records["key"]))]
    if len(r):
        r = r[np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["node"][1:] != r["node"][:-1])]]
    start = np.flatnonzero(np.r_[True, r["key"][1:] != r["key"][:-1]]) if len(r) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(r)])
    keep = np.repeat(size > 1, size)
    r, size = r[keep], size[size > 1]
    start = np.cumsum(size) - size
    hub, total = np.repeat(start, size), np.repeat(size, size)
    place = np.arange(len(r)) - hub
    near = (_agree(r, r[hub]) >= AGREE) & (place > 0)
    found = [(hub[near], np.flatnonzero(near), total[near] > most)]
    left, d = np.flatnonzero(place > 0), 0
    waits = near & (total > most)
    while len(left):
        d += 1
        left = left[place[left] + d < total[left]]
        i = left[~(waits[left] & waits[left + d])]
        i = i[_agree(r[i], r[i + d]) >= AGREE]
        if len(i):
            found.append((i, i + d, np.zeros(len(i), bool)))
    p, q, star = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = r["node"][p], r["node"][q]
    order = np.lexsort((~star, b, a))
    a, b, star = a[order], b[order], star[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[first], b[first], star[first]


def links(bands: DataFrame, most: int = STAR) -> DataFrame:
    """Distinct ``p, q, star`` of candidate links (``bucket_links``) from ``band_records``."""

    def f(t: pa.Table) -> pa.Table:
        p, q, star = bucket_links(np.frombuffer(b"".join(t["records"].to_pylist()), RECORD), most)
        return pa.table({"p": p, "q": q, "star": star})

    return bands.groupBy("part").applyInArrow(f, "p bigint, q bigint, star boolean").groupBy("p", "q").agg(F.bool_or("star").alias("star"))


def _same_bins(x: str, y: str) -> Column:
    """Whether so many bins agree in all planes that the similarity may reach the threshold."""
    c = lambda side, k: F.col(f"{side}.{W[k]}" if side else W[k])
    halves = []
    for h in range(2):
        differ = F.lit(0).cast("bigint")
        for k in range(h, len(W), 2):
            differ = differ.bitwiseOR(c(x, k).bitwiseXOR(c(y, k)))
        halves.append(F.bit_count(differ))
    return halves[0] + halves[1] <= BINS - SAME


def sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``p, q, star`` of the links whose planes agree too."""
    x = pairs.join(sketches.select(F.col("node").alias("p"), F.struct(*W).alias("x")), "p")
    both = x.join(sketches.select(F.col("node").alias("q"), F.struct(*W).alias("y")), "q")
    return both.where(F.col("star") | _same_bins("x", "y")).select("p", "q", "star", _same_bins("x", "y").alias("near"))


def closed(stars: DataFrame, sketches: DataFrame) -> DataFrame:
    """``p, q``: pairs of leaves of one hub, for hubs of large buckets, whose planes agree."""
    leaf = stars.where("star").select(F.col("p").alias("hub"), F.col("q").alias("node")).join(sketches, "node")
    x, y = leaf.alias("x"), leaf.alias("y")
    return x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.node") < F.col("y.node")) & _same_bins("x", "y")).select(
        F.col("x.node").alias("p"), F.col("y.node").alias("q")
    )


def candidates(rows: DataFrame, nodes: DataFrame, row_id: str, text: str, least: int) -> DataFrame:
    """Distinct pairs of nodes ``a < b`` that may be alike."""
    n = nodes.count()
    sketches = nodes.groupBy("node").agg(*[F.min_by(c, "more").alias(c) for c in W])
    hot = hot_keys(rows, n, row_id, text, least)
    first = written(sketched(links(band_records(rows, row_id, text, least, n, hot), STAR), sketches), "links")
    pairs = first.where("near").select("p", "q").unionByName(closed(first, sketches))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def with_texts(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """``a, b, text_a, text_b``: one stored text for each node that a pair names."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = written(nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "wanted")
    small = one.count() <= BROADCAST_ROWS
    content = (
        rows.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(one) if small else one, "id").dropDuplicates(["node"]).select("node", "text")
    )
    a, b = (content.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b")


def verified(pairs: DataFrame, threshold: float, width: int = 5) -> DataFrame:
    """``a, b, similarity`` of the pairs whose exact similarity reaches ``threshold``."""

    def f(x: dict[str, pa.Array]) -> dict[str, object]:
        kept: dict[str, list] = {"a": [], "b": [], "similarity": []}
        cache: dict[str, set[str]] = {}

        def grams(t: str) -> set[str]:
            if t not in cache:
                n = normal(t)
                cache[t] = {n[i : i + width] for i in range(len(n) - width + 1)}
            return cache[t]

        for a, b, p, q in zip(*(x[k].to_pylist() for k in ("a", "b", "text_a", "text_b")), strict=True):
            if len(cache) > 2000:
                cache.clear()
            s, t = grams(p), grams(q)
            common = len(s & t)
            total = len(s) + len(t) - common
            if total and common >= threshold * total:
                kept["a"].append(a)
                kept["b"].append(b)
                kept["similarity"].append(common / total)
        return kept

    return map_columns(pairs.select("a", "b", "text_a", "text_b"), f, "a bigint, b bigint, similarity double")


def near_pairs(rows: DataFrame, row_id: str, text: str, threshold: float = 0.7, least: int = 200) -> DataFrame:
    """``a, b, similarity``: ids ``a < b`` of rows whose texts are alike, copies included.

    Lower case, white space as one space, trimmed; similarity of the sets of
    substrings of 5 characters. Null ids, null texts and texts under ``least``
    characters take no part; a repeated id counts once; nothing gives no rows.
    """
    nodes = written(text_nodes(rows, row_id, text, least).dropDuplicates(["id"]), "nodes")
    linked = verified(with_texts(candidates(rows, nodes, row_id, text, least), nodes, rows, row_id, text), threshold)
    who = nodes.select("node", "id")
    across = (
        linked.join(who.select(F.col("node").alias("a"), F.col("id").alias("i")), "a")
        .join(who.select(F.col("node").alias("b"), F.col("id").alias("j")), "b")
        .select("i", "j", "similarity")
    )
    x, y = nodes.alias("x"), nodes.alias("y")
    copies = x.join(
        y, (F.col("x.node") == F.col("y.node")) & (F.col("x.more") == F.col("y.more")) & (F.col("x.id") < F.col("y.id"))
    ).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.lit(1.0).alias("similarity"))
    return across.unionByName(copies).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "similarity")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the nodes of ``links`` (a, b) and the least node of each one's component.

    A round hooks a node, and the node that is its label, to the least label
    across its links, then takes the label of its label; rounds go on until
    nothing moves and grow with the logarithm of a component's length. Each is
    written, so it survives lost executors.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        there = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b")
        here = there.join(labels.select(F.col("node").alias("a"), F.col("label").alias("own")), "a")
        hooks = here.select(F.explode(F.array("a", "own")).alias("node"), "seen").groupBy("node").agg(F.min("seen").alias("seen"))
        hooked = written(labels.join(hooks, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")), "labels")
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(hooked.join(above, "label").select("node", "old", F.col("up").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where(F.col("old") != F.col("label")).limit(1).count():
            return labels


def groups(rows: DataFrame, row_id: str, text: str, threshold: float = 0.7, least: int = 200) -> DataFrame:
    """``id, group_id, n_links``: each row's group of like texts, by its least id.

    Groups are the components of the links that pass the exact check, of any
    length; ``n_links`` counts those of a row's text to other texts. A row alone is its own group.
    """
    nodes = written(text_nodes(rows, row_id, text, least).dropDuplicates(["id"]), "nodes")
    links = written(verified(with_texts(candidates(rows, nodes, row_id, text, least), nodes, rows, row_id, text), threshold).select("a", "b"), "links")
    first = nodes.groupBy("node").agg(F.min("id").alias("own"))
    labels = components(links)
    ids = labels.join(first, "node").groupBy("label").agg(F.min("own").alias("least"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    found = labels.join(ids, "label").join(degree, "node").select("node", "least", "n_links")
    return (
        nodes.join(first, "node").join(found, "node", "left")
        .select("id", F.coalesce("least", "own").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
