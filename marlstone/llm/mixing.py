"""Mixing sources to target weights.

Documents are counted in tokens of a public tokenizer. The mixture is as large
as it can be with all shares on target; where a larger one is asked for, sources
too small for their share give all that their cap of repeats allows, and the
rest is shared out in proportion. A low-discrepancy sequence (van der Corput) is mapped through
the cumulative weights and names the source of each slot, so every stretch of
the mixture has nearly the shares of the whole; a source's shuffled documents,
laid end to end and cut into blocks of equal tokens, fill its slots in order.

Running sums go in two steps, within buckets of bounded size and over the
buckets' totals, so a source with a third of all rows is no single task.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.arrow import map_columns
from marlstone.session import written

#: The vocabulary unless a parameter says otherwise, a path or a file of the public package; tokens of a block; tokens of a bucket of running sums.
VOCABULARY = os.environ.get("MARLSTONE_VOCABULARY", "byte_bpe_50k.tiktoken")
BLOCK_TOKENS, BUCKET_TOKENS = 4_096, 20_000_000
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """The vocabulary's encoder, once a worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        own = os.path.join(os.path.dirname(public_tokenizers.__file__), path)  # a path from the root stands as it is
        with open(own, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a whole text."""
    return len(_encoder(path).encode_ordinary(text))


def token_counts(documents: DataFrame, doc_id: str, text: str, source: str, path: str = VOCABULARY) -> DataFrame:
    """``doc, source, tokens``; null and empty texts have none and are left out, repeated rows count once."""

    def f(b: dict[str, pa.Array]) -> dict[str, object]:
        return {"doc": b["doc"], "source": b["source"], "tokens": [count_tokens(t.as_py(), path) for t in b["text"]]}

    rows = documents.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = rows.where(F.col("doc").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0))
    return map_columns(rows, f, "doc bigint, source string, tokens bigint").dropDuplicates(["doc"])


@dataclass(frozen=True)
class Plan:
    """What a source gives: tokens wanted, tokens it has, its target and cap."""

    source: str
    target: float
    max_repeats: int
    has: int
    wanted: int


def plan(targets: list[tuple[str, float, int]], has: dict[str, int], total: int | None = None) -> list[Plan]:
    """Tokens of each source so that shares come as near to the targets as the caps allow.

    ``total`` is the size of the mixture; by default the largest in which no source
    that has documents is short. What short sources can't give is shared among the others
    in proportion to their targets, until all fit or all are at their caps.
    """
    cap = {s: has.get(s, 0) * max(0, r) for s, _, r in targets}
    share = {s: max(0.0, t) for s, t, _ in targets}
    left = min(largest_exact_total(targets, has) if total is None else total, sum(c for s, c in cap.items() if share[s] > 0))
    wanted = dict.fromkeys(share, 0)
    free = {s for s in share if share[s] > 0 and cap[s] > 0}
    while free and left > 0:
        weight = sum(share[s] for s in free)
        full = {s for s in free if left * share[s] / weight >= cap[s]}
        if not full:
            for s in free:
                wanted[s] = int(left * share[s] / weight)
            break
        for s in full:
            wanted[s] = cap[s]
            left -= cap[s]
        free -= full
    return [Plan(s, t, r, has.get(s, 0), wanted[s]) for s, t, r in targets]


def largest_exact_total(targets: list[tuple[str, float, int]], has: dict[str, int]) -> int:
    """The largest mixture in which every source that has documents gets its share, those without left aside."""
    able = [(t, has[s] * r) for s, t, r in targets if t > 0 and r > 0 and has.get(s)]
    weight = sum(t for t, _ in able)
    return min((int(cap * weight / t) for t, cap in able), default=0)


def _order(*key: Column) -> Column:
    return F.xxhash64(*key)


def _laid_out(counts: DataFrame, wanted: list[Plan]) -> DataFrame:
    """Each use of a document with its place ``start`` in its source, in tokens; shuffled anew each pass."""
    spark = counts.sparkSession
    rows = [(p.source, p.wanted, p.has, -(-p.wanted // p.has), max(1, p.has // BUCKET_TOKENS)) for p in wanted if p.wanted]
    plans = spark.createDataFrame(rows, "source string, wanted bigint, has bigint, passes int, buckets int")
    uses = (
        counts.join(F.broadcast(plans), "source")  # a row a source of the target table
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("at", _order("doc", "pass"))
        .withColumn("bucket", F.floor(F.shiftrightunsigned("at", 11) / F.lit(float(1 << 53)) * F.col("buckets")).cast("int"))
    )
    sizes = uses.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("source", "pass", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("tokens").over(
        Window.partitionBy("source", "pass", "bucket").orderBy(F.shiftrightunsigned("at", 1), "doc").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        uses.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["source", "pass", "bucket"])
        .select("source", "doc", "pass", "tokens", "wanted", (F.col("before") + F.col("inside")).alias("start"))
    )


#: Bits of a slot's number: 2**48 slots of BLOCK_TOKENS.
SLOT_BITS = 48


def van_der_corput(n: Column) -> Column:
    """The bits of ``n`` mirrored at the point: 0, 1/2, 1/4, 3/4, ... for 0, 1, 2, 3, ..."""
    bits = F.reverse(F.lpad(F.bin(n), SLOT_BITS, "0"))
    return F.conv(bits, 2, 10).cast("double") / F.lit(float(1 << SLOT_BITS))


def schedule(spark, wanted: list[Plan], block: int = BLOCK_TOKENS, run: int = 1 << 16) -> DataFrame:
    """``slot, source, rank``: the source of each slot, and which of its blocks stands there."""
    need = [(p.source, -(-p.wanted // block)) for p in wanted if p.wanted]
    total = sum(n for _, n in need)
    edges, upto = [], 0.0
    for s, n in need:
        edges.append((s, upto, upto + n / total))
        upto += n / total
    if not total:
        return spark.createDataFrame([], "slot bigint, source string, rank bigint")
    point = van_der_corput(F.col("slot"))
    pick = F.lit(edges[-1][0])
    for s, _, high in reversed(edges[:-1]):
        pick = F.when(F.col("point") < high, F.lit(s)).otherwise(pick)
    # a few slots more than blocks, as a source's count in the sequence is off by its discrepancy
    spare = int(4 * len(need) * max(1, total.bit_length()))
    if total + spare >= 1 << SLOT_BITS:
        raise ValueError("more slots than SLOT_BITS can number")
    slots = spark.range(total + spare).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("source", pick)
    slots = slots.withColumn("run", F.floor(F.col("slot") / run))
    sizes = slots.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("source", "run", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    return slots.withColumn("inside", inside).join(F.broadcast(starts) if total < 1 << 30 else starts, ["source", "run"]).select(
        "slot", "source", (F.col("before") + F.col("inside")).alias("rank")
    )


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """``slot, source, doc, pass, tokens``: every use of a document and the slot where it begins.

    A use belongs to the mixture when its middle lies within its source's wanted
    tokens, so a source is off by half a document at most, and no document is
    used more than its source's cap. Sources without documents, target or cap
    give nothing; the share reached is in ``shares``.
    """
    spark = documents.sparkSession
    named = [(r[0], float(r[1] or 0.0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).distinct().orderBy("source").collect()]
    counts = written(token_counts(documents.where(F.col(source).isin([s for s, _, _ in named])), doc_id, text, source, path), "tokens")
    has = {r[0]: r[1] for r in counts.groupBy("source").agg(F.sum("tokens")).collect()}  # a row a source of the target table
    wanted = plan(named, has, total)
    if not any(p.wanted for p in wanted):
        return spark.createDataFrame([], "slot bigint, source string, doc bigint, pass int, tokens bigint")
    chosen = _laid_out(counts, wanted).where(F.col("start") * 2 + F.col("tokens") <= F.col("wanted") * 2)
    blocks = chosen.withColumn("rank", F.floor(F.col("start") / BLOCK_TOKENS))
    return blocks.join(schedule(spark, wanted), ["source", "rank"], "left").select("slot", "source", "doc", "pass", "tokens")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target, tokens, share reached, documents, and the most uses of one."""
    uses = mixture.groupBy("source", "doc").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    per = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    want = targets.select("source", "target_share", "max_repeats").distinct()
    held = want.join(per, "source", "left").select(
        "source", "target_share", "max_repeats", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("tokens", "n_docs", "most_uses")]
    )
    whole = Window.partitionBy(F.lit(0))  # over a row a source
    return held.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), F.lit(0.0)))
