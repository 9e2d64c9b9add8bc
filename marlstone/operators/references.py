"""References to records that do not exist.

Distinct non-null foreign keys are anti-joined with the parent keys first, so a
hot key is one row by then; only the keys that were found missing are joined
back to the references. Adaptive execution splits a hot missing key there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """A kind of reference: the child's key, where it applies, the parent's key."""

    kind: str
    key: Column
    parent: DataFrame
    parent_key: str
    when: Column | None = None


def orphans(child: DataFrame, row_id: str, references: Sequence[Reference], keep: Sequence[str] = ()) -> DataFrame:
    """One row per dangling reference: ``row_id``, ``ref_kind``, the ``keep`` columns.

    A null key is no reference; a null parent key matches nothing; a repeated
    child row (same id) counts once; an empty parent makes every reference
    dangle; an empty child gives no rows. Kinds that share a parent share one
    anti-join.
    """
    spaces: list[tuple[DataFrame, str, list[Reference]]] = []
    for r in references:
        same = next((s for s in spaces if s[0] is r.parent and s[1] == r.parent_key), None)
        if same:
            same[2].append(r)
        else:
            spaces.append((r.parent, r.parent_key, [r]))
    found = None
    for parent, parent_key, refs in spaces:
        pairs = F.array(*[
            F.struct(F.lit(r.kind).alias("ref_kind"), (r.key if r.when is None else F.when(r.when, r.key)).alias("__key"))
            for r in refs
        ])
        rows = (
            child.select(F.col(row_id), *keep, F.explode(F.filter(pairs, lambda p: p["__key"].isNotNull())).alias("__ref"))
            .select(F.col(row_id), *keep, "__ref.ref_kind", "__ref.__key")
        )
        known = parent.select(F.col(parent_key).alias("__key")).where(F.col("__key").isNotNull())
        missing = rows.select("__key").distinct().join(known, "__key", "left_anti")
        part = rows.join(missing, "__key").select(row_id, "ref_kind", *keep)
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no references given")
    return found.dropDuplicates([row_id, "ref_kind"])


def orphan_report(child: DataFrame, row_id: str, references: Sequence[Reference], at: str) -> DataFrame:
    """Per kind and month of ``at``: ``n_refs`` and ``n_orphans`` (a null time is its own period)."""
    lost = orphans(child, row_id, references, [at])
    month = F.date_format(F.col(at), "yyyy-MM").alias("period")
    kinds = F.array(*[F.when((r.key.isNotNull()) & (F.lit(True) if r.when is None else r.when), F.lit(r.kind)) for r in references])
    once = child.select(F.col(row_id), month, F.array_compact(kinds).alias("kinds")).dropDuplicates([row_id])
    total = once.select("period", F.explode("kinds").alias("ref_kind")).groupBy("ref_kind", "period").agg(F.count("*").alias("n_refs"))
    bad = lost.select("ref_kind", month).groupBy("ref_kind", "period").agg(F.count("*").alias("n_orphans"))
    # periods are few: both sides are aggregates by kind and month
    same = (total["ref_kind"] == bad["ref_kind"]) & total["period"].eqNullSafe(bad["period"])
    return total.join(bad, same, "left").select(
        total["ref_kind"], total["period"], "n_refs", F.coalesce("n_orphans", F.lit(0)).cast("bigint").alias("n_orphans")
    )


def relation_references(relations: DataFrame, chunks: DataFrame, metadata: DataFrame) -> list[Reference]:
    """The three references of ``code_relations``: source and target chunk, and the
    target's name where no chunk is known. Imports name modules, not symbols."""
    by_name = F.col("target_chunk_id").isNull() & F.col("relation_type").isin("calls", "inherits")
    return [
        Reference("source", F.col("source_chunk_id"), chunks, "id"),
        Reference("target", F.col("target_chunk_id"), chunks, "id"),
        Reference("name", F.col("target_name"), metadata, "symbol_name", by_name),
    ]
