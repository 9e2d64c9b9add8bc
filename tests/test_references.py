from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import references as R

REL = "id bigint, source_chunk_id bigint, target_chunk_id bigint, relation_type string, target_name string, created_at timestamp, ref_kind string"


def tables(spark, rel, chunks, names):
    r = spark.createDataFrame(rel, REL)
    c = spark.createDataFrame([(x,) for x in chunks], "id bigint")
    m = spark.createDataFrame([(x,) for x in names], "symbol_name string")
    return r, R.relation_references(r, c, m)


def found(spark, rel, chunks, names):
    r, refs = tables(spark, rel, chunks, names)
    return sorted(tuple(x) for x in R.orphans(r.drop("ref_kind"), "id", refs).collect())


def test_each_kind(spark):
    rel = [
        (1, 10, 11, "calls", "a", None, "x"), (2, 99, None, "calls", "a", None, "x"), (3, 10, 98, "imports", "b", None, "x"),
        (4, 10, None, "calls", "missing", None, "x"), (5, 10, None, "imports", "missing", None, "x"), (6, None, None, "inherits", None, None, "x"),
        (6, None, None, "inherits", None, None, "x"), (4, 10, None, "calls", "missing", None, "x"), (7, 10, None, "inherits", "A", None, "x"),
    ]
    assert found(spark, rel, [10, 11, 11, None], ["a", None]) == [(2, "source"), (3, "target"), (4, "name"), (7, "name")]


def test_empty_tables(spark):
    assert found(spark, [], [1], ["a"]) == []
    assert found(spark, [(1, 1, 2, "calls", "a", None, "x")], [], []) == [(1, "source"), (1, "target")]


def test_hot_missing_key_is_kept_whole(spark):
    r = spark.range(5000).select(
        F.col("id"), F.lit(1).cast("bigint").alias("source_chunk_id"), F.when(F.col("id") % 3 == 0, 77).cast("bigint").alias("target_chunk_id"),
        F.lit("calls").alias("relation_type"), F.lit("gone").alias("target_name"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    c = spark.createDataFrame([(1,)], "id bigint")
    m = spark.createDataFrame([("a",)], "symbol_name string")
    got = R.orphans(r, "id", R.relation_references(r, c, m)).groupBy("ref_kind").count().collect()
    assert {x[0]: x[1] for x in got} == {"target": 1667, "name": 3333}


def test_report_counts_by_month(spark):
    import datetime as dt

    rel = [(1, 1, None, "imports", "a", dt.datetime(2024, 1, 5), "x"), (2, 9, None, "imports", "a", dt.datetime(2024, 1, 6), "x"), (3, 9, None, "imports", "a", None, "x")]
    r, refs = tables(spark, rel, [1], [])
    got = {(x["ref_kind"], x["period"]): (x["n_refs"], x["n_orphans"]) for x in R.orphan_report(r.drop("ref_kind"), "id", refs, "created_at").collect()}
    assert got == {("source", "2024-01"): (2, 1), ("source", None): (1, 1)}
