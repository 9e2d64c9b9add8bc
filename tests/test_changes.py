from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from marlstone.operators import changes as C
from marlstone.operators.versions import ConcurrentChange, Versions

T0 = dt.datetime(2024, 5, 1, 12)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def delta(spark, now, saved):
    a, b = (spark.createDataFrame(x, "k string, v bigint") for x in (now, saved))
    return sorted((r["k"], r["change"]) for r in C.delta(a, b, "k", "v").collect())


def test_delta_finds_each_change(spark):
    saved = [(f"k{i}", i) for i in range(500)] + [("n", None)]
    now = [(f"k{i}", i + (i == 7)) for i in range(1, 500)] + [("new", 1), ("n", 0), (None, 3)]
    assert delta(spark, now, saved) == [("k0", "removed"), ("k7", "updated"), ("n", "updated"), ("new", "added")]


def test_delta_of_equal_and_empty_tables(spark):
    same = [(f"k{i}", i) for i in range(50)] + [("n", None)]
    assert delta(spark, same, same) == []
    assert delta(spark, [], []) == []
    assert delta(spark, [("a", 1)], []) == [("a", "added")]
    assert delta(spark, [], [("a", None)]) == [("a", "removed")]


def test_only_differing_leaves_are_opened(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    other = rows.withColumn("v", F.when(F.col("k") == "5", -1).otherwise(F.col("v")))
    a, b = (C.leaf_digests(C.with_leaf(x, "k"), "k", "v") for x in (rows, other))
    found = lambda x, y: [r[0] for r in C.differing_leaves(C.side_by_side(x, y)).collect()]
    assert found(a, b) == [C.with_leaf(rows, "k").where("k = '5'").first()["__leaf"]]
    assert found(a, a) == [] and len(found(a, b.limit(0))) == a.count() > 1


def test_paths_are_spelt_alike(spark):
    df = spark.createDataFrame([("\\\\?\\D:\\kb\\a.md",), ("D:/kb//a.md",), ("D:\\kb/a.md",), ("//?/D:/kb/a.md",)], "f string")
    assert {r[0] for r in df.select(C.normal_path(F.col("f"))).collect()} == {"D:/kb/a.md"}


SCAN = "scan_id bigint, filename string, change string, modified_at timestamp, seen_at timestamp"
DOCS = "filename string, modified_at timestamp, indexed_at timestamp"
RUNS = "run_id bigint, started_at timestamp, finished_at timestamp, status string"


def test_files_to_process(spark):
    runs = spark.createDataFrame([(1, at(0), at(100), "ok"), (2, at(200), None, "crashed"), (3, at(400), at(500), "failed"), (4, at(900), None, "crashed"), (4, at(900), None, "crashed")], RUNS)
    docs = spark.createDataFrame([
        ("same", at(1), at(50)), ("older", at(9), at(50)), ("null", at(1), None), ("crash", at(1), at(400)), ("edge", at(1), at(500)),
        ("between", at(1), at(600)), ("endless", at(1), at(5000)), ("gone", at(1), at(50)), ("frac", at(1), at(50)), ("unseen", at(1), None),
    ], DOCS)
    scan = [(i, f, "present", m, at(1000)) for i, (f, m) in enumerate([
        ("same", at(1)), ("older", at(8)), ("null", at(1)), ("crash", at(1)), ("edge", at(1)), ("between", at(1)), ("endless", at(1)), ("new", at(3)), ("gone", at(1)),
        ("frac", at(1) + dt.timedelta(milliseconds=300)),
    ])]
    scan += [(50, "gone", "deleted", None, at(2000)), (51, "new", "deleted", None, at(10)), (7, "new", "present", at(3), at(1000)), (60, None, "present", at(1), at(1))]
    got = {r["filename"]: r["change"] for r in C.files_to_process(spark.createDataFrame(scan, SCAN), docs, runs).collect()}
    assert got == {"older": "updated", "null": "added", "crash": "added", "edge": "added", "endless": "added", "new": "added"}


SCHEMA = "k string, v bigint"


def changes(df):
    return sorted((r["k"], r["change"]) for r in df.collect())


def test_published_tree_survives_a_failed_run(spark, tmp_path):
    p = C.Published(spark, str(tmp_path / "state"), "k", "v")
    now = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], SCHEMA)
    assert p.current() is None and changes(p.advance(now)) == [("a", "added"), ("b", "added")]
    first = p.current()
    later = spark.createDataFrame([("a", 1), ("b", 3)], SCHEMA)
    with pytest.raises(Exception, match="boom"):
        p.advance(later.withColumn("v", F.raise_error(F.lit("boom")).cast("bigint")))
    assert p.current() == first and changes(p.output()) == [("a", "added"), ("b", "added")]
    assert changes(p.advance(later)) == [("b", "updated")] and p.current() != first
    assert changes(p.advance(later)) == [] and changes(p.advance(later.limit(0))) == [("a", "removed"), ("b", "removed")]
    assert p.saved().columns == ["k", "v"] and p.saved().count() == 0


@pytest.mark.parametrize("step", ["_write_tree", "before", "after"])
def test_a_run_that_dies_skips_and_repeats_nothing(spark, tmp_path, monkeypatch, step):
    p = C.Published(spark, str(tmp_path / "state"), "k", "v")
    p.start(spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA))
    later = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], SCHEMA)
    commit = p.versions.commit

    def dies(*a):
        if step == "after":
            commit(*a)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(*((p, "_write_tree", dies) if step == "_write_tree" else (p.versions, "commit", dies)))
        with pytest.raises(RuntimeError, match="lost"):
            p.advance(later)
    again = C.Published(spark, str(tmp_path / "state"), "k", "v")
    # output and tree are live together: once committed, the changes stand in the output and don't come again
    assert changes(again.output()) == ([("b", "updated"), ("c", "added")] if step == "after" else [])
    assert changes(again.advance(later)) == ([] if step == "after" else [("b", "updated"), ("c", "added")])


def test_of_the_saved_side_only_differing_folders_are_read(spark, tmp_path):
    p = C.Published(spark, str(tmp_path / "state"), "k", "v")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    p.start(rows)
    leaf = C.with_leaf(rows, "k").where("k = '77'").first()["__leaf"]
    held = p.root + "/" + p.current() + "/saved"
    for folder in os.listdir(held):
        if folder.startswith("__top=") and folder != f"__top={leaf >> C.FAN_BITS * C.DEPTH - C.FOLDER_BITS}":
            for name in os.listdir(f"{held}/{folder}"):
                os.remove(f"{held}/{folder}/{name}")
    assert changes(p.advance(rows.withColumn("v", F.when(F.col("k") == "77", 0).otherwise(F.col("v"))))) == [("77", "updated")]


def test_of_two_writers_the_second_is_told(spark, tmp_path):
    v, w = Versions(spark, str(tmp_path / "v")), Versions(spark, str(tmp_path / "v"))
    assert v.current() == (0, None) and v.commit("one", 0) == 1
    assert w.commit("two", w.current()[0]) == 2
    with pytest.raises(ConcurrentChange):
        v.commit("three", 1)
    assert v.current() == (2, "two")
    for n in range(2, 30):
        v.commit(f"v{n}", n)
    assert v.current() == (30, "v29") and len(v.numbers()) == 20
