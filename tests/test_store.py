from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph, search, store, sync
from marlstone.operators.store import Store
from marlstone.operators.versions import ConcurrentChange

T0 = dt.datetime(2024, 1, 1)
DOC = "filename string, modified_at timestamp, indexed_at timestamp"
CHUNK = "filename string, position int, content string, embedding array<float>"


def put(spark, s, name, texts):
    docs = spark.createDataFrame([(name, T0, T0)], DOC)
    s.replace_files(docs, spark.createDataFrame([(name, i, t, [float(i + 1), 1.0]) for i, t in enumerate(texts)], CHUNK))


def test_documents_come_and_go(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.documents().count() == 0 and s.get("k") is None and s.delete([]) == 0
    put(spark, s, "/a/b/x.md", ["one", "two"])
    put(spark, s, "/a/bc/y.md", ["three"])
    before = {r["filename"]: r["doc_id"] for r in s.documents().collect()}
    put(spark, s, "/a/b/x.md", ["other"])
    assert {r["filename"]: r["doc_id"] for r in s.documents().collect()} == before
    assert sorted(r["content"] for r in s.table("chunks").collect()) == ["other", "three"]
    assert s.delete_below("/a/b") == 1 and s.delete(["/a/bc/y.md", "none"]) == 1 and s.table("chunks").count() == 0
    s.set("k", "v")
    assert Store(spark, str(tmp_path / "s")).get("k") == "v"


def test_a_failed_write_changes_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    put(spark, s, "a.md", ["one"])
    docs = spark.createDataFrame([("a.md", T0, T0)], DOC)
    bad = spark.createDataFrame([("a.md", 0, "two", [1.0, 1.0])], CHUNK).withColumn("content", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        s.replace_files(docs, bad)
    assert [r["content"] for r in s.table("chunks").collect()] == ["one"]


def test_buckets_grow_with_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKETS", 2)
    monkeypatch.setattr(store, "FILES", 2)
    s = Store(spark, str(tmp_path / "s"))
    put(spark, s, "f0.md", ["text 0"])
    assert s.manifest()["buckets"] == 2
    docs = spark.createDataFrame([(f"f{i}.md", T0, T0) for i in range(1, 20)], DOC)
    s.replace_files(docs, spark.createDataFrame([(f"f{i}.md", 0, f"text {i}", [1.0]) for i in range(1, 20)], CHUNK))
    assert s.manifest()["buckets"] == 10 and {r["content"] for r in s.table("chunks").collect()} == {f"text {i}" for i in range(20)}
    put(spark, s, "f3.md", ["other"])
    assert s.table("chunks").count() == 20 and s.delete(["f0.md"]) == 1 and s.documents().count() == 19


def test_of_two_writers_the_second_fails(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    base = two.manifest()
    one.set("k", "1")
    with pytest.raises(ConcurrentChange):
        two._commit({**base, "values": {"k": "2"}})
    assert two.get("k") == "1"


def test_words_keep_the_greater_confidence(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    schema = "source_word string, target_word string, source_lang string, confidence double, source_document string"
    s.merge_words(spark.createDataFrame([("词", "word", "zh", 0.8, "a")], schema))
    s.merge_words(spark.createDataFrame([("词", "word", "zh", 0.6, "b"), ("表", "table", "zh", 1.0, "b")], schema))
    assert {(r["target_word"], r["confidence"], r["source_document"]) for r in s.table("word_mapping").collect()} == {("word", 0.8, "b"), ("table", 1.0, "b")}


def test_cascade_sets_targets_to_null(spark):
    chunks = spark.createDataFrame([(1, 10), (2, 20)], "id bigint, document_id bigint")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "chunk_id bigint, embedding array<float>")
    meta = spark.createDataFrame([(1,), (2,)], "chunk_id bigint")
    rel = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 2, None), (4, 2, 2)], "id bigint, source_chunk_id bigint, target_chunk_id bigint")
    left = store.cascaded(spark.createDataFrame([(10,)], "doc_id bigint"), chunks, vectors, meta, rel)
    assert {(r["id"], r["target_chunk_id"]) for r in left["code_relations"].collect()} == {(2, None), (3, None), (4, 2)}
    assert [left[t].count() for t in ("chunks", "vec_chunks", "code_metadata")] == [1, 1, 1]


def test_diff_and_counts(spark):
    seen = spark.createDataFrame([("/d/a", T0), ("/d/b", T0 + dt.timedelta(milliseconds=400)), ("/d/c", T0 + dt.timedelta(seconds=1)), ("/d/n", T0)], "filename string, modified_at timestamp")
    stored = spark.createDataFrame([("/d/a", T0), ("/d/b", T0), ("/d/c", T0), ("/d/gone", T0), ("/dx/stays", T0)], "filename string, modified_at timestamp")
    plan = sync.diff(seen, stored, "/d")
    assert {r["filename"]: r["action"] for r in plan.collect()} == {"/d/a": "skip", "/d/b": "skip", "/d/c": "update", "/d/n": "add", "/d/gone": "remove"}
    assert {r["action"] for r in sync.diff(seen, stored, "/d", force=True).collect()} == {"update", "add", "remove"}
    one = sync.counts(plan.withColumn("failed", F.col("filename") == "/d/n")).first().asDict()
    assert one == {"added": 0, "updated": 1, "removed": 1, "skipped": 2, "failed": 1, "indexed": 1}
    assert sync.request_files("a", "b,c", "d") == ("files", ["a"]) and sync.request_files(None, " b , ,c", None) == ("files", ["b", "c"])
    assert not sync.must_purge(None, "x", False) and sync.must_purge("y", "x", False) and not sync.must_purge("y", "x", True)


META = "id bigint, chunk_id bigint, symbol_name string, symbol_type string, language string, start_line int, end_line int, parent_symbol string, signature string"


def test_search_with_ties_filters_and_metadata(spark):
    docs = spark.createDataFrame([(1, "docs/b.md"), (2, "src/a.rs"), (3, "docs/sub/c.md")], "doc_id bigint, filename string")
    chunks = spark.createDataFrame([(i, i, 0, f"t{i}") for i in (1, 2, 3)] + [(1, 1, 0, "t1")], "id bigint, document_id bigint, position int, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [1.0, 0.0]), (9, None)], "chunk_id bigint, embedding array<float>")
    meta = spark.createDataFrame([(1, 2, "runFast", "function", "rust", 1, 2, None, "fn runFast()")], META)
    go = lambda **f: [r["document_name"] for r in search.vector_search(vectors, chunks, docs, meta, [1.0, 0.0], f.pop("k", 5), **f).orderBy("document_name").collect()]
    assert go() == ["docs/b.md", "docs/sub/c.md", "src/a.rs"] and go(k=1) == ["docs/b.md"]
    assert go(directory="docs/") == ["docs/b.md", "docs/sub/c.md"] and go(file_pattern="*.rs") == ["src/a.rs"] and go(directory="docs", file_pattern="c.*") == ["docs/sub/c.md"]
    named = search.symbol_search(meta, chunks, docs, "fast xx", 5)
    assert [r["similarity"] for r in named.collect()] == [1.0] and search.symbol_search(meta, chunks, docs, "ab", 5).count() == 0
    both = search.as_response(search.merged(search.vector_search(vectors, chunks, docs, meta, [1.0, 0.0]), named)).collect()
    assert len(both) == 3 and {r["metadata"]["symbol_name"] if r["metadata"] else None for r in both} == {None, "runFast"} and both[0]["similarity"] == "1.0000"
    assert search.batch_search(vectors, spark.createDataFrame([(7, [0.0, 1.0]), (8, [0.0, 0.0])], "query_id bigint, embedding array<float>"), 2).count() == 2


def test_relations_need_metadata(spark):
    rel = spark.createDataFrame([(1, 1, None, "calls", "f", None, 1.0), (2, 2, None, "calls", "f", None, 1.0), (1, 1, None, "calls", "f", None, 1.0)], "id bigint, source_chunk_id bigint, target_chunk_id bigint, relation_type string, target_name string, target_file string, confidence double")
    meta = spark.createDataFrame([(1, 1, "main", "function", "go", 1, 2, None, None)], META)
    chunks = spark.createDataFrame([(1, 5), (2, 5)], "id bigint, document_id bigint")
    docs = spark.createDataFrame([(5, "m.go")], "doc_id bigint, filename string")
    assert [(r["id"], r["source_name"], r["source_file"]) for r in graph.of_symbol(rel, meta, chunks, docs, "f", "incoming").collect()] == [(1, "main", "m.go")]
    assert graph.of_symbol(rel, meta, chunks, docs, "main", "outgoing", "imports").count() == 0 and graph.from_chunk(rel, 1).count() == 1
    with pytest.raises(ValueError):
        graph.of_symbol(rel, meta, chunks, docs, "")
