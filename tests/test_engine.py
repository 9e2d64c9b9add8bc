from __future__ import annotations

import dataclasses
import os
import time

import pytest

from marlstone import config as configs
from marlstone.config import Config, Embedding
from marlstone.engine import Engine
from marlstone.operators import embedding
from marlstone.sources.walk import scan
from marlstone.streaming.watch import watch


@pytest.fixture
def engine(spark, tmp_path):
    config = Config(data_dir=str(tmp_path / "data"), embedding=Embedding(dimensions=16), chunk_size=80)
    return Engine(spark, config)


def write(path, text, at=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    if at:
        os.utime(path, (at, at))


def test_sync_search_relations_dictionary(engine, tmp_path):
    src = str(tmp_path / "src")
    write(f"{src}/a.md", "# One\n\nThe first text about shards.", 1_700_000_000)
    write(f"{src}/sub/b.txt", "Second text 符号表 (SymbolTable).", 1_700_000_000)
    write(f"{src}/c.py", "import os\n\nclass Base:\n    pass\n\nclass Runner(Base):\n    def start(self):\n        return helper(1)\n", 1_700_000_000)
    write(f"{src}/bad.json", "{not json", 1_700_000_000)
    write(f"{src}/node_modules/x.js", "function f() {}", 1_700_000_000)
    write(f"{src}/.gitignore", "skip.md\n")
    write(f"{src}/skip.md", "no")
    first = engine.sync(src)
    assert (first["added"], first["failed"], first["removed"]) == (3, 1, 0)
    second = engine.sync(src)
    assert (second["added"], second["skipped"], second["updated"], second["failed"]) == (0, 3, 0, 1)
    rows = engine.search("Runner start", 3).collect()
    assert rows[0]["similarity"] and any(r["metadata"] and r["metadata"]["symbol_name"] == "Runner" for r in rows)
    only = engine.search("text", 5, directory=f"{src}/sub").collect()
    assert [r["document_name"] for r in only] == [f"{src}/sub/b.txt"]
    calls = {(r["target_name"], r["relation_type"]) for r in engine.search_relations("Runner", direction="outgoing").collect()}
    assert ("Base", "inherits") in calls and ("helper", "calls") in calls
    assert {r["source_name"] for r in engine.search_relations("helper", "calls", "incoming").collect()} == {"Runner", "start"}
    made = engine.build_dictionary("zh", document=f"{src}/sub/b.txt")
    assert made["extracted_count"] == 3 and made["total"] == 3
    os.remove(f"{src}/a.md")
    write(f"{src}/sub/b.txt", "Changed text.", 1_700_000_100)
    third = engine.sync(src)
    assert (third["removed"], third["updated"], third["skipped"]) == (1, 1, 1)
    listed = engine.list_documents(1).collect()
    assert listed[0]["total_count"] == 2 and listed[0]["has_more"]
    assert engine.manage_document(f"{src}/c.py") and engine.manage_document("absent")
    assert engine.store.documents().count() == 1 and engine.store.table("code_metadata").count() == 0
    assert [r["success"] for r in engine.index(filepaths=f"{src}/c.py, {src}/none.md").collect()] == [True, False]
    assert engine.manage_document(f"{src}/c.py", "reindex")
    with pytest.raises(FileNotFoundError):
        engine.manage_document("absent", "reindex")
    with pytest.raises(ValueError):
        engine.search("  ")


def test_changed_settings_purge_and_embedders_are_not_mixed(engine, spark, tmp_path):
    src = str(tmp_path / "src")
    write(f"{src}/a.md", "text", 1_700_000_000)
    engine.sync(src)
    engine.config.chunk_size = 40
    assert engine.sync(src)["added"] == 1
    with pytest.raises(ValueError):
        Engine(spark, engine.config, embedding.HashEmbedder(8))


def test_watch_applies_changes(engine, tmp_path):
    src = str(tmp_path / "src")
    write(f"{src}/a.md", "text", 1_700_000_000)
    q = watch(engine, [src], checkpoint=str(tmp_path / "cp"))
    try:
        end = time.time() + 60
        while engine.store.documents().count() != 1 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert engine.store.documents().count() == 1


def test_an_edited_configuration_is_taken_up(engine, tmp_path):
    one, two, path = str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "config.json")
    write(f"{one}/a.md", "text", 1_700_000_000)
    write(f"{two}/b.md", "text", 1_700_000_000)
    configs.save(engine.config, path)
    os.utime(path, (1, 1))
    q = watch(engine, [one], checkpoint=str(tmp_path / "cp"), config_path=path)
    try:
        end = time.time() + 90
        while engine.store.documents().count() != 1 and time.time() < end:
            time.sleep(0.5)
        write(path, "{not json")
        time.sleep(3)
        configs.save(dataclasses.replace(engine.config, document_patterns=[two]), path)
        os.utime(path, (5, 5))
        while engine.store.documents().count() != 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert {r["filename"] for r in engine.store.documents().collect()} == {f"{one}/a.md", f"{two}/b.md"} and engine.config.document_patterns == [two]


def test_single_paths_are_applied(engine, tmp_path):
    src = str(tmp_path / "src")
    write(f"{src}/a.md", "text")
    write(f"{src}/node_modules/b.md", "text")
    engine.apply_paths([f"{src}/a.md"])
    write(f"{src}/c.md", "more")
    os.remove(f"{src}/a.md")
    got = {os.path.basename(r["filename"]): r["action"] for r in engine.apply_paths([f"{src}/{x}" for x in ("a.md", "c.md", "node_modules/b.md", "x.bin")]).collect()}
    assert got == {"a.md": "deleted", "c.md": "indexed", "b.md": "passed over", "x.bin": "passed over"}
    assert [r["filename"] for r in engine.store.documents().collect()] == [f"{src}/c.md"]


def test_gitignore_lines_are_taken_back(spark, tmp_path):
    src = str(tmp_path / "src")
    for name in ("a.log", "keep.log", "out/x.log", "out/keep.log", "sub/a.txt", "sub/b.txt", "sub/deep/b.txt", "build", "lib/build/c.txt"):
        write(f"{src}/{name}", "x")
    write(f"{src}/.gitignore", "*.log\n!keep.log\nout/\n!out/keep.log\n/sub/*.txt\nbuild/\n")
    write(f"{src}/sub/.gitignore", "!b.txt\n# note\n")
    found = scan(spark, src, extensions=["log", "txt", "build"], content=False)
    assert {r["filename"].removeprefix(f"{src}/") for r in found.collect()} == {"keep.log", "sub/b.txt", "sub/deep/b.txt"}


def test_frontmatter_request(engine, tmp_path):
    path = str(tmp_path / "f.md")
    write(path, "Body\nx\ny")
    engine.frontmatter(path, "add", domain="d", tags="a, b")
    out = engine.frontmatter(path, "update", domain="e")
    assert out.startswith("---\ndomain: e\ntags: [a, b]\n---\n\nBody")
    with pytest.raises(ValueError):
        engine.frontmatter(path, "add", domain="z")


def test_config(tmp_path):
    path = str(tmp_path / "c" / "config.json")
    assert configs.load(path) == Config() and os.path.exists(path)
    assert configs.from_dict({"documents_dir": "/x", "embedding": {"dimensions": 7, "odd": 1}, "odd": 2}).document_patterns == ["/x"]
    assert configs.from_dict({"chunk_size": 0}).problems()


def test_batches_and_retry():
    assert [len(b) for b in embedding.batches(["t"] * 5, 3)] == [3, 2]
    assert [len(b) for b in embedding.batches(["x" * 25000, "y"], 32)] == [1, 1]
    assert [embedding.estimate("x" * n) for n in (0, 1, 3, 4, 11)] == [0, 1, 1, 2, 4]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return {"data": []}

    assert embedding.retried(flaky, lambda s: None) == {"data": []} and len(tries) == 3
    assert embedding.vectors_of({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, 2, 1) == [[1], [2]]
    with pytest.raises(ValueError):
        embedding.vectors_of({"data": []}, 1, 1)
