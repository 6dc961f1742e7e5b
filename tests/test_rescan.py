"""Runs that find what changed by themselves."""

import datetime as dt
import os

import pytest

from lodestone.operators import embedding
from lodestone.plans import rescan
from lodestone.sources import index_store, tree
from lodestone.streaming import ingest_stream as streaming


def write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "demo"
    write(root, {"a.md": b"one two", "b/c.md": b"three", "b/copy.md": b"three", "empty.md": b"", "gone.md": b"gone", "d.md": b"old name"})
    return tmp_path, root


def run(spark, place, when="2030-01-01"):
    base, root = place
    counts = rescan.rescan(spark, [str(root)], str(base / "snap"), str(base / "manifests"), dt.datetime.fromisoformat(when))
    return {r.change: r.n for r in counts.collect()}


def test_changes_of_a_tree(spark, place, monkeypatch):
    base, root = place
    assert run(spark, place) == {"added": 6}
    opened = []
    plain = tree.read_content
    monkeypatch.setattr(tree, "read_content", lambda listing, *a, **k: (opened.append(sorted(r.rel_path for r in listing.collect())), plain(listing, *a, **k))[1])
    assert run(spark, place) == {"unchanged": 6} and opened == [[]]
    write(root, {"a.md": b"one two three", "new.md": b"new", "other.md": b""})
    os.utime(root / "b/c.md", (1, 1))
    os.rename(root / "d.md", root / "b/renamed.md")
    os.remove(root / "gone.md")
    os.remove(root / "empty.md")
    assert run(spark, place) == {"changed": 1, "added": 2, "renamed": 1, "deleted": 2, "unchanged": 2}
    assert opened[1] == ["a.md", "b/c.md", "b/renamed.md", "new.md", "other.md"]
    assert run(spark, place) == {"unchanged": 6} and opened[2] == []


def test_renames_pair_copies_by_path(spark, place):
    base, root = place
    with_folder = str(base / "work")
    listing = tree.list_files(spark.createDataFrame([(str(root),)], "root string"))
    first = rescan.difference(spark.createDataFrame([], rescan.SNAPSHOT_SCHEMA), listing, with_folder)
    os.rename(root / "b/c.md", root / "x.md")
    os.rename(root / "b/copy.md", root / "y.md")
    write(root, {"z.md": b"three"})
    listing = tree.list_files(spark.createDataFrame([(str(root),)], "root string"))
    found = rescan.difference(first.snapshot, listing, with_folder)
    rows = {r.rel_path: (r.change, r.old_path) for r in found.changes.collect() if r.change != "unchanged"}
    assert rows == {"x.md": ("renamed", "b/c.md"), "y.md": ("renamed", "b/copy.md"), "z.md": ("added", None)}


def test_unreadable_and_too_large_files(spark, place):
    base, root = place
    write(root, {"large.md": b"x" * 5000})
    listing = tree.list_files(spark.createDataFrame([(str(root),)], "root string"))
    os.remove(root / "a.md")
    found = rescan.difference(spark.createDataFrame([], rescan.SNAPSHOT_SCHEMA), listing, str(base / "w"), max_mb=0.001)
    rows = {r.rel_path: (r.change, r.digest is None) for r in found.changes.collect()}
    assert rows["a.md"] == ("unreadable", True) and rows["large.md"] == ("added", True) and rows["b/c.md"] == ("added", False)
    again = rescan.difference(found.snapshot, listing.where("rel_path <> 'a.md'"), str(base / "w"), max_mb=0.001)
    assert {r.change for r in again.changes.collect()} == {"unchanged"}


def test_changes_reach_the_index_and_only_their_buckets_are_read(spark, place):
    base, root = place
    index = str(base / "index")

    def ingest():
        streaming.ingest_stream(
            spark, str(base / "manifests"), index, str(base / "checkpoint"), embedding.hash_embedder(8), buckets=4,
        ).awaitTermination()
        return {r.file_path: r.content for r in index_store.read_index(spark, index).select("metadata.file_path", "content").collect()}

    run(spark, place)
    assert ingest() == {"a.md": "one two", "b/c.md": "three", "b/copy.md": "three", "gone.md": "gone", "d.md": "old name"}
    write(root, {"a.md": b"one two three"})
    os.rename(root / "d.md", root / "e.md")
    os.remove(root / "gone.md")
    run(spark, place, "2031-01-01")
    assert ingest() == {"a.md": "one two three", "b/c.md": "three", "b/copy.md": "three", "e.md": "old name"}
    run(spark, place, "2032-01-01")
    assert ingest() == {"a.md": "one two three", "b/c.md": "three", "b/copy.md": "three", "e.md": "old name"}
    files = spark.createDataFrame([("demo", "a.md")], "repo_name string, rel_path string")
    versions = index_store.stored_versions(spark, index, files)
    assert "dynamicpruning" in versions._jdf.queryExecution().toString()
    every = {r.rel_path: r.stored for r in index_store.stored_versions(spark, index).collect()}
    some = {r.rel_path: r.stored for r in versions.collect()}
    assert some["a.md"] == every["a.md"] and set(some) < set(every)
