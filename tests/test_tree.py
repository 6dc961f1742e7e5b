"""Listing, reading and filtering real file trees."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lodestone.plans import ingest
from lodestone.operators import filters
from lodestone.sources import texts, tree

FILES = {
    "pkg/__init__.py": b"import os\n",
    ".gitignore": b"# c\nbuild/\n\n  *.log  \n",
    ".github/w.yml": b"a: b\n",
    ".git/objects/ab": b"x",
    "empty.txt": b"",
    "blank.txt": b" \n\xe3\x80\x80\n",
    "bad.dat": b"\xff\xfe binary",
    "late_bad.txt": b"a" * 100_000 + b"\xff",
    "nul.txt": b"a\x00b",
    "cut.txt": b"a" * 8191 + "é".encode() + b"b" * 10,
    "cut_end.txt": b"abc\xc3",
    "crlf.txt": b"a\r\nb\rc\n",
    "big.txt": b"x" * 1_153_434,
    "edge.txt": b"x" * 1_048_576,
    "build": b"a file",
    "a/build/x": b"below",
    "a/b/c/d/e.md": b"deep",
    "run.log": b"log",
    "_private.py": b"x = 1\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("trees") / "demo"
    for name, content in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(base / "pkg", base / "link")
    return str(base)


@pytest.fixture(scope="module")
def run(spark, root):
    return ingest.ingest_roots(spark, [root])


def test_lists_every_file_once_and_no_linked_folder(spark, root):
    rows = tree.scan_repos(spark, [root + "/"]).collect()
    assert sorted(r.rel_path for r in rows) == sorted(FILES)
    assert {r.repo_name for r in rows} == {"demo"}
    assert all(r.length == len(FILES[r.rel_path]) for r in rows)
    whole = {r.rel_path: bytes(r.content) for r in rows if r.rel_path != "big.txt"}
    assert all(whole[p] == FILES[p] for p in whole)


def test_over_the_cap_only_the_sample_is_read(spark, root):
    row = tree.scan_repos(spark, [root]).where("rel_path = 'big.txt'").first()
    assert len(row.content) == 32768 and row.length == len(FILES["big.txt"])


@pytest.mark.parametrize("levels", [None, 0, 1, 5])
def test_split_levels_do_not_change_the_listing(spark, root, levels):
    roots = spark.createDataFrame([(root,)], "root string")
    rows = tree.list_files(roots, split_levels=levels).collect()
    assert sorted(r.rel_path for r in rows) == sorted(FILES)


def test_skip_reasons(run):
    reasons = {r.rel_path: r.skip_reason for r in run.classified.collect()}
    assert ".git/objects/ab" not in reasons and "a/build/x" not in reasons
    skipped = {p: r for p, r in reasons.items() if r}
    assert skipped == {
        "build": "gitignore", "run.log": "gitignore", "bad.dat": "binary", "cut_end.txt": "binary",
        "big.txt": "too_large (1.1MB)",
    }


def test_status_and_summary(run):
    status = {r.rel_path: r.status for r in run.status.collect()}
    assert status["late_bad.txt"] == "failed"
    assert status["empty.txt"] == status["blank.txt"] == "empty"
    assert status["nul.txt"] == status["cut.txt"] == status["edge.txt"] == "success"
    row = run.summary().first()
    assert (row.attempted, row.successful, row.failed, row.pattern_count) == (12, 11, 1, 5)
    assert row.success_rate == 91.7
    assert {r.skip_reason: r.n for r in run.skip_stats().collect()} == {
        "gitignore": 2, "binary": 2, "too_large (1.1MB)": 1, "Total skipped": 5,
    }


def test_chunks_come_with_vectors_and_metadata(run):
    rows = run.chunks.collect()
    assert all(len(r.embedding) == 1536 for r in rows)
    by_path = {r.metadata.file_path: r for r in rows}
    assert by_path["pkg/__init__.py"].metadata.language == "python"
    assert by_path["crlf.txt"].content == "a\nb\nc\n"
    assert not {"empty.txt", "blank.txt", "late_bad.txt"} & set(by_path)


def test_failures_stay_with_their_file(spark):
    rows = spark.createDataFrame(
        [("r", "a", bytearray(b"ok"), None), ("r", "b", None, "FileNotFoundError"), ("r", "c", None, "PermissionError")],
        "repo_name string, rel_path string, content binary, read_error string",
    )
    decoded = {r.rel_path: r for r in texts.read_text(rows).collect()}
    assert (decoded["a"].text, decoded["a"].error) == ("ok", None)
    assert (decoded["b"].text, decoded["b"].error) == (None, "FileNotFoundError")
    flags = rows.select("rel_path", filters.is_binary(F.col("content"), F.col("read_error")).alias("b"))
    assert {r.rel_path: r.b for r in flags.collect()} == {"a": False, "b": False, "c": True}


def test_sample_of_widest_characters(spark):
    wide = "𝄞".encode()
    rows = spark.createDataFrame(
        [(1, bytearray(wide * 8191 + b"\xff")), (2, bytearray(wide * 8192 + b"\xff"))], "id int, content binary"
    )
    flags = rows.select("id", filters.is_binary(F.col("content")).alias("b")).collect()
    assert {r.id: r.b for r in flags} == {1: True, 2: False}


def test_object_storage_listing_and_reading(root):
    """The same steps through the file system layer that serves object stores."""
    from pathlib import Path

    uri = Path(root).as_uri()
    top = {name: (is_dir, size) for name, is_dir, size, _ in tree._list_remote(uri, "")}
    assert top["pkg"] == (True, 0) and top["empty.txt"] == (False, 0) and top["big.txt"][1] == len(FILES["big.txt"])
    assert [n for n, *_ in tree._list_remote(uri, "pkg")] == ["pkg/__init__.py"]
    (Path(root) / "a" / "b" / "z.gz").write_bytes(b"not packed")
    with tree._open_remote(uri, "a/b/z.gz") as handle:
        assert handle.read(100) == b"not packed"
    (Path(root) / "a" / "b" / "z.gz").unlink()


def test_file_uris_are_local_paths(spark, root):
    rows = tree.list_files(spark.createDataFrame([("file://" + root + "/",)], "root string")).collect()
    assert sorted(r.rel_path for r in rows) == sorted(FILES) and {r.root for r in rows} == {root}


def test_roots_with_one_name(spark, tmp_path):
    for place in ("x", "y"):
        (tmp_path / place / "demo").mkdir(parents=True)
        (tmp_path / place / "demo" / "f.md").write_text(f"text of {place}")
    (tmp_path / "x" / "demo" / ".gitignore").write_text("*.md\n")
    roots = [str(tmp_path / "x" / "demo"), str(tmp_path / "y" / "demo")]
    with pytest.raises(ValueError, match="same last part"):
        ingest.ingest_roots(spark, roots)
    run = ingest.ingest_roots(spark, {"first": roots[0], "second": roots[1]})
    local = re.sub(r"\Afile:/+", "/", run.folder)
    assert {(r.repo_name, r.rel_path): r.skip_reason for r in run.classified.collect()} == {
        ("first", ".gitignore"): None, ("first", "f.md"): "gitignore", ("second", "f.md"): None,
    }
    assert {r.metadata.repo_name for r in run.chunks.collect()} == {"first", "second"} and os.path.isdir(local)
    run.close()
    assert not os.path.exists(local)


def test_a_repository_without_files_to_process_is_reported(spark, tmp_path):
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "b.dat").write_bytes(b"\xff")
    row = ingest.ingest_roots(spark, [str(tmp_path / "only")]).summary().first()
    assert (row.repo_name, row.attempted, row.successful, row.failed, row.success_rate, row.pattern_count) == ("only", 0, 0, 0, None, 3)


def test_a_missing_root_fails(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        tree.scan_repos(spark, [str(tmp_path / "nowhere")]).count()


def test_a_folder_that_cannot_be_opened_is_reported(spark, tmp_path, monkeypatch):
    (tmp_path / "r").mkdir()
    rows = list(tree._list_local(str(tmp_path / "r"), "gone"))
    assert rows == [("gone", False, 0, 0.0)]
    assert list(tree._list_remote((tmp_path / "r").as_uri(), "gone")) == [("gone", False, 0, 0.0)]


def test_a_file_that_has_grown_is_read_to_its_end(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.txt").write_bytes(b"x" * 10)
    (root / "b.txt").write_bytes(b"x" * 10)
    from lodestone.plans import scratch

    listing = scratch.materialize(tree.list_files(spark.createDataFrame([(str(root),)], "root string")), "listing")
    (root / "a.txt").write_bytes(b"y" * 50_000)
    (root / "b.txt").write_bytes(b"y" * 2_000_000)
    rows = {r.rel_path: r for r in tree.read_content(listing, max_mb=1.0).collect()}
    assert bytes(rows["a.txt"].content) == b"y" * 50_000 and rows["a.txt"].length == 50_000
    assert rows["b.txt"].length > 1_048_576 and len(rows["b.txt"].content) == 32_768


def test_runs_leave_no_scratch_folders(spark):
    from lodestone.plans import scratch

    with scratch.run_folder(spark, "trial") as path:
        spark.range(3).write.parquet(path)
        local = re.sub(r"\Afile:/+", "/", path)
        assert os.path.isdir(local)
    assert not os.path.exists(local)


def test_a_deep_narrow_tree_that_widens_below_uses_many_tasks(spark, tmp_path):
    base = tmp_path / "deep" / "/".join(f"l{i}" for i in range(12))[0:]
    for i in range(30):
        (base / f"d{i}").mkdir(parents=True)
        (base / f"d{i}" / "f.txt").write_text("x")
    roots = spark.createDataFrame([(str(tmp_path / "deep"),)], "root string")
    found = tree.list_files(roots, partitions=4)
    assert found.count() == 30
    tasks = found.select(F.input_file_name()).distinct().count()
    assert tasks > 1


def test_the_walk_does_not_enter_ignored_folders(spark, tmp_path, monkeypatch):
    base = tmp_path / "repo"
    for name in ("node_modules/a/b.js", "src/x.py", "src/build/out.txt", "docs/keep.md"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text("text")
    (base / ".gitignore").write_text("node_modules/\nbuild\n")
    with ingest.ingest_roots(spark, [str(base)]) as run:
        assert sorted(r.rel_path for r in run.classified.collect()) == [".gitignore", "docs/keep.md", "src/x.py"]
        levels = spark.read.option("recursiveFileLookup", "true").parquet(f"{run.folder}/level-*")
        listed = {r.rel_path for r in levels.collect()}
    assert "node_modules" in listed and "node_modules/a" not in listed and "src/build/out.txt" not in listed


def test_a_sample_of_a_large_file_is_marked(spark, root):
    marks = {r.rel_path: r.truncated for r in tree.scan_repos(spark, [root]).collect()}
    assert {p for p, t in marks.items() if t} == {"big.txt"}
