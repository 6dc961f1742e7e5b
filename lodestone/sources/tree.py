"""File trees as tables: a distributed lister and a distributed reader.

The built-in binary file source leaves out empty files and names starting with a dot or an
underscore, so listing and reading are two map steps of their own.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import config
from lodestone.functions import paths
from lodestone.plans import scratch

_ENTRY = "repo_name string, root string, rel_path string, is_dir boolean, length bigint, mtime double"
_FILE = (
    "repo_name string, root string, rel_path string, length bigint, mtime timestamp, "
    "content binary, read_error string, truncated boolean"
)
_ROWS_PER_BATCH = 10_000
_BYTES_PER_BATCH = 16 * 1024 * 1024


def _is_local(root: str) -> bool:
    return "://" not in root


def _join(base: str, name: str) -> str:
    return f"{base}/{name}" if base else name


def _list_local(root: str, rel_dir: str) -> Iterator[tuple[str, bool, int, float]]:
    """Entries of one directory. A link to a directory is neither followed nor a file.

    A folder that cannot be opened is listed like a file, and reading it reports the error; a
    root that cannot be opened is an error of the run.
    """
    try:
        entries = os.scandir(os.path.join(root, rel_dir))
    except OSError:
        if not rel_dir:
            raise
        yield rel_dir, False, 0, 0.0
        return
    for entry in entries:
        name = _join(rel_dir, entry.name)
        if entry.is_dir():
            if not entry.is_symlink():
                yield name, True, 0, 0.0
            continue
        try:
            info = entry.stat()
            yield name, False, info.st_size, info.st_mtime
        except OSError:
            yield name, False, 0, 0.0


@lru_cache(maxsize=64)
def _file_system(root: str):
    """One client per root and worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _list_remote(root: str, rel_dir: str) -> Iterator[tuple[str, bool, int, float]]:
    from pyarrow import fs

    system, base = _file_system(root)
    try:
        entries = system.get_file_info(fs.FileSelector(_join(base, rel_dir)))
    except OSError:
        if not rel_dir:
            raise
        yield rel_dir, False, 0, 0.0
        return
    for info in entries:
        name = _join(rel_dir, info.base_name)
        if info.type == fs.FileType.Directory:
            yield name, True, 0, 0.0
        else:
            yield name, False, info.size, info.mtime.timestamp() if info.mtime else 0.0


def _expand(levels: int | None, skip_dirs: frozenset[str]):
    """A map step that opens directories `levels` deep, or to the bottom when None."""

    def open_dir(row, levels_left) -> Iterator[tuple]:
        listing = _list_local if _is_local(row.root) else _list_remote
        stack = [(row.rel_path, levels_left)]
        while stack:
            rel_dir, left = stack.pop()
            for name, is_dir, length, mtime in listing(row.root, rel_dir):
                if is_dir and name.rsplit("/", 1)[-1] in skip_dirs:
                    continue
                if is_dir and (left is None or left > 1):
                    stack.append((name, None if left is None else left - 1))
                else:
                    yield row.repo_name, row.root, name, is_dir, length, mtime

    def step(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["repo_name", "root", "rel_path", "is_dir", "length", "mtime"]
        rows: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                opened = open_dir(row, levels) if row.is_dir else [tuple(row)]
                for entry in opened:
                    rows.append(entry)
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return step


def _partitions(spark: SparkSession, wanted: int | None) -> int:
    return wanted or int(spark.conf.get("spark.sql.shuffle.partitions"))


def named_roots(roots: DataFrame) -> DataFrame:
    """(repo_name, root) with plain local paths and no slash at the end. A `name` column gives the
    repository name where the last part of the root is not wanted."""
    root = F.regexp_replace(F.regexp_replace("root", r"\Afile:/+", "/"), r"(?<=.)/+\z", "")
    repo = paths.repo_name(F.col("root"))
    if "name" in roots.columns:
        repo = F.coalesce("name", repo)
    return roots.select(repo.alias("repo_name"), root.alias("root"))


def list_files(
    roots: DataFrame, skip_dirs: Iterable[str] = (), split_levels: int | None = None, partitions: int | None = None,
    under: str | None = None, prune: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(repo_name, root, rel_path, length, mtime) for each file below each `root`.

    Levels are opened one at a time with a spread in between until no folder is left, so one
    huge repository is walked by many tasks however deep it branches. Each level is written to
    the shared folder, into the folder `under` if given; its files do not move again. `prune`
    gets the folders of a level and returns those to open. With `split_levels`, only so many
    levels are spread, in one lazy plan, and each folder below is walked by one task.
    """
    spark = roots.sparkSession
    n = _partitions(spark, partitions)
    skip = frozenset(skip_dirs)
    work = named_roots(roots).select(
        "repo_name", "root", F.lit("").alias("rel_path"), F.lit(True).alias("is_dir"),
        F.lit(0).cast("bigint").alias("length"), F.lit(0.0).alias("mtime"),
    )

    def opened(folders: DataFrame, levels: int | None) -> DataFrame:
        return folders.repartition(n, "root", "rel_path").mapInPandas(_expand(levels, skip), _ENTRY)

    if split_levels is None:
        files = []
        while True:
            level = scratch.materialize(opened(work, 1), "level", under)
            files.append(level.where(~F.col("is_dir")))
            work = level.where("is_dir")
            if prune is not None:
                work = prune(work)
            if work.isEmpty():
                break
        found = reduce(DataFrame.unionByName, files)
    else:
        for _ in range(split_levels):
            work = opened(work, 1)
        found = opened(work, None).where(~F.col("is_dir"))
    return found.select("repo_name", "root", "rel_path", "length", F.timestamp_seconds("mtime").alias("mtime"))


def _open_remote(root: str, rel_path: str):
    """Bytes as stored: without this, names such as `x.gz` would be unpacked."""
    system, base = _file_system(root)
    return system.open_input_stream(_join(base, rel_path), compression=None)


def _open(root: str, rel_path: str):
    if _is_local(root):
        return open(os.path.join(root, rel_path), "rb")
    return _open_remote(root, rel_path)


def _read_step(max_bytes: int | None, sample_bytes: int):
    def read(row) -> tuple[int, bytes | None, str | None, bool]:
        """(length, content, error, truncated). A file is read to its end, also if it has grown since
        it was listed; over the cap only the sample stays."""
        try:
            if _is_local(row.root) and not stat.S_ISREG(os.stat(os.path.join(row.root, row.rel_path)).st_mode):
                return row.length, None, "NotAFile", False
            with _open(row.root, row.rel_path) as handle:
                if max_bytes is None:
                    content = handle.read()
                    return len(content), content, None, False
                if row.length > max_bytes:
                    return row.length, handle.read(sample_bytes), None, True
                content = handle.read(max_bytes + 1)
                if len(content) > max_bytes:
                    return len(content), content[:sample_bytes], None, True
                return len(content), content, None, False
        except OSError as error:
            return row.length, None, type(error).__name__, False

    def step(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["repo_name", "root", "rel_path", "length", "mtime", "content", "read_error", "truncated"]
        rows, size = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                length, content, error, truncated = read(row)
                rows.append((row.repo_name, row.root, row.rel_path, length, row.mtime, content, error, truncated))
                size += len(content or b"") + 200
                if size >= _BYTES_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return step


def read_content(
    listing: DataFrame, max_mb: float | None = config.MAX_FILE_MB, partitions: int | None = None
) -> DataFrame:
    """Files with their bytes. Over the size cap, if there is one, only the encoding sample is read
    and the row is marked `truncated`."""
    n = _partitions(listing.sparkSession, partitions)
    max_bytes = None if max_mb is None else int(max_mb * 1048576)
    step = _read_step(max_bytes, 4 * config.BINARY_SAMPLE_CHARS)
    spread = listing.select("repo_name", "root", "rel_path", "length", "mtime").repartition(n, "root", "rel_path")
    return spread.mapInPandas(step, _FILE)


def scan_repos(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """All files of the given repositories, hidden and empty ones too."""
    table = spark.createDataFrame([(r,) for r in roots], "root string")
    return read_content(list_files(table, **options))


def read_manifest(spark: SparkSession, uri: str) -> DataFrame:
    """Files from a Parquet manifest on shared storage that carries the same columns."""
    return spark.read.parquet(uri)
