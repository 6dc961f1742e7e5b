"""Column helpers on file paths, sizes and document metadata."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from lodestone import config

_EXTENSION = r"(?s)\A.+(\.[^.]+)\z"


def _root(root: Column) -> Column:
    return F.regexp_replace(root, r"/+\z", "")


def rel_path(path: Column, root: Column) -> Column:
    """Path below the root; NULL when the path is not under the root."""
    prefix = F.concat(_root(root), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1))


def outside_root(path: Column, root: Column) -> Column:
    return ~F.startswith(path, F.concat(_root(root), F.lit("/")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def repo_name(root: Column) -> Column:
    return F.substring_index(_root(root), "/", -1)


def size_mb(length: Column) -> Column:
    return length / F.lit(1048576.0)


def extension(path: Column) -> Column:
    """Last extension in lower case; a dot-file such as `.py` has none."""
    return F.lower(F.regexp_extract(file_name(path), _EXTENSION, 1))


def language(path: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for x in chain(*config.LANGUAGE_BY_EXTENSION.items())])
    return lookup[extension(path)]


def is_code(path: Column) -> Column:
    return language(path).isNotNull()


def content_type(path: Column) -> Column:
    return F.when(is_code(path), F.lit("code")).otherwise(F.lit("text"))


def build_metadata(path: Column, repo: Column) -> Column:
    return F.struct(
        path.alias("file_path"),
        file_name(path).alias("file_name"),
        repo.alias("repo_name"),
        content_type(path).alias("content_type"),
        language(path).alias("language"),
    )


# A repository name holds no "/", so the joined text names one file only.
def document_id(repo: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("/", repo, path), 256)


def chunk_id(repo: Column, path: Column, chunk_no: Column) -> Column:
    return F.sha2(F.concat(F.concat_ws("/", repo, path), F.lit("#"), chunk_no.cast("string")), 256)


def path_bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def with_document(files: DataFrame) -> DataFrame:
    """`docs` rows from files that carry their decoded text."""
    path, repo = F.col("rel_path"), F.col("repo_name")
    return files.select(
        document_id(repo, path).alias("doc_id"),
        F.col("text"),
        build_metadata(path, repo).alias("metadata"),
    )
