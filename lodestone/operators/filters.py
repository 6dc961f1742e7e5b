"""File filters: encoding, size, the combined skip reason, blank texts and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone import config
from lodestone.functions import paths, text as tx


def is_binary(content: Column, read_error: Column | None = None) -> Column:
    """The first characters do not decode as UTF-8, or the file may not be read.

    Four bytes per character always hold the whole sample. Repairing the bytes changes them
    exactly where they do not decode, so a clean sample is still a prefix of what was read.
    Character functions must not see the bytes before that: they trust their lengths.
    """
    raw = F.substring(content, 1, 4 * config.BINARY_SAMPLE_CHARS)
    repaired = F.make_valid_utf8(raw.cast("string"))
    sample = F.encode(F.substring(repaired, 1, config.BINARY_SAMPLE_CHARS), "UTF-8")
    bad = ~F.startswith(raw, sample)
    if read_error is None:
        return bad
    return F.coalesce(read_error == "PermissionError", F.lit(False)) | F.coalesce(bad, F.lit(False))


def too_large(length: Column, max_mb: float = config.MAX_FILE_MB) -> Column:
    return paths.size_mb(length) > F.lit(float(max_mb))


def too_large_reason(length: Column) -> Column:
    return F.format_string("too_large (%.1fMB)", paths.size_mb(length))


def skip_reason(
    ignore_status: Column, binary: Column, length: Column, max_mb: float = config.MAX_FILE_MB
) -> Column:
    """First reason that applies; NULL means the file is processed."""
    return (
        F.when(ignore_status.isNotNull(), F.lit("gitignore"))
        .when(binary, F.lit("binary"))
        .when(too_large(length, max_mb), too_large_reason(length))
    )


def with_skip_reason(files: DataFrame, max_mb: float = config.MAX_FILE_MB) -> DataFrame:
    """Files that the walk reaches, with their `skip_reason`. Needs `ignore_status` and `content`."""
    error = F.col("read_error") if "read_error" in files.columns else None
    reason = skip_reason(
        F.col("ignore_status"), is_binary(F.col("content"), error), F.col("length"), max_mb
    )
    reached = files.where(~F.col("ignore_status").eqNullSafe("pruned"))
    return reached.withColumn("skip_reason", reason).drop("ignore_status")


def drop_blank(docs: DataFrame) -> DataFrame:
    """Documents with something to index."""
    return docs.where(~tx.is_blank(F.col("text")))


def guard_query(queries: DataFrame) -> DataFrame:
    """Queries with a `status`: `ok`, or `empty_query` for a blank or missing text."""
    blank = F.coalesce(tx.is_blank(F.col("query")), F.lit(True))
    return queries.withColumn("status", F.when(blank, F.lit("empty_query")).otherwise(F.lit("ok")))
