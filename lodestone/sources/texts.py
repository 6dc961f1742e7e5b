"""Decoding files, reading queries and writing responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import text as tx


def read_text(files: DataFrame) -> DataFrame:
    """Files plus `text` and `error`. A file that does not decode has NULL text and fails alone."""
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.lit("UnicodeDecodeError")
    if "read_error" in files.columns:
        error = F.coalesce("read_error", error)
    return files.withColumn("text", tx.fold_newlines(decoded)).withColumn(
        "error", F.when(F.col("text").isNull(), error)
    )


def read_queries(df: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(text_col).alias("query"))


def write_responses(responses: DataFrame, path: str) -> None:
    """One JSON text per query, two-space indent."""
    responses.select("response").write.mode("overwrite").option("lineSep", "\n\n").text(path)
