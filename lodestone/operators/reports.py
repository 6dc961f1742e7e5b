"""Ingestion reports, and results as rows, blocks and JSON responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import display, text as tx

TOTAL = "Total skipped"
_FIELDS = ["rank", "file_path", "file_name", "language", "content_type", "content", "score"]


def skip_stats(classified: DataFrame) -> DataFrame:
    """(repo_name, skip_reason, n) and one total per repository, in one pass."""
    skipped = classified.where(F.col("skip_reason").isNotNull())
    counted = skipped.rollup("repo_name", "skip_reason").agg(F.count(F.lit(1)).alias("n"))
    per_repo = counted.where(F.col("repo_name").isNotNull())
    return per_repo.withColumn("skip_reason", F.coalesce("skip_reason", F.lit(TOTAL)))


def skip_log(classified: DataFrame) -> DataFrame:
    skipped = classified.where(F.col("skip_reason").isNotNull())
    return skipped.select("repo_name", "skip_reason", "rel_path")


def ingest_status(decoded: DataFrame) -> DataFrame:
    """Processed files with `status`: success, empty (also a success) or failed.

    `decoded` holds the files to process after `read_text`.
    """
    status = (
        F.when(F.col("text").isNull(), F.lit("failed"))
        .when(tx.is_blank(F.col("text")), F.lit("empty"))
        .otherwise(F.lit("success"))
    )
    return decoded.withColumn("status", status)


def ingest_summary(
    status: DataFrame, patterns: DataFrame | None = None, repos: DataFrame | None = None
) -> DataFrame:
    """Per repository: attempted, successful, failed, and the rate in percent.

    `repos` names the repositories of the run; one without a file to process has zeros and no
    rate. Without it, those with patterns or with a status are reported.
    """
    good = F.col("status") != "failed"
    counted = status.groupBy("repo_name").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed")
    )
    if repos is None:
        repos = counted if patterns is None else counted.select("repo_name").union(patterns.select("repo_name"))
    numbers = ["attempted", "successful", "failed"]
    summary = repos.select("repo_name").distinct().join(counted, "repo_name", "left").select(
        "repo_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers]
    )
    rate = F.round(100.0 * F.col("successful") / F.nullif("attempted", F.lit(0)), 1)
    summary = summary.withColumn("success_rate", rate)
    if patterns is None:
        return summary
    counts = patterns.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n"))
    joined = summary.join(counts, "repo_name", "left")
    return joined.withColumn("pattern_count", F.coalesce("n", F.lit(0))).drop("n")


def api_rows(results: DataFrame) -> DataFrame:
    """Ranked rows with defaults for missing metadata; the score is rounded after ranking."""
    return results.select(
        "query_id", "rank", "chunk_id", *display.metadata_fields(F.col("metadata")), "content",
        F.round("score", 3).alias("score"),
    )


def display_blocks(results: DataFrame, show_scores: bool = False, show_metadata: bool = False) -> DataFrame:
    """One text block per result."""
    rows = results.select(
        "query_id", "rank", "content", "score", "metadata", *display.metadata_fields(F.col("metadata"))
    )
    score = F.col("score") if show_scores else None
    head = display.header(F.col("rank"), F.col("file_path"), F.col("language"), score)
    shown = None
    if show_metadata:
        shown = F.from_json(F.to_json("metadata"), "map<string,string>")
    return rows.select("query_id", "rank", display.block(head, F.col("content"), shown).alias("block"))


def _quoted(value: Column) -> Column:
    """A string as a JSON literal."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _as_json(row: Column) -> Column:
    numbers = {"rank", "score"}
    fields = [
        F.concat(F.lit(f'      "{name}": '), row[name].cast("string") if name in numbers else _quoted(row[name]))
        for name in _FIELDS
    ]
    return F.concat(F.lit("    {\n"), F.concat_ws(",\n", *fields), F.lit("\n    }"))


def responses(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, total_results, response): one JSON text per query, also without results.

    A query has at most the sum of both top-k values, so its list is small.
    """
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("results"))
    joined = queries.select("query_id", "query").join(listed, "query_id", "left")
    total = F.coalesce(F.size("results"), F.lit(0))
    found = F.array_join(F.transform("results", _as_json), ",\n")
    results = F.when(total > 0, F.concat(F.lit("[\n"), found, F.lit("\n  ]"))).otherwise(F.lit("[]"))
    response = F.concat(
        F.lit('{\n  "query": '), _quoted(F.col("query")),
        F.lit(',\n  "total_results": '), total.cast("string"),
        F.lit(',\n  "results": '), results, F.lit("\n}"),
    )
    return joined.select("query_id", total.cast("bigint").alias("total_results"), response.alias("response"))


def result_count(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Number of results per query; zero is an answer too."""
    found = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    joined = queries.select("query_id").join(found, "query_id", "left")
    return joined.select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
