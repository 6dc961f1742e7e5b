"""Scheduled, unattended ingestion: each run takes the manifests that are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import filters
from lodestone.operators.embedding import Embedder
from lodestone.plans import scratch
from lodestone.plans.ingest import chunk_files
from lodestone.sources import index_store
from lodestone.sources.texts import read_text

MANIFEST_SCHEMA = (
    "repo_name string, rel_path string, length bigint, mtime timestamp, content binary, deleted boolean"
)


def latest_versions(batch: DataFrame) -> DataFrame:
    """The newest row of each file; a file may come several times in one batch.

    The content moves once, by the name of its file. Of rows with one time the deletion wins, then the longest,
    then the largest digest, so the choice never depends on the order of the rows.
    """
    gone = F.coalesce("deleted", F.lit(False))
    digest = F.sha2(F.coalesce("content", F.lit("").cast("binary")), 256)
    marked = batch.withColumn("_version", F.struct(
        F.col("mtime").alias("mtime"), gone.alias("deleted"), F.coalesce("length", F.lit(-1)).alias("length"), digest.alias("digest")
    ))
    order = Window.partitionBy("repo_name", "rel_path").orderBy(F.desc("_version"))
    named = marked.where(F.col("repo_name").isNotNull() & F.col("rel_path").isNotNull())
    return named.withColumn("_at", F.row_number().over(order)).where(F.col("_at") == 1).drop("_version", "_at")


def apply_batch(
    spark: SparkSession, batch: DataFrame, index_path: str, embedder: Embedder | None = None,
    buckets: int | None = None, **options,
) -> None:
    """Replace the chunks of all files in the batch. Running a batch twice changes nothing.

    A row older than what is stored of its file is left out; of the index, only the buckets of the
    batch are read for that. The rows to apply are written once
    to the shared folder and read from there.
    """
    stored = index_store.stored_versions(spark, index_path, batch.select("repo_name", "rel_path"))
    newest = latest_versions(batch).join(stored, ["repo_name", "rel_path"], "left")
    newest = newest.where(F.col("stored").isNull() | F.col("mtime").isNull() | (F.col("mtime") >= F.col("stored")))
    with scratch.run_folder(spark, "batch") as aside:
        newest.drop("stored").write.option("compression", scratch.COMPRESSION).parquet(aside)
        rows = spark.read.schema(batch.schema).parquet(aside)
        alive = rows.where(~F.coalesce("deleted", F.lit(False)))
        usable = alive.where(
            ~filters.is_binary(F.col("content")) & ~filters.too_large(F.col("length"))
        )
        # The files of the batch were dealt by their names, so their chunks need not move to be embedded.
        _, chunks = chunk_files(read_text(usable), embedder, spread=False, **options)
        index_store.upsert_files(spark, index_path, rows.select("repo_name", "rel_path", "mtime"), chunks, buckets)


def ingest_stream(
    spark: SparkSession, manifest_dir: str, index_path: str, checkpoint: str,
    embedder: Embedder | None = None, max_files_per_trigger: int | None = None,
    buckets: int | None = None, **options,
) -> StreamingQuery:
    """One scheduled run: takes what is new in `manifest_dir`, then stops.

    Manifests hold files after the ignore rules. A row with `deleted` takes its file out.
    """
    index_store.create_index(spark, index_path, buckets)
    reader = spark.readStream.schema(MANIFEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(manifest_dir)

    def run(batch: DataFrame, _batch_id: int) -> None:
        apply_batch(batch.sparkSession, batch, index_path, embedder, buckets, **options)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
