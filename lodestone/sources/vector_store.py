"""Vectors kept by the content they stand for: a text is given to the model once, in all runs.

The store is a Parquet table (digest, embedding) by model and bucket of the digest. A run reads
only the digests of its model to find what is missing, embeds one text per missing digest and
appends them; then every row takes its vector by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone import config
from lodestone.operators.embedding import Embedder, embed
from lodestone.plans import scratch
from lodestone.sources import index_store

STORE_SCHEMA = "digest string, embedding array<float>, model string, bucket int"


def content_digest(text: Column) -> Column:
    """Equal texts have equal digests; null and the empty text share theirs."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _bucket(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(config.VECTOR_STORE_BUCKETS)).cast("int")


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(digest, embedding) of one model, one row per digest; none before the first run.

    Two runs at once, or one that broke off and was repeated, may have stored a digest twice.
    """
    if not index_store._exists(spark, path):
        return spark.createDataFrame([], STORE_SCHEMA).select("digest", "embedding")
    stored = spark.read.schema(STORE_SCHEMA).parquet(path).where(F.col("model") == model)
    return stored.select("digest", "embedding")


def missing_texts(df: DataFrame, text_col: str, path: str, model: str) -> DataFrame:
    """(digest, text), one row per content that has no vector yet."""
    wanted = df.select(content_digest(F.col(text_col)).alias("digest"), F.coalesce(text_col, F.lit("")).alias("text"))
    # one text per digest is found within each task first, so copies do not travel
    once = wanted.groupBy("digest").agg(F.any_value("text").alias("text"))
    return once.join(read_vectors(df.sparkSession, path, model).select("digest"), "digest", "left_anti")


def embed_incremental(df: DataFrame, text_col: str, path: str, model: str, embedder: Embedder | None = None) -> DataFrame:
    """`df` with `embedding`, as `embed` gives it; only contents without a stored vector reach the embedder.

    `model` names the embedder and all that its vectors depend on; vectors of another name are not used.
    """
    spark = df.sparkSession
    with scratch.run_folder(spark, "missing") as folder:
        missing = scratch.materialize(missing_texts(df, text_col, path, model), "texts", folder)
        if not missing.isEmpty():
            fresh = embed(missing, "text", embedder, spread_by="digest").select(
                "digest", "embedding", F.lit(model).alias("model"), _bucket(F.col("digest")).alias("bucket")
            )
            fresh.hint("rebalance", "model", "bucket").write.mode("append").partitionBy("model", "bucket").parquet(path)
    vectors = read_vectors(spark, path, model).groupBy("digest").agg(F.any_value("embedding").alias("embedding"))
    # both sides are shuffled, so Spark splits the rows of a text that holds a third of all
    keyed = df.withColumn("_digest", content_digest(F.col(text_col)))
    return keyed.join(vectors, keyed["_digest"] == vectors["digest"]).drop("_digest", "digest")


def unused_vectors(df: DataFrame, text_col: str, path: str, model: str) -> DataFrame:
    """(digest) of the stored vectors of a model that no row of `df` uses any more."""
    used = df.select(content_digest(F.col(text_col)).alias("digest")).distinct()
    return read_vectors(df.sparkSession, path, model).select("digest").distinct().join(used, "digest", "left_anti")
