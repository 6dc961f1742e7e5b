"""The best hits per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone import config


def top_k(hits: DataFrame, k: int, id_col: str = "chunk_id", decimals: int = config.SCORE_DECIMALS) -> DataFrame:
    """Best `k` per query. Spark cuts each partition to `k` before it shuffles by query."""
    rounded = hits.withColumn("score", F.round("score", decimals))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
