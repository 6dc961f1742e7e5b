"""Fusion of ranked lists and the final ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lodestone import config


def _weights(lists: list[DataFrame], weights: list[float] | None) -> list[float]:
    """One weight per list, equal ones if none are given."""
    weights = [1.0] * len(lists) if weights is None else [float(w) for w in weights]
    if len(weights) != len(lists) or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("one weight of zero or more per list, not all zero")
    return weights


def rrf(
    lists: list[DataFrame], k: int = config.RRF_K, normalize: bool = True, weights: list[float] | None = None
) -> DataFrame:
    """Reciprocal rank fusion (Cormack et al. 2009); a hit in several lists is one result.

    With `normalize` a hit that is first in all lists scores 1.
    """
    weights = _weights(lists, weights)
    ranks = reduce(DataFrame.unionByName, [
        d.select("query_id", "chunk_id", "rank", F.lit(w).alias("weight")) for d, w in zip(lists, weights, strict=True)
    ])
    score = F.sum(F.col("weight") / (F.lit(k) + F.col("rank")))
    if normalize:
        score = score * (k + 1) / sum(weights)
    return ranks.groupBy("query_id", "chunk_id").agg(F.round(score, config.FUSED_DECIMALS).alias("score"))


def by_distribution(lists: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Fusion by scores: each list of a query is scaled so that its mean less three deviations is 0
    and its mean plus three deviations 1; a hit scores the weighted mean over the lists.

    A list whose scores are all the same, one of a single hit too, gives each of them a half. A
    hit that is not in a list gets nothing from it.
    """
    weights = _weights(lists, weights)
    own = Window.partitionBy("query_id")
    mean, deviation = F.avg("score").over(own), F.stddev_pop("score").over(own)
    # scores are rounded, so a deviation below this is the noise of equal ones
    flat = deviation < 10.0 ** -(config.SCORE_DECIMALS + 3)
    scaled = F.when(flat, F.lit(0.5)).otherwise(0.5 + (F.col("score") - mean) / (6 * deviation))
    parts = reduce(DataFrame.unionByName, [
        d.select("query_id", "chunk_id", (scaled * F.lit(w)).alias("part")) for d, w in zip(lists, weights, strict=True)
    ])
    score = F.round(F.sum("part") / F.lit(sum(weights)), config.FUSED_DECIMALS)
    return parts.groupBy("query_id", "chunk_id").agg(score.alias("score"))


def final_rank(fused: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return fused.withColumn("rank", F.row_number().over(order))


def fuse(
    lists: list[DataFrame], join_mode: str = config.JOIN_MODE, weights: list[float] | None = None
) -> DataFrame:
    """Ranked results of the given lists under a fusion mode, `config.JOIN_MODE` or `config.SCORE_JOIN_MODE`."""
    if join_mode == config.JOIN_MODE:
        return final_rank(rrf(lists, weights=weights))
    if join_mode == config.SCORE_JOIN_MODE:
        return final_rank(by_distribution(lists, weights))
    raise ValueError(f"unsupported join mode {join_mode!r}")
