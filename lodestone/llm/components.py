"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.llm.tables import checkpoint


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of `links` (a, b long): the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al. 2014): each points nodes at the
    smallest neighbour, so stars grow in a logarithmic number of rounds. The minima are
    aggregated before they are shuffled; the joins that follow are inner joins, which Spark
    splits when one hub holds many of the links. Self links and repeated links are fine.
    """
    edges = checkpoint(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            both.join(lowest, "a").filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b")).filter("a <> b").distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        edges = checkpoint(small.union(lowest.select("a", F.col("low").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
        before = now
    raise RuntimeError(f"components are not stable after {rounds} rounds")
