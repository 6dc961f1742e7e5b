"""Small DataFrame steps that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of a word, as a Java and DuckDB pattern.
WORD = "[^\\x20\\x09-\\x0D]+"


def spread(column: str | Column, seed: int) -> Column:
    """A seeded hash of a value as a number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 52)) / F.lit(float(1 << 52))


def remainder(column: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column), F.lit(divisor))


def sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About `bound` rows, chosen by a seeded hash of the key, or all rows if there are fewer.

    Which rows are chosen depends on their keys alone, never on the layout of the table.
    """
    n = df.count()
    return df if n <= bound else df.filter(spread(key, seed) < bound / n)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder of the cluster."""
    spark = df.sparkSession
    if not spark._jsc.sc().getCheckpointDir().isDefined():
        from lodestone.plans.scratch import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def frequent(counts: DataFrame, n: str, bound: int) -> DataFrame:
    """The rows with the largest `n`, at most `bound` of them and all of a size or none.

    Sizes are told apart in steps of a sixteenth of a power of two, so the histogram that
    comes to the driver has at most 1,024 rows however large the table is.
    """
    step = F.floor(F.log2(F.col(n)) * 16).cast("int")
    histogram = sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"])
    total, lowest = 0, None
    for row in histogram:
        total += row["count"]
        if total > bound:
            break
        lowest = row["step"]
    return counts.filter(F.lit(False)) if lowest is None else counts.filter(step >= lowest)


def known_labels(labels: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """(key, label 0/1), one row per id: null labels and ids teach nothing, of several the largest holds."""
    clean = labels.filter(F.col(key).isNotNull() & F.col(column).isNotNull())
    return clean.groupBy(key).agg(F.max(F.col(column).cast("int")).alias("label"))
