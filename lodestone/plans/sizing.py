"""Size checks before a broadcast, and the join to use beyond them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone import config


def fits_broadcast(
    df: DataFrame,
    max_rows: int = config.BROADCAST_MAX_ROWS,
    max_bytes: int = config.BROADCAST_MAX_BYTES,
) -> bool:
    """Whether a table stays under both bounds. Reads at most `max_rows` + 1 rows."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def partitions_of(
    texts: DataFrame, column: str, max_bytes: int = config.PARTITION_TEXT_BYTES, min_bytes: int = config.PARTITION_LEAST_BYTES
) -> int:
    """How many partitions hold at most `max_bytes` of the texts each, in one pass over their sizes.

    Few texts are spread over twice the cores, as long as a partition keeps `min_bytes`. Steps that
    make far more of a text than what is shuffled need a fixed number: Spark would coalesce
    partitions by their compressed size.
    """
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    spread = min(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-size // min_bytes))
    return max(1, spread, -(-size // max_bytes))


def lookup_join(
    facts: DataFrame,
    small: DataFrame,
    on: str,
    spread: str,
    how: str = "inner",
    salts: int = config.LOOKUP_SALTS,
    broadcast: bool | None = None,
) -> DataFrame:
    """Join a big table with a usually small one.

    The small side is broadcast when it is measured to fit. Otherwise both sides are
    shuffled on (key, salt): the big side is spread by a hash of `spread`, the small side
    is copied once per salt, so one key holding a third of the rows uses `salts` tasks.
    """
    if fits_broadcast(small) if broadcast is None else broadcast:
        return facts.join(F.broadcast(small), on, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")
