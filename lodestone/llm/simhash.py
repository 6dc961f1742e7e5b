"""SimHash near-duplicates by tiled exact comparison.

Every pair of fingerprints within the radius is linked: no bucket is capped and none is
sampled. Fingerprints within `radius` bits agree in at least one of `radius` + 1 disjoint
groups of bits, so they are compared only inside the buckets of equal groups. A bucket
larger than a tile is cut into tiles, every pair of its tiles is one cell, and cells are
spread over the tasks. In a cell the fingerprints are ordered by population count and
compared in blocks with numpy exclusive-or and bit counts; a pair of blocks whose counts
differ by more than the radius is skipped. Of the links of a cell only a spanning forest
leaves the task, so a group of copies never grows to all its pairs.

Null texts count as empty. Texts without a word have fingerprint zero and link like any
other. Rows may repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lodestone.llm.components import components
from lodestone.llm.tables import checkpoint
from lodestone.plans.sizing import lookup_join

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a tile. A cell holds two tiles at most.
TILE_ROWS = 4096
#: Fingerprints of a block: the unit that is compared, or skipped, at once.
BLOCK_ROWS = 256
#: Distinct fingerprints from which the bits that two must share are refined once more.
REFINE_ROWS = 50_000_000


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Bits that are set in more than half of the hashes of the word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), "<u8", len(starts)
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long) for every row; whole texts, no shuffle."""
    schema = docs.select(key).schema.add("fp", "long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(scan, schema)


def masks(radius: int = RADIUS, refined: bool = False) -> list[int]:
    """Groups of bits; two numbers within the radius agree on all bits of at least one mask."""

    def parts(bits: list[int]) -> list[list[int]]:
        return [[int(b) for b in p] for p in np.array_split(bits, radius + 1)]

    groups = parts(list(range(64)))
    if refined:
        groups = [g + more for g in groups for more in parts([b for b in range(64) if b not in g])]
    values = [sum(1 << b for b in g) for g in groups]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE_ROWS, refined: bool | None = None) -> DataFrame:
    """(a, b) links that connect exactly what all pairs within the radius would connect.

    `distinct` has one row per fingerprint (fp long).
    """
    if refined is None:
        refined = distinct.count() > REFINE_ROWS
    groups = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(m).alias("mask")) for i, m in enumerate(masks(radius, refined))])
    rows = (
        distinct.select("fp", F.explode(groups).alias("g"))
        .select("fp", F.col("g.m").alias("m"), F.col("fp").bitwiseAND(F.col("g.mask")).alias("v"))
    )
    sizes = rows.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    placed = rows.join(sizes, ["m", "v"]).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    cells = placed.select(
        "fp", "m", "v", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u")
    ).select(
        "m", "v", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), "t", F.bit_count("fp").alias("ones"), "fp"
    )
    spread = cells.repartition("m", "v", "x", "y").sortWithinPartitions("m", "v", "x", "y", "ones", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            a, b = _forest(cell["fp"], cell["t"] == cell["x"][0], bool(cell["x"][0] == cell["y"][0]), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return spread.mapInArrow(compare, "a long, b long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Cells of a partition that is sorted by cell."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        rows = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        if held is not None:
            rows = {name: np.concatenate([held[name], rows[name]]) for name in rows}
        if not len(rows["fp"]):
            continue
        new = np.zeros(len(rows["fp"]), bool)
        for name in ("m", "v", "x", "y"):
            new[1:] |= rows[name][1:] != rows[name][:-1]
        bounds = [0, *np.flatnonzero(new).tolist()]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e - s > 1:
                yield {name: values[s:e] for name, values in rows.items()}
        held = {name: values[bounds[-1]:] for name, values in rows.items()}
    if held is not None and len(held["fp"]) > 1:
        yield held


def _forest(fps: np.ndarray, left: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of a cell. `fps` ascend by population count.

    A cell of one tile compares it with itself, a cell of two tiles only across them.
    """
    values = fps.view(np.uint64)
    ones = np.bitwise_count(values)
    label = np.arange(len(fps))
    rows = np.arange(len(fps)) if same else np.flatnonzero(left)
    others = rows if same else np.flatnonzero(~left)
    for at in range(0, len(rows), BLOCK_ROWS):
        own = rows[at:at + BLOCK_ROWS]
        for to in range(at if same else 0, len(others), BLOCK_ROWS):
            other = others[to:to + BLOCK_ROWS]
            if int(ones[other[0]]) - int(ones[own[-1]]) > radius:
                break
            if int(ones[own[0]]) - int(ones[other[-1]]) > radius:
                continue
            near = np.bitwise_count(values[own][:, None] ^ values[other][None, :]) <= radius
            if same and at == to:
                near &= own[:, None] < other[None, :]
            for i in np.flatnonzero(near.any(axis=1)):
                found = np.unique(np.append(label[other[near[i]]], label[own[i]]))
                if len(found) > 1:
                    label[np.isin(label, found)] = found[0]
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def groups(fps: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of `fps` (key, fp) with `label`, the same for all of a group, and
    `component_id`, the smallest key of the group (null if none of its rows has one)."""
    distinct = checkpoint(fps.groupBy("fp").agg(F.min(key).alias("low")))
    labels = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(labels, "fp", "left")
    lowest = named.filter("label is not null").groupBy("label").agg(F.min("low").alias("lowest"))
    # one group may hold a third of all fingerprints: looked up from a measured broadcast, or salted
    places = checkpoint(lookup_join(named, checkpoint(lowest), "label", "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"),
        F.when(F.col("label").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"),
    ))
    # both sides are tables, so Spark splits the rows of a fingerprint that many documents share
    return fps.join(places, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = checkpoint(fingerprints(docs))
    return groups(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group: the one with the smallest doc_id.

    A group without any doc_id keeps one row. Rows that share their doc_id with other rows
    of the group count as copies.
    """
    placed = checkpoint(groups(checkpoint(fingerprints(docs))))
    kept = placed.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__kept_id"), F.col("fp").alias("__kept_fp"), F.col("label").alias("__kept_label")
    )
    chosen = docs["doc_id"].eqNullSafe(F.col("__kept_id"))
    # rows of an id that repeats are told apart by their fingerprints, kept once or more
    several_rows = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("__kept_id"))
    repeated = checkpoint(several_rows)
    if repeated.isEmpty():
        return docs.join(kept, chosen, "left_semi")
    same = F.col("other").eqNullSafe(F.col("__kept_id"))
    others = repeated.withColumnRenamed("__kept_id", "other")
    several = _with_fingerprint(docs.join(repeated, chosen, "left_semi"))
    places = kept.join(others, same, "left_semi").distinct()
    once = several.join(
        places, several["doc_id"].eqNullSafe(places["__kept_id"]) & (F.col("__fp") == F.col("__kept_fp"))
    ).dropDuplicates(["__kept_id", "__kept_label"]).select(*[several[c] for c in docs.columns])
    return docs.join(kept.join(others, same, "left_anti"), chosen, "left_semi").union(once)


def _with_fingerprint(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            fps = np.fromiter(map(fingerprint, texts), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "__fp"])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))
