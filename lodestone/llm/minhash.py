"""Document fingerprints: MinHash signatures, likeness, verified near-duplicate classes.

A document is the set of its five-word shingles (a shorter text: its whole word sequence; no
word: the empty set). `SLOTS` universal hash functions a * x + b modulo 2^64 with odd a are
applied to all shingle hashes with numpy, and each slot keeps 16 mixed bits of its minimum.
Equal texts have equal fingerprints; the share of equal slots estimates the Jaccard
similarity.

`near_classes` joins bands of slots in Spark and verifies the exact Jaccard similarity of
every pair that the bands bring together. A bucket larger than a tile is cut into tiles, and
every pair of its tiles is one cell, so no bucket is capped and none sits in one task. Only a
spanning forest leaves a cell. A pair can stay unlinked only if it shares no band.

Null texts count as empty; two empty sets are alike with likeness 1. Rows may repeat; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import words as W
from lodestone.llm.components import components
from lodestone.llm.tables import checkpoint, partitions, spread

SHINGLE_WORDS = 5
SLOTS = 256
#: 32 bands of 8 slots: a pair at similarity 0.8 shares none with a chance of 0.003.
BANDS = 32
SIMILARITY = 0.8
#: Sets of a tile, and shingles of a tile, about. A cell holds two tiles at most.
TILE_ROWS = 1024
TILE_SHINGLES = 2_000_000
#: Rows of one range of documents, the unit in which neighbours are found, and how many ranges
#: there are at most. A range is sorted and streamed, so a larger one needs no more memory.
RANGE_ROWS = 4096
MAX_RANGES = 20_000
_SEED = 20240229


def _functions(slots: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(_SEED)
    a = draw.integers(0, 1 << 64, slots, np.uint64) | np.uint64(1)
    return a, draw.integers(0, 1 << 64, slots, np.uint64)


def signatures(texts: pa.Array, slots: int = SLOTS) -> np.ndarray:
    """(rows, slots) uint16; an empty set has zeros."""
    a, b = _functions(slots)
    out = np.zeros((len(texts), slots), np.uint16)
    batch, at = pa.record_batch([texts], names=["text"]), 0
    for part in W.slices(batch, "text"):
        values, doc = W.shingles(W.cut(part.column(0)), SHINGLE_WORDS)
        if len(values):
            rows, first = np.unique(doc, return_index=True)
            minima = np.empty((len(rows), slots), np.uint64)
            for k in range(slots):
                minima[:, k] = np.minimum.reduceat(values * a[k] + b[k], first)
            out[at + rows] = (W.mix(minima) >> np.uint64(48)).astype(np.uint16)
        at += part.num_rows
    return out


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).mean(axis=1) if len(left) else np.zeros(0)


def _hex(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows.astype(">u2")]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _ranges(docs: DataFrame) -> list[int]:
    """Lower bounds of consecutive ranges of doc_id with about RANGE_ROWS rows each.

    They come from a seeded sample of ids: about 16 for every range at most.
    """
    rows = docs.count()
    n = min(MAX_RANGES, max(partitions(docs.sparkSession), rows // RANGE_ROWS))
    ids = docs.filter("doc_id is not null").select("doc_id")
    if rows > 16 * n:
        ids = ids.filter(spread("doc_id", _SEED) < 16 * n / rows)
    seen = np.sort(ids.toArrow().column(0).to_numpy())
    if not len(seen):
        return []
    return np.unique(seen[(np.arange(1, n) * len(seen)) // n]).tolist()


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, ahead) in ascending doc_id within each partition, and the number of partitions.

    A partition is one range of doc_id, followed by the row after its last one (`ahead` 1),
    so that every row finds the next document beside it; after the last document comes the
    first. Null ids come first, rows with equal ids follow their texts.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = _ranges(docs)
    n = len(bounds) + 1
    limits = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place_of(ids: pd.Series) -> pd.Series:
        places = np.searchsorted(limits, ids.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(ids.isna(), 0, places))

    placed = docs.withColumn("place", place_of(F.col("doc_id").cast("long")))
    first = sorted(
        (row["place"], row["low"] is not None, row["low"])
        for row in placed.groupBy("place").agg(
            F.when(F.count("doc_id") == F.count(F.lit(1)), F.min("doc_id")).alias("low")
        ).collect()
    )
    if not first:
        return placed.select("doc_id", "text", F.lit(0).alias("ahead")).limit(0), 1
    spark = docs.sparkSession
    targets = [(first[i][2], first[i - 1][0]) for i in range(len(first))]
    heads = spark.createDataFrame(targets, "low long, target int")
    ahead = (
        docs.join(F.broadcast(heads), docs["doc_id"].cast("long").eqNullSafe(heads["low"]))
        .groupBy("doc_id", "target").agg(F.min("text").alias("text"))
        .select("doc_id", "text", F.lit(1).alias("ahead"), F.col("target").alias("place"))
    )
    rows = placed.select("doc_id", "text", F.lit(0).alias("ahead"), "place").unionByName(ahead)
    return rows.repartitionById(n, "place").drop("place").sortWithinPartitions("ahead", "doc_id", "text"), n


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, _ = with_next(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for part in W.slices(batch, "text", 4 * W.SLICE_BYTES):
                if held is not None and held.num_rows:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                if part.num_rows > 1:
                    yield _describe(part)
                held = part.slice(part.num_rows - 1)

    return rows.mapInArrow(
        scan,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _describe(part: pa.RecordBatch) -> pa.RecordBatch:
    """All rows of the batch but the last, which is only the next of the one before."""
    texts = part.column("text").to_pylist()
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own = signatures(part.column("text"))
    after = signatures(pa.array(changed, pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id").slice(0, len(changed)),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(_hex(own[:-1])),
            pa.array(_hex(after)),
            pa.array(likeness(own[:-1], after)),
            pa.array(likeness(own[:-1], own[1:])),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _bands(texts: DataFrame) -> DataFrame:
    """(id, bands array of 64-bit keys) per row of (id, text)."""
    width = SLOTS // BANDS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = signatures(batch.column("text")).reshape(batch.num_rows, BANDS, width)
            keys = np.zeros((batch.num_rows, BANDS), np.uint64)
            for k in range(width):
                keys = W.mix(keys + slots[:, :, k] + np.uint64(1))
            bands = pa.array(list(W.signed(keys)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), bands], names=["id", "bands"])

    return texts.select("id", "text").mapInArrow(scan, "id long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(id, shingles array of distinct hashes) per row of (id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                values, doc = W.shingles(W.cut(part.column("text")), SHINGLE_WORDS)
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sets = [W.signed(np.unique(values[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
                )

    return texts.select("id", "text").mapInArrow(scan, "id long, shingles array<long>")


def _alike(rows: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of a cell, by exact Jaccard similarity.

    A cell of one tile compares it with itself, a cell of two tiles only across them.
    """
    order = np.argsort([len(s) for s in rows["shingles"]], kind="stable")
    ids, sets = rows["id"][order], [rows["shingles"][i] for i in order]
    left, same = (rows["t"] == rows["x"][0])[order], rows["x"][0] == rows["y"][0]
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    label, flag = np.arange(len(ids)), np.zeros(len(values), bool)
    for i in range(len(ids) - 1):
        # sizes ascend: a larger set than this cannot be alike
        stop = int(np.searchsorted(sizes * similarity, sizes[i] * (1 + 1e-9), side="right"))
        later = np.arange(i + 1, stop)
        later = later[label[later] != label[i]]
        if not same:
            later = later[left[later] != left[i]]
        if not len(later):
            continue
        own = codes[ends[i]:ends[i + 1]]
        flag[own] = True
        low, high = ends[later[0]], ends[later[-1] + 1]
        hits = np.concatenate(([0], np.cumsum(flag[codes[low:high]])))
        common = hits[ends[later + 1] - low] - hits[ends[later] - low]
        flag[own] = False
        union = sizes[i] + sizes[later] - common
        near = later[(union == 0) | (common >= similarity * union)]
        found = np.unique(np.append(label[near], label[i]))
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return ids[linked], ids[label[linked]]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Cells of a partition that is sorted by cell."""
    held: list[pa.RecordBatch] = []
    key = None

    def whole() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held)
        out = {name: table.column(name).to_numpy() for name in ("id", "t", "x", "y")}
        return out | {"shingles": table.column("shingles").to_numpy()}

    for batch in batches:
        keys = [batch.column(name).to_numpy() for name in ("band", "key", "x", "y")]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if s == e:
                continue
            this = tuple(int(k[s]) for k in keys)
            if held and this != key:
                yield whole()
                held = []
            key = this
            held.append(batch.slice(s, e - s))
    if held:
        yield whole()


def _links(buckets: DataFrame, shingles: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(a, b) links that connect exactly what all pairs alike of all buckets would connect.

    A bucket larger than a tile is cut into tiles, every pair of its tiles is one cell, and
    Spark places the cells. Buckets of the same members are compared once.
    """
    members = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.lit(_SEED), "id")), F.min("id")]
    names = ["n", "h", "g", "low"]
    sizes = buckets.join(shingles.select("id", F.size("shingles").cast("long").alias("size")), "id").groupBy("band", "key").agg(
        *[m.alias(c) for m, c in zip(members, names, strict=True)], F.sum("size").alias("volume")
    ).filter("n > 1").dropDuplicates(names)
    tiles = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("volume") / TILE_SHINGLES)).cast("int")
    chosen = checkpoint(sizes.select("band", "key", tiles.alias("tiles")))
    placed = buckets.join(chosen, ["band", "key"])
    placed = placed.withColumn("t", F.pmod(F.xxhash64(F.lit(_SEED), "id"), F.col("tiles")).cast("int"))
    cells = placed.select(
        "band", "key", "id", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u")
    ).select("band", "key", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), "t", "id")
    order = ["band", "key", "x", "y"]
    rows = cells.join(shingles, "id").repartition(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            a, b = _alike(cell, similarity)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE_ROWS) -> DataFrame:
    """doc_id and class_id, the smallest doc_id that verified links reach.

    Equal texts are one node, told apart by a hash, and are not compared.
    """
    text = F.coalesce("text", F.lit(""))
    node = F.xxhash64(F.sha2(text, 256))
    nodes = checkpoint(docs.select("doc_id", node.alias("id")))
    texts = docs.select(node.alias("id"), text.alias("text")).dropDuplicates(["id"])
    buckets = checkpoint(_bands(texts).select("id", F.posexplode("bands").alias("band", "key")))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    buckets = checkpoint(buckets.join(shared, ["band", "key"]))
    # only texts that share a band with another one are compared
    shingles = checkpoint(_sets(texts.join(buckets.select("id").distinct(), "id", "left_semi")))
    labels = components(checkpoint(_links(buckets, shingles, similarity, tile)))
    labelled = nodes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    lowest = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return labelled.join(lowest, "label").select("doc_id", "class_id")
