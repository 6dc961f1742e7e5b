"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document is the set of its 4-word shingles (fewer words: the whole sequence; no word: the
empty set, linked with nothing). Each of `PERMUTATIONS` hash functions a * x + b modulo 2^64
is evaluated once on all shingles, and both its minimum and its maximum are kept: two slots
for one evaluation, of which each agrees between two sets with a chance equal to their Jaccard
similarity. Minima of five functions form one band and their maxima another, 40 bands in all,
so a pair at similarity 0.8 shares none with a chance of about 1 in 8 million.

Documents that share a band are compared on their sets, exactly. A bucket larger than a tile
is cut into tiles and every pair of its tiles is one cell, so no bucket is capped and none
sits in one task; only a spanning forest leaves a cell. Bands are taken up in rounds: documents
that earlier rounds connected are not compared again, and buckets of one component are skipped,
so sets travel about once however many bands two copies share.

Equal texts are one node and are not compared. Null texts count as empty. Rows may repeat; a
row with a null id is a document, its component is named by the smallest id in it (null without
any, and then such rows are kept). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import words as W
from lodestone.llm.components import components
from lodestone.llm.tables import checkpoint
from lodestone.plans.sizing import lookup_join

SHINGLE_WORDS = 4
PERCENT = 80
PERMUTATIONS = 100
#: Slots of a band.
BAND_ROWS = 5
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: Bands that have been taken up after each round.
ROUNDS = (2, 8, BANDS)
#: Documents and shingles of a tile, about. A cell holds two tiles at most.
TILE_ROWS = 1024
TILE_SHINGLES = 1_000_000
_SEED = 20250413


def _functions(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(_SEED)
    a = draw.integers(0, 1 << 64, permutations, np.uint64) | np.uint64(1)
    return a, draw.integers(0, 1 << 64, permutations, np.uint64)


def extremes(values: np.ndarray, first: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima (sets, permutations) of consecutive sets that start at `first`."""
    a, b = _functions(permutations)
    low = np.empty((len(first), permutations), np.uint64)
    high = np.empty_like(low)
    for k in range(permutations):
        hashed = values * a[k] + b[k]
        low[:, k] = np.minimum.reduceat(hashed, first)
        high[:, k] = np.maximum.reduceat(hashed, first)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(sets, BANDS): minima of five functions make a band, their maxima the next."""
    keys = np.zeros((len(low), low.shape[1] // BAND_ROWS, 2), np.uint64)
    for k in range(BAND_ROWS):
        keys[:, :, 0] = W.mix(keys[:, :, 0] + low[:, k::BAND_ROWS])
        keys[:, :, 1] = W.mix(keys[:, :, 1] + high[:, k::BAND_ROWS])
    return keys.reshape(len(low), -1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with the shingle hashes of all their texts, and where each row's begin."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            values, doc = W.shingles(W.cut(part.column("text"), lower=True), SHINGLE_WORDS)
            yield part, values, np.searchsorted(doc, np.arange(part.num_rows + 1))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_shingles, bands) for every row; bands are null for the empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, ends in _sets(batches):
            sizes = np.array([len(np.unique(values[a:b])) for a, b in zip(ends, ends[1:], strict=False)], np.int64)
            filled = np.flatnonzero(sizes)
            bands = np.full(part.num_rows, None, object)
            if len(filled):
                bands[filled] = list(W.signed(band_keys(*extremes(values, ends[filled]))))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(sizes), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n_shingles", "bands"],
            )

    rows = _with_digest(docs).select("doc_id", "digest", "text")
    return rows.mapInArrow(scan, f"doc_id {kind}, digest binary, n_shingles long, bands array<long>")


def _with_digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes (node, digest) that are wanted, read again from their texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, ends in _sets(batches):
            found = [W.signed(np.unique(values[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    texts = _with_digest(docs).join(wanted, "digest").select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(scan, "node long, shingles array<long>")


def confirmed(cell: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a cell that connect what all its pairs of enough similarity would connect.

    A cell of one tile compares it with itself, a cell of two tiles only across them. Rows
    that share a label are connected already.
    """
    order = np.argsort(np.fromiter(map(len, cell["shingles"]), np.int64, len(cell["node"])), kind="stable")
    nodes, sets = cell["node"][order], [cell["shingles"][i] for i in order]
    side, across = cell["t"][order] == cell["x"][0], cell["x"][0] != cell["y"][0]
    label = np.unique(cell["label"][order], return_inverse=True)[1]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mine = np.zeros(int(codes.max()) + 1, np.int8)
    a: list[int] = []
    b: list[int] = []
    for i in range(len(nodes) - 1):
        # a larger set than this shares too little even if it holds the whole of this one
        stop = int(np.searchsorted(sizes, 100 * sizes[i] // percent, side="right"))
        others = np.arange(i + 1, stop)
        others = others[(label[others] != label[i]) & ((side[others] != side[i]) | (not across))]
        if not len(others):
            continue
        own = codes[starts[i]:starts[i] + sizes[i]]
        mine[own] = 1
        low, high = starts[others[0]], starts[others[-1]] + sizes[others[-1]]
        seen = np.concatenate(([0], np.cumsum(mine[codes[low:high]], dtype=np.int64)))
        mine[own] = 0
        common = seen[starts[others] + sizes[others] - low] - seen[starts[others] - low]
        for j in others[100 * common >= percent * (sizes[i] + sizes[others] - common)]:
            if label[j] != label[i]:
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
    return nodes[a], nodes[b]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The cells of a partition that is sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        bounds = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), batch.num_rows]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if s == e:
                continue
            if held and held[0].column("cell")[0].as_py() != cells[s]:
                yield _whole(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(parts)
    return {name: table.column(name).to_numpy() for name in table.column_names}


def links(buckets: DataFrame, sets: DataFrame, percent: int = PERCENT, tile: int = TILE_ROWS) -> DataFrame:
    """(a, b) links that connect exactly what all pairs of enough similarity within a bucket would connect.

    buckets: (band, key, node, size, label); nodes with one label count as connected. Buckets
    of one label are skipped, buckets of the same nodes are compared once.
    """
    members = {
        "n": F.count(F.lit(1)), "h": F.bit_xor(F.xxhash64("node")), "g": F.bit_xor(F.xxhash64(F.lit(_SEED), "node")),
        "volume": F.sum("size"), "low": F.min("label"), "high": F.max("label"),
    }
    several = buckets.groupBy("band", "key").agg(*[m.alias(c) for c, m in members.items()]).filter("low < high")
    tiles = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("volume") / TILE_SHINGLES)).cast("int")
    chosen = several.dropDuplicates(["n", "h", "g"]).select("band", "key", tiles.alias("tiles"))
    chosen = checkpoint(chosen.withColumn("bucket", F.monotonically_increasing_id()))
    placed = buckets.join(chosen, ["band", "key"])
    placed = placed.withColumn("t", F.pmod(F.xxhash64(F.lit(_SEED), "node"), F.col("tiles")).cast("int"))
    cells = placed.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "bucket", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), "t", "node", "label"
    )
    order = ["bucket", "x", "y"]
    rows = cells.join(sets, "node").repartition(*order).sortWithinPartitions(*order)
    # cells are told apart by one number; neighbours in the sorted partition never share it by chance
    rows = rows.withColumn("cell", F.xxhash64(*order))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            if len(cell["node"]) > 1:
                a, b = confirmed(cell, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.select("cell", "x", "y", "t", "node", "label", "shingles").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, tile: int = TILE_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    rows = checkpoint(described(docs))
    distinct = rows.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("low"), F.max("n_shingles").alias("size"), F.any_value("bands").alias("bands")
    )
    nodes = checkpoint(distinct.withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    buckets = checkpoint(banded.join(shared, ["band", "key"]))
    wanted = nodes.select("node", "digest").join(buckets.select("node").distinct(), "node", "left_semi")
    sets = checkpoint(shingle_sets(docs, checkpoint(wanted)))
    labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    found: DataFrame | None = None
    for first, last in zip((0, *ROUNDS), ROUNDS, strict=False):
        part = buckets.filter((F.col("band") >= first) & (F.col("band") < last)).join(labels, "node", "left")
        part = part.withColumn("label", F.coalesce("label", "node"))
        fresh = checkpoint(links(part, sets, percent, tile))
        found = fresh if found is None else found.union(fresh)
        labels = checkpoint(components(found))
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = checkpoint(named.groupBy("label").agg(F.min("low").alias("component_id")))
    # one component may hold a third of all nodes: looked up from a measured broadcast, or salted
    places = checkpoint(lookup_join(named.select("digest", "label", "node"), lowest, "label", "node").select("digest", "component_id"))
    # both sides are tables, so Spark splits the rows of a text that many documents share
    linked = rows.filter("n_shingles > 0").join(places, "digest").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
