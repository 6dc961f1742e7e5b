"""Vector index: vectors stored by the centroid they lie nearest to, searched cell by cell.

Centroids come from spherical k-means over a bounded, seeded sample; every row is then indexed.
A search reads only the cells that it probes: they are partitions of the stored table. Each
cell knows the cosine of its farthest vector, which bounds what the cell can hold for a query;
an exact search goes on with all cells that could still beat the worst hit so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from lodestone import config
from lodestone.operators import vector
from lodestone.operators.ranking import top_k
from lodestone.plans import scratch

#: Most cells of an index, and rows that centroids are fitted on, about.
MAX_CELLS = 4096
SAMPLE_ROWS = 50_000
ROUNDS = 8
PROBES = 8
_SEED = 20250601
_ROUNDING = 10.0**-config.SCORE_DECIMALS


@dataclass
class VectorIndex:
    """A stored index: unit centroids, the least cosine in each cell, the folder of the vectors."""

    spark: SparkSession
    path: str
    id_col: str
    cells: np.ndarray
    centroids: np.ndarray
    least: np.ndarray

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    products = vectors @ centroids.T
    cells = products.argmax(axis=1)
    return cells, products[np.arange(len(cells)), cells]


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0.0, 1.0, norms)


def _totals(batches: Iterator[tuple[int, np.ndarray, int]], width: int) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for cell, total, n in batches:
        sums[cell] = sums.get(cell, np.zeros(width)) + total
        counts[cell] = counts.get(cell, 0) + n
    if sums:
        cells = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int32()), pa.array([counts[c] for c in cells], pa.int64()),
             pa.array([sums[c] for c in cells], pa.list_(pa.float64()))], names=["cell", "n", "total"],
        )


def fit_centroids(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of (id, embedding) rows. What comes to the driver are `cells` rows a round."""
    first = vectors.orderBy(F.xxhash64(F.lit(_SEED), "id"), "id").limit(cells).select("embedding").toArrow()
    centroids = vector._matrix(first.column(0))
    width = centroids.shape[1] if len(centroids) else 0
    schema = "cell int, n long, total array<double>"
    for _ in range(rounds if len(centroids) else 0):
        sent = vectors.sparkSession.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def parts():
                for batch in batches:
                    rows = vector._matrix(batch.column(0))
                    nearest, _ = _nearest(rows, sent.value)
                    for cell in np.unique(nearest).tolist():
                        own = rows[nearest == cell]
                        yield cell, own.sum(axis=0), len(own)

            return _totals(parts(), width)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def parts():
                for batch in batches:
                    for row in batch.to_pylist():
                        yield row["cell"], np.array(row["total"]), row["n"]

            return _totals(parts(), width)

        moved = vectors.select("embedding").mapInArrow(assign, schema).repartition("cell").mapInArrow(merge, schema).toArrow()
        totals = _unit(np.array(moved.column("total").to_pylist(), np.float64).reshape(-1, width))
        # a cell that lost all its vectors keeps its place
        centroids = centroids.copy()
        centroids[moved.column("cell").to_numpy()] = totals
    return centroids


def build_index(
    corpus: DataFrame, path: str, id_col: str = "chunk_id", cells: int | None = None, sample_rows: int = SAMPLE_ROWS
) -> VectorIndex:
    """Write all rows of `corpus` (<id_col>, embedding) to a new index. Rows without a vector are left out.

    By default there are about as many cells as rows in a cell. Centroids are fitted on about
    `sample_rows` rows, chosen by a hash of the id.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.col(id_col).alias("id"), "embedding").where(F.size("embedding") > 0)
    n = rows.count()
    cells = min(MAX_CELLS, max(1, round(n**0.5))) if cells is None else cells
    chosen = F.pmod(F.xxhash64(F.lit(_SEED + 1), "id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample_rows / max(n, 1)))
    with scratch.run_folder(spark, "centroids") as folder:
        centroids = fit_centroids(scratch.materialize(rows.where(chosen), "sample", folder), cells)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, cosines = _nearest(vector._matrix(batch.column("embedding")), sent.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(cosines)], names=["id", "embedding", "cell", "cosine"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    element = rows.schema["embedding"].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"id {kind}, embedding {element}, cell int, cosine double")
    # the hint gathers a cell and splits one that is too large for a task
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    reach = spark.read.schema("cosine double, cell int").parquet(f"{path}/vectors").groupBy("cell").agg(F.min("cosine").alias("least"))
    held = {r["cell"]: r["least"] for r in reach.collect()}
    kept = sorted(held)
    table = pa.table({
        "cell": pa.array(kept, pa.int32()), "centroid": pa.array([centroids[c] for c in kept], pa.list_(pa.float64())),
        "least": pa.array([held[c] for c in kept], pa.float64()), "id_col": pa.array([id_col] * len(kept), pa.string()),
    })
    spark.createDataFrame(table).write.parquet(f"{path}/centroids")
    return VectorIndex(spark, path, id_col, np.array(kept, np.int64), centroids[kept] if kept else centroids, np.array([held[c] for c in kept]))


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    centroids = np.array(table.column("centroid").to_pylist(), np.float64)
    name = table.column("id_col")[0].as_py() if table.num_rows else "chunk_id"
    return VectorIndex(spark, path, name, table.column("cell").to_numpy(), centroids, table.column("least").to_numpy())


def upper_bounds(cosines: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest cosine a query can have with a vector of a cell.

    Angles obey the triangle inequality: the vector lies at most the widest angle of the cell
    nearer to the query than the centroid does.
    """
    to_centroid = np.arccos(np.clip(cosines, -1.0, 1.0))
    widest = np.arccos(np.clip(least, -1.0, 1.0))
    return np.cos(np.maximum(to_centroid - widest[None, :], 0.0))


def _probes(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, embedding, near): the nearest cells, nearest first."""
    sent = index.spark.sparkContext.broadcast((index.cells, index.centroids))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centroids = sent.value
        for batch in batches:
            cosines = vector._matrix(batch.column(1)) @ centroids.T
            near = cells[np.argsort(-cosines, axis=1, kind="stable")[:, :probes]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["query_id", "embedding", "near"])

    element = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInArrow(rank, f"query_id bigint, embedding {element}, near array<int>")


def _near(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, embedding, mask) with a bit for each of the nearest cells."""
    sent = index.spark.sparkContext.broadcast(index.centroids)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = _nearest_of(vector._matrix(batch.column(1)) @ sent.value.T, probes)
            yield pa.RecordBatch.from_arrays([*batch.columns, _masked(mask)], names=["query_id", "embedding", "mask"])

    element = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInArrow(mark, f"query_id bigint, embedding {element}, mask binary")


def _nearest_of(cosines: np.ndarray, probes: int) -> np.ndarray:
    mask = np.zeros(cosines.shape, bool)
    np.put_along_axis(mask, np.argsort(-cosines, axis=1, kind="stable")[:, :probes], True, axis=1)
    return mask


def _rest(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, embedding, mask) with a bit for each other cell that can reach `worst`, if there is any."""
    sent = index.spark.sparkContext.broadcast((index.centroids, index.least))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, least = sent.value
        for batch in batches:
            cosines = vector._matrix(batch.column(1)) @ centroids.T
            worst = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            reach = np.isnan(worst)[:, None] | (upper_bounds(cosines, least) >= worst[:, None] - 2 * _ROUNDING)
            mask = reach & ~_nearest_of(cosines, probes)
            some = mask.any(axis=1)
            if some.any():
                rows = pa.RecordBatch.from_arrays([*batch.columns[:2], _masked(mask)], names=["query_id", "embedding", "mask"])
                yield rows.filter(pa.array(some))

    element = queries.schema["embedding"].dataType.simpleString()
    return queries.select("query_id", "embedding", "worst").mapInArrow(mark, f"query_id bigint, embedding {element}, mask binary")


def _types(index: VectorIndex) -> tuple[pa.DataType, str]:
    text = isinstance(index.vectors().schema["id"].dataType, StringType)
    return (pa.string() if text else pa.int64()), f"query_id bigint, id {'string' if text else 'bigint'}, score double"


def _wanted(masks: list[bytes]) -> np.ndarray:
    """(cells, queries): whether a query wants a cell, by the bits of its mask."""
    bits = np.frombuffer(b"".join(masks), np.uint8).reshape(len(masks), -1)
    return np.unpackbits(bits, axis=1).astype(bool).T.copy()


def _masked(wanted: np.ndarray) -> pa.Array:
    """The mask of each row of (queries, cells)."""
    return pa.array([row.tobytes() for row in np.packbits(wanted, axis=1)], pa.binary())


class _Cells:
    """The best k of some queries over corpus rows, each met only by the queries that want its cell."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, masks: list[bytes], cells: np.ndarray, k: int):
        self.best, self.wanted = vector._Running(ids, matrix, k), _wanted(masks)
        self.place = {c: i for i, c in enumerate(cells.tolist())}

    def add(self, cells: np.ndarray, ids: pa.Array, vectors: pa.Array) -> None:
        for cell in np.unique(cells).tolist():
            chosen = np.flatnonzero(self.wanted[self.place[cell]])
            if len(chosen):
                own = pa.RecordBatch.from_arrays([ids, vectors], names=["id", "embedding"]).filter(pa.array(cells == cell))
                for block in vector._blocks(own, len(chosen), 1):
                    self.best.add(vector._ids(block.column(0)), vector._matrix(block.column(1)), chosen)


def _score(index: VectorIndex, wanted: DataFrame, k: int, max_queries: int) -> DataFrame:
    """Hits of (query_id, embedding, mask), a bit per cell of the index, or of (query_id, embedding, cell): the
    best k of every task.

    Only the wanted cells are read. A query travels once per block of the corpus, however many
    cells it wants, and a stored vector once per block of queries.
    """
    id_type, schema = _types(index)
    wanted = _of_pairs(index, wanted) if "cell" in wanted.columns else wanted
    sent = wanted.limit(max_queries + 1).toArrow()
    few = sent.num_rows <= max_queries and sent.nbytes * 2 <= config.BROADCAST_MAX_BYTES
    if few and not sent.num_rows:
        return index.spark.createDataFrame([], schema)
    # one mask of the index; Spark does not read the partitions of other cells
    masks = sent.column("mask").to_pylist() if few else [_any_mask(wanted)]
    probed = index.cells[_wanted(masks)[: len(index.cells)].any(axis=1)].tolist()
    stored = index.vectors().where(F.col("cell").isin(probed) if probed else F.lit(False))
    cells = index.cells
    if few:
        ids, matrix = sent.column("query_id").to_numpy(), vector._matrix(sent.column("embedding"))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Cells(ids, matrix, masks, cells, k)
            for batch in batches:
                held.add(batch.column(0).to_numpy(), batch.column(1), batch.column(2))
            result = held.best.result("id", id_type)
            if result is not None:
                yield result

        return stored.select("cell", "id", "embedding").mapInArrow(step, schema)
    query_blocks, corpus_blocks = vector.blocks_of(wanted)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    kind = index.vectors().schema["id"].dataType
    element = index.vectors().schema["embedding"].dataType
    asked = wanted.select(
        block_of("query_id", query_blocks).alias("qb"), all_of(corpus_blocks).alias("cb"), F.lit(-1).alias("cell"),
        "query_id", F.lit(None).cast(kind).alias("id"), F.col("embedding"), "mask",
    )
    held = stored.select(
        all_of(query_blocks).alias("qb"), block_of("id", corpus_blocks).alias("cb"), "cell", F.lit(None).cast("bigint").alias("query_id"),
        "id", F.col("embedding").cast(element), F.lit(None).cast("binary").alias("mask"),
    )
    placed = asked.unionByName(held).repartition(query_blocks * corpus_blocks, "qb", "cb").sortWithinPartitions("qb", "cb", "cell")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, best = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)) < 0])
            starts = np.flatnonzero(np.any(np.diff(keys, axis=1) != 0, axis=0)) + 1
            edges = [0, *starts.tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                part = batch.slice(low, high - low)
                if (keys[0, low], keys[1, low]) != now:
                    if best is not None and (result := best.best.result("id", id_type)) is not None:
                        yield result
                    now, parts, best = (keys[0, low], keys[1, low]), [], None
                if keys[2, low]:
                    parts.append(part)
                elif best is not None or parts:
                    if best is None:
                        best = _Cells(
                            np.concatenate([np.asarray(p.column(3)) for p in parts]), np.concatenate([vector._matrix(p.column(5)) for p in parts]),
                            [m for p in parts for m in p.column(6).to_pylist()], cells, k,
                        )
                        parts = [part.slice(0, 0)]
                    best.add(np.asarray(part.column(2)), part.column(4), part.column(5))
        if best is not None and (result := best.best.result("id", id_type)) is not None:
            yield result

    return placed.select("qb", "cb", "cell", "query_id", "id", "embedding", "mask").mapInArrow(step, schema)


def _of_pairs(index: VectorIndex, pairs: DataFrame) -> DataFrame:
    """(query_id, embedding, mask) of (query_id, embedding, cell)."""
    cells = index.cells

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.array([np.isin(cells, own) for own in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _masked(wanted)], names=["query_id", "embedding", "mask"])

    element = pairs.schema["embedding"].dataType.simpleString()
    listed = pairs.groupBy("query_id", "embedding").agg(F.collect_set("cell").alias("cells"))
    return listed.mapInArrow(mark, f"query_id bigint, embedding {element}, mask binary")


def _any_mask(wanted: DataFrame) -> bytes:
    """The cells that any query wants; one row leaves each task."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for mask in batch.column(0).to_pylist():
                bits = np.frombuffer(mask, np.uint8)
                found = bits if found is None else found | bits
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["mask"])

    rows = wanted.select("mask").mapInArrow(merge, "mask binary").collect()
    return np.bitwise_or.reduce([np.frombuffer(r["mask"], np.uint8) for r in rows]).tobytes()


def search(
    index: VectorIndex, queries: DataFrame, k: int = config.TOP_K_EMBEDDING, probes: int = PROBES, exact: bool = False,
    max_queries: int = config.DENSE_MAX_QUERIES,
) -> DataFrame:
    """(query_id, <id_col>, score, rank): the best of the `probes` nearest cells of each query.

    `exact` goes on with every cell whose bound reaches the worst of k hits, and gives what a
    search of all vectors gives. Queries without a vector have no hits.
    """
    if not len(index.cells):
        return index.spark.createDataFrame([], f"query_id bigint, {index.id_col} string, score double, rank int")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding").where(F.size("embedding") > 0)
    found = top_k(_score(index, _near(index, asked, probes), k, max_queries), k, "id")
    if exact:
        found = scratch.materialize(found, "hits")
        worst = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("worst"))
        more = scratch.materialize(_rest(index, asked.join(worst, "query_id", "left"), probes), "rest")
        found = top_k(found.drop("rank").unionByName(_score(index, more, k, max_queries)), k, "id")
    return found.withColumnRenamed("id", index.id_col)


def probes_for(index: VectorIndex, queries: DataFrame, target: float, k: int = config.TOP_K_EMBEDDING) -> int:
    """The fewest probes with which a sample of queries finds the share `target` of its exact hits.

    An exact hit is found if its cell is among the probed ones, so one exact search and the place
    of each hit's cell in its query's order of cells tell the recall of every number of probes.
    """
    hits = search(index, queries, k, exact=True).withColumnRenamed(index.id_col, "id")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding").where(F.size("embedding") > 0)
    order = _probes(index, asked, len(index.cells)).select("query_id", "near")
    held = index.vectors().select("id", "cell").join(hits, "id").join(order, "query_id")
    places = held.groupBy(F.array_position("near", F.col("cell")).alias("place")).count().orderBy("place").collect()
    total, seen = sum(r["count"] for r in places), 0
    for row in places:
        seen += row["count"]
        if seen >= target * total:
            return int(row["place"])
    return PROBES


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    """One row: the share of the exact hits that were found, and how many there are."""
    both = exact.select("query_id", id_col).join(
        found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left"
    )
    return both.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("n"))
