"""Exact vector search: block products in the tasks, only the best k leave a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from lodestone import config
from lodestone.operators.ranking import top_k

_SCALE = 10**config.SCORE_DECIMALS
# A place that no hit has taken; below every score, and its negative is a number too.
_NONE = np.int64(-(1 << 62))
# Queries of a block and values of their vectors, at most.
_QUERY_BLOCK = 32_768
_BLOCK_VALUES = 2_097_152
# Scores held at a time: queries of a block x corpus rows.
_CELLS = 4_000_000


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows scaled to unit length, in double precision; a zero vector stays zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = np.asarray(vectors.offsets)
    flat = np.asarray(vectors.values)[offsets[0]:offsets[-1]].astype(np.float64)
    rows = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0.0, 1.0, norms)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best whole-number scores; equal scores by ascending id. Ids are unique."""
    order = np.argsort(ids, kind="stable")
    n = len(ids)
    keys = scores[:, order] * n + np.arange(n - 1, -1, -1)
    k = min(k, n)
    at = np.argpartition(keys, n - k, axis=1)[:, n - k:]
    picked = order[at]
    return np.take_along_axis(scores, picked, axis=1), ids[picked]


class _Running:
    """The best k per query over the batches of one task. Only scores that reach the worst of a query's k are looked at."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray | None, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.scores = np.full((len(query_ids), k), _NONE, np.int64)
        self.ids: np.ndarray | None = None

    def add(self, ids: np.ndarray, vectors: np.ndarray, chosen: np.ndarray | None = None) -> None:
        """Corpus rows for all queries, or for the `chosen` ones."""
        if not len(ids):
            return
        chosen = np.arange(len(self.query_ids)) if chosen is None else chosen
        products = self.queries[chosen] @ vectors.T
        products *= _SCALE
        np.rint(products, out=products)
        self.offer(ids, products, chosen)

    def offer(self, ids: np.ndarray, products: np.ndarray, chosen: np.ndarray, least: float = -np.inf) -> None:
        """Whole-number scores (chosen, ids); those below `least` are none."""
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, ids.dtype)
        elif ids.dtype.itemsize > self.ids.dtype.itemsize:
            self.ids = self.ids.astype(ids.dtype)
        worst = self.scores[chosen].min(axis=1)
        fresh = worst == _NONE
        if fresh.any():
            # nothing to compare with yet
            scores, names = _best(products[fresh].astype(np.int64), ids, self.k)
            some = scores >= least
            self._merge(np.repeat(chosen[fresh], some.sum(axis=1)), scores[some], names[some])
        row, at = np.nonzero(products >= np.where(fresh, np.inf, worst.astype(np.float64))[:, None])
        if len(row):
            self._merge(chosen[row], products[row, at].astype(np.int64), ids[at])

    def _merge(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(query)
        query = np.concatenate([np.repeat(touched, self.k), query])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -scores, query))
        first = np.searchsorted(query[order], touched)
        keep = order[first[:, None] + np.arange(self.k)]
        self.scores[touched], self.ids[touched] = scores[keep], ids[keep]

    def result(self, id_name: str, id_type: pa.DataType) -> pa.RecordBatch | None:
        if self.ids is None:
            return None
        held = self.scores != _NONE
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.query_ids, held.sum(axis=1))),
                pa.array(self.ids[held].tolist(), type=id_type),
                pa.array(self.scores[held] / _SCALE),
            ],
            names=["query_id", id_name, "score"],
        )


def _ids(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _blocks(batch: pa.RecordBatch, n_queries: int, vectors: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that bound the scores held at a time, and the values of column `vectors` in double precision."""
    width = len(batch.column(vectors).flatten()) // max(batch.num_rows, 1)
    rows = max(64, min(_CELLS // max(n_queries, 1), _BLOCK_VALUES // max(width, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _with_vector(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that carry a vector."""
    some = pc.fill_null(pc.greater(pc.list_value_length(batch.column(1)), 0), False)
    return batch if pc.all(some, min_count=0).as_py() else batch.filter(some)


def _against(query_ids: np.ndarray, queries: np.ndarray, k: int, id_name: str, id_type: pa.DataType) -> Callable:
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Running(query_ids, queries, k)
        for batch in batches:
            for block in _blocks(_with_vector(batch), len(query_ids), 1):
                best.add(_ids(block.column(0)), _matrix(block.column(1)))
        result = best.result(id_name, id_type)
        if result is not None:
            yield result

    return step


def _per_cell(k: int, id_name: str, id_type: pa.DataType) -> Callable:
    """Rows come sorted by cell, queries first: hold one query block, stream the corpus past it."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None

        def flush():
            return best.result(id_name, id_type) if best is not None else None

        for batch in batches:
            cells = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2))])
            starts = np.flatnonzero(np.any(np.diff(cells, axis=1) != 0, axis=0)) + 1
            edges = [0, *starts.tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                part = batch.slice(low, high - low)
                now = (cells[0, low], cells[1, low])
                if now != cell:
                    result = flush()
                    if result is not None:
                        yield result
                    cell, held, best = now, [], None
                if cells[2, low] == 0:
                    held.append(part)
                    continue
                if best is None:
                    if not held:
                        continue
                    ids = np.concatenate([np.asarray(p.column(3)) for p in held])
                    best = _Running(ids, np.concatenate([_matrix(p.column(5)) for p in held]), k)
                for block in _blocks(part, len(best.query_ids), 5):
                    best.add(_ids(block.column(4)), _matrix(block.column(5)))
        result = flush()
        if result is not None:
            yield result

    return step


def blocks_of(queries: DataFrame) -> tuple[int, int]:
    """(query blocks, corpus blocks) for queries with an `embedding`.

    A query block has a fixed size. There are as many corpus blocks as query blocks, so each row
    is copied once per block of the other side, or as many as it takes for all cores.
    """
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    query_blocks = max(1, -(-n // _QUERY_BLOCK), -(-n * (width or 1) // _BLOCK_VALUES))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return query_blocks, max(query_blocks, -(-2 * cores // query_blocks))


def _many_queries(corpus: DataFrame, queries: DataFrame, k: int, id_col: str, step, schema) -> DataFrame:
    """Query block x corpus block cells, placed by Spark; nothing passes through the driver."""
    n_query_blocks, n_corpus_blocks = blocks_of(queries)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    id_type = corpus.schema[id_col].dataType
    asked = queries.select(
        block_of("query_id", n_query_blocks).alias("qb"), all_of(n_corpus_blocks).alias("cb"),
        F.lit(0).alias("side"), "query_id", F.lit(None).cast(id_type).alias(id_col), "embedding",
    )
    stored = corpus.select(
        all_of(n_query_blocks).alias("qb"), block_of(id_col, n_corpus_blocks).alias("cb"),
        F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("query_id"), id_col, "embedding",
    )
    cells = asked.unionByName(stored).repartition(n_query_blocks * n_corpus_blocks, "qb", "cb")
    return cells.sortWithinPartitions("qb", "cb", "side").mapInArrow(step, schema)


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = config.TOP_K_EMBEDDING,
    id_col: str = "chunk_id",
    max_queries: int = config.DENSE_MAX_QUERIES,
) -> DataFrame:
    """(query_id, <id_col>, score, rank) by cosine, exact.

    Both tables carry `embedding`; rows without one do not take part. Up to `max_queries`
    queries are sent to every task of the corpus, which is not shuffled. A larger set is
    spread over cells of query block x corpus block.
    """
    corpus = corpus.select(id_col, "embedding")
    queries = queries.select(F.col("query_id").cast("bigint"), "embedding").where(F.size("embedding") > 0)
    is_text = isinstance(corpus.schema[id_col].dataType, StringType)
    id_type = pa.string() if is_text else pa.int64()
    schema = f"query_id bigint, {id_col} {'string' if is_text else 'bigint'}, score double"
    sent = queries.limit(max_queries + 1).toArrow()
    if sent.num_rows > max_queries or sent.nbytes * 2 > config.BROADCAST_MAX_BYTES:
        hits = _many_queries(corpus.where(F.size("embedding") > 0), queries, k, id_col, _per_cell(k, id_col, id_type), schema)
    elif sent.num_rows == 0:
        hits = corpus.sparkSession.createDataFrame([], schema)
    else:
        # The step drops rows without a vector: Spark moves a filter below the placing of the texts, and embeds them twice.
        hits = corpus.mapInArrow(_against(_ids(sent.column(0)), _matrix(sent.column(1)), k, id_col, id_type), schema)
    return top_k(hits, k, id_col)
