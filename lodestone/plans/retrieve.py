"""Retrieval from end to end, for many queries in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone import config
from lodestone.operators import fusion, keyword, vector
from lodestone.operators.embedding import Embedder, embed
from lodestone.operators.filters import guard_query
from lodestone.plans.sizing import fits_broadcast


def hybrid_search(
    index: DataFrame,
    queries: DataFrame,
    top_k_bm25: int = config.TOP_K_BM25,
    top_k_embedding: int = config.TOP_K_EMBEDDING,
    join_mode: str = config.JOIN_MODE,
    embedder: Embedder | None = None,
    postings: DataFrame | None = None,
    size: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, score, chunk_id, content, metadata): BM25 and vector top-k, fused.

    `index` has `chunk_id`, `content`, `embedding`, `metadata`; `queries` has `query_id`,
    `query`. The vector column does not enter the keyword branch. Stored `postings` and their
    `size` save the tokenizing of the corpus.
    """
    asked = guard_query(queries).where(F.col("status") == "ok")
    vectors = embed(asked, "query", embedder)
    grouped, shown = postings is None, index
    if grouped:
        postings, size, shown = keyword.kept_chunks(index, "content", "metadata")
    lexical = keyword.bm25_topk(asked, postings, top_k_bm25, size, grouped)
    dense = vector.dense_topk(vectors, index, top_k_embedding)
    ranked = fusion.fuse([lexical, dense], join_mode)
    per_query = top_k_bm25 + top_k_embedding
    few = fits_broadcast(asked.select("query_id"), config.BROADCAST_MAX_ROWS // max(per_query, 1))
    return with_chunks(ranked, shown, broadcast=few)


def with_chunks(ranked: DataFrame, index: DataFrame, broadcast: bool) -> DataFrame:
    """Ranked hits with the stored text. `broadcast` when the number of hits is known to be small."""
    rows = index.select("chunk_id", "content", "metadata")
    hits = F.broadcast(ranked) if broadcast else ranked
    return rows.join(hits, "chunk_id").select("query_id", "rank", "score", "chunk_id", "content", "metadata")
