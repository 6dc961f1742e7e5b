"""Vectors for texts: a pluggable embedder, and a default that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lodestone import config
from lodestone.functions import text as tx

Embedder = Callable[[Column], Column]

# Rows whose sums stay in a cache of the processor.
_ROWS_PER_BLOCK = 128


def _term_digests(terms: pa.Array) -> pa.ListArray:
    """The first 32 bits of the MD5 digest of each term, as a number; a term of a batch is hashed once."""
    coded = terms.flatten().dictionary_encode()
    heads = [hashlib.md5(t, usedforsecurity=False).digest()[:4] for t in coded.dictionary.cast(pa.binary()).to_pylist()]
    known = np.frombuffer(b"".join(heads), ">u4").astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))))
    values = known[coded.indices.to_numpy(zero_copy_only=False)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _unit_vectors(digests: pa.Array, dim: int) -> np.ndarray:
    """Lowest bit: sign. The rest: bucket. Summed per row and scaled to length one."""
    offsets = np.asarray(digests.offsets)
    values = np.asarray(digests.values)[offsets[0]:offsets[-1]]
    rows = np.repeat(np.arange(len(digests)), np.diff(offsets))
    cells = rows * dim + values // 2 % dim
    sums = np.bincount(cells, weights=1.0 - 2.0 * (values % 2), minlength=len(digests) * dim)
    sums = sums.reshape(len(digests), dim)
    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return (sums / np.where(norms == 0.0, 1.0, norms)).astype(np.float32)


def as_list_array(vectors: np.ndarray) -> pa.ListArray:
    n, dim = vectors.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))


def hash_embedder(dim: int = config.EMBEDDING_DIM) -> Embedder:
    """Signed feature hashing (Weinberger et al. 2009), no shuffle: each text stays in its row."""

    @F.arrow_udf("array<float>")
    def unit_vectors(terms: pa.Array) -> pa.Array:
        digests = _term_digests(terms)
        blocks = [
            _unit_vectors(digests.slice(i, _ROWS_PER_BLOCK), dim)
            for i in range(0, len(digests), _ROWS_PER_BLOCK)
        ]
        return as_list_array(np.concatenate(blocks) if blocks else np.zeros((0, dim), np.float32))

    return lambda text: unit_vectors(F.coalesce(tx.tokens(text), F.array().cast("array<string>")))


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Embedder:
    """A user's model. `load` runs once per Python worker and returns texts -> matrix."""
    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            matrix = np.asarray(model(batch.to_pylist()), dtype=np.float32)
            yield as_list_array(matrix)

    return vectors


def embed(
    df: DataFrame, text_col: str, embedder: Embedder | None = None, spread_by: str | None = None
) -> DataFrame:
    """Adds `embedding`. Use the same embedder for chunks and for queries.

    Vectors cost far more than moving their texts. With `spread_by`, usually the chunk id, the
    texts are first spread evenly, whatever the sizes of the input splits and files are.
    """
    placed = df.repartition(spread_by) if spread_by else df
    return placed.withColumn("embedding", (embedder or hash_embedder())(F.col(text_col)))


def check_dim(df: DataFrame, dim: int = config.EMBEDDING_DIM, on_error: str = "raise") -> DataFrame:
    """Guards the fixed dimension: `raise` fails the job, `keep` and `reject` split the rows."""
    good = F.coalesce(F.size("embedding") == dim, F.lit(False))
    if on_error == "keep":
        return df.where(good)
    if on_error == "reject":
        return df.where(~good)
    if on_error != "raise":
        raise ValueError(f"unknown on_error {on_error!r}")
    message = F.concat(F.lit(f"expected {dim} dimensions, got "), F.coalesce(F.size("embedding"), F.lit(0)))
    return df.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(message)))
