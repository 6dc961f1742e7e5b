"""Toxicity by FTRL-proximal logistic regression over hashed words and word pairs.

Features of a text, each present or not: its words, its neighbouring words, and the words
with one word between them (skip-grams), hashed to 2^BITS places. Every place has its own
learning rate, and the L1 term leaves most weights at exactly zero (McMahan et al. 2013), so
the model that is sent to the tasks is a short list of places and weights.

Null and empty texts have no feature and score what the intercept says. Without any
training row the score is 0 for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm import words as W
from lodestone.llm.tables import known_labels, remainder, sample, spread

#: Labelled rows to learn from, about.
TRAINING_ROWS = 12_000
BITS = 20
ALPHA, BETA, L1, L2 = 2.0, 1.0, 16.0, 0.5
#: A toxic row counts as so many, since most rows are not.
TOXIC_WEIGHT = 3.0
#: Updates to make at least, in whole passes over the training rows.
UPDATES, MIN_PASSES, MAX_PASSES = 24_000, 2, 25
_SKIP = np.uint64(0xA24BAED4963EE407)
#: The place of the intercept, beyond the hashed ones.
INTERCEPT = 1 << BITS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of the rows, and their rows; in row order, repeats included."""
    found = W.cut(texts, W.LETTER_OR_DIGIT_BYTES, lower=True)
    hashes = found.hashes()
    pairs, pair_doc = W.windows(hashes, found.doc, 2)
    n = max(len(hashes) - 2, 0)
    inside = found.doc[:n] == found.doc[2:2 + n]
    skips = W.mix(hashes[:n] * _SKIP + hashes[2:2 + n])[inside]
    values = np.concatenate([hashes, pairs, skips]) >> np.uint64(64 - BITS)
    return values.astype(np.int64), np.concatenate([found.doc, pair_doc, found.doc[:n][inside]])


def train(examples: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places with a weight other than zero, and the weights. examples: distinct places of each row.

    The intercept starts at the weighted share of toxic rows and has no L1 term.
    """
    z, n = np.zeros(INTERCEPT + 1), np.zeros(INTERCEPT + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        held = np.maximum(np.abs(z[at]) - L1, 0.0)
        return -np.sign(z[at]) * held / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    passes = int(np.clip(-(-UPDATES // max(len(examples), 1)), MIN_PASSES, MAX_PASSES))
    draw = np.random.default_rng(seed)
    cost = np.where(labels == 1, TOXIC_WEIGHT, 1.0)
    share = np.clip((cost * labels).sum() / cost.sum(), 0.01, 0.99)
    intercept = np.log(share / (1 - share))
    for _ in range(passes):
        for i in draw.permutation(len(examples)):
            at = examples[i]
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + intercept, -35, 35)))
            g = cost[i] * (p - labels[i])
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[at] = after
            intercept -= 0.02 * g
    w = weights(slice(None))
    w[INTERCEPT] = intercept
    places = np.flatnonzero(w)
    return places, w[places]


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Learns from about `bound` labelled rows, chosen by a hash of doc_id.

    labels: (doc_id, label). Features are made where the texts are; the bounded sample of
    them is learnt from in one task, since each update depends on the one before.
    """
    chosen = F.broadcast(sample(labels, "doc_id", bound, 3))  # at most about `bound` rows of two numbers

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                places, doc = features(part.column("text"))
                keys = np.unique(doc.astype(np.int64) << (BITS + 1) | places)
                ends = np.searchsorted(keys >> (BITS + 1), np.arange(part.num_rows + 1))
                rows = (keys & ((1 << (BITS + 1)) - 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), lists], names=["doc_id", "label", "places"]
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, known = [], []
        for batch in batches:
            lists = batch.column("places")
            flat, ends = np.array(lists.flatten()), np.array(lists.offsets) - lists.offsets[0].as_py()
            examples += [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            known.append(np.array(batch.column("label"), np.float64))
        if known:
            places, weights = train(examples, np.concatenate(known))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(weights)], names=["place", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(
        describe, f"doc_id {kind}, label int, places array<int>"
    )
    ordered = rows.repartition(1).sortWithinPartitions(spread("doc_id", 5), "doc_id", F.hash("places"))
    model = ordered.mapInArrow(learn, "place long, weight double").toArrow()
    return model.column("place").to_numpy(), model.column("weight").to_numpy()


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score) for rows of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS + 1 weights
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(INTERCEPT + 1)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            for part in W.slices(batch, "text"):
                places, doc = features(part.column("text"))
                used = dense[places] != 0
                keys = np.unique(doc[used].astype(np.int64) << (BITS + 1) | places[used])
                sums = np.bincount(keys >> (BITS + 1), dense[keys & ((1 << (BITS + 1)) - 1)], part.num_rows)
                margin = np.clip(sums + dense[INTERCEPT], -35, 35)
                score = 1.0 / (1.0 + np.exp(-margin)) if len(shared.value[0]) else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"]
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(remainder(key, 5) == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels that are not held out, score all: doc_id, held_out, score, predicted."""
    known = known_labels(labels, "toxic").filter(remainder("doc_id", 5) != 0)
    model = fit(docs, known)
    scored = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
