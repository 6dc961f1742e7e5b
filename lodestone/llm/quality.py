"""Text quality by learning from trusted positives and unlabelled text.

Only good texts are labelled; the rest of the web is a mix of good and bad. The classifier
minimises the non-negative unbiased risk (Kiryo et al. 2017): risk of the positives at the
class prior, plus the risk of calling unlabelled text bad less what its good part adds to
it, kept from going below zero. The class prior comes from the best top bin of scores that
tell positives from unlabelled text (Garg et al. 2021).

Features are shares: pairs of neighbouring character classes, repeated words, lines and
five-word windows, word lengths. Null and empty texts have all shares zero. Without trusted
positives or without unlabelled text every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.llm import words as W
from lodestone.llm.tables import known_labels, remainder, sample, spread

#: Trusted positives and unlabelled rows to learn from, about.
POSITIVE_ROWS = 6_000
UNLABELLED_ROWS = 12_000
THRESHOLD = 0.7
STEPS = 500

#: Characters with a class of their own, after upper, lower, digit and space.
MARKS = ".,!?#$%&*|<>-_/@:;'\"()"
_CLASSES = 5 + len(MARKS)
_CLASS = np.full(256, _CLASSES - 1, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        1 if _b >= 0x80 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit()
        else 3 if _c.isspace() else 4 + MARKS.index(_c) if _c in MARKS else _CLASSES - 1
    )
_EXTRA = 7
WIDTH = _CLASSES * _CLASSES + _EXTRA


def _distinct(values: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each row, told apart by 44 bits."""
    keys = np.sort(doc.astype(np.uint64) << np.uint64(44) | values >> np.uint64(20))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> np.uint64(44)).astype(np.int64), minlength=rows)


def describe(texts: pa.Array) -> np.ndarray:
    """(rows, WIDTH) float32 features of whole texts."""
    rows = len(texts)
    found = W.cut(texts)
    data, offsets = found.data, found.offsets
    out = np.zeros((rows, WIDTH), np.float32)
    if not len(data):
        return out
    of = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = _CLASS[data]
    inside = of[1:] == of[:-1]
    codes = of[:-1][inside] * (_CLASSES * _CLASSES) + (kinds[:-1] * _CLASSES + kinds[1:])[inside]
    pairs = np.bincount(codes, minlength=rows * _CLASSES * _CLASSES).reshape(rows, -1)
    size = np.maximum(np.diff(offsets), 1)[:, None]
    out[:, :-_EXTRA] = np.log1p(200.0 * pairs / size)
    hashes, n = found.hashes(), found.counts()
    some = np.maximum(n, 1)
    again = hashes[1:] == hashes[:-1]
    again &= found.doc[1:] == found.doc[:-1]
    windows, window_doc = W.windows(hashes, found.doc, 5)
    runs = np.bincount(window_doc, minlength=rows)
    lines = W.cut(texts, _NOT_NEWLINE)
    n_lines = np.maximum(lines.counts(), 1)
    out[:, -7] = np.log1p(n)
    out[:, -6] = (found.ends - found.starts).sum() and np.bincount(found.doc, found.ends - found.starts, rows) / some
    out[:, -5] = np.bincount(found.doc[1:][again], minlength=rows) / some
    out[:, -4] = 1.0 - _distinct(windows, window_doc, rows) / np.maximum(runs, 1)
    out[runs == 0, -4] = 0.0
    out[:, -3] = (lines.counts() - _distinct(lines.hashes(), lines.doc, rows)) / n_lines
    out[:, -2] = np.sqrt(out[:, -4])
    out[:, -1] = np.sqrt(out[:, -5])
    return out


_NOT_NEWLINE = np.arange(256) != 0x0A


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.intercept
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _descend(width: int, gradient, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam on a vector of weights and an intercept."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        g = gradient(w.astype(np.float32))
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from scores of both on rows not trained on.

    Above a good threshold all unlabelled rows are positive, so the ratio of the two tails
    there is the prior; the threshold is the one with the lowest upper confidence bound.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    tail = lambda s: 1.0 - np.searchsorted(np.sort(s), cuts) / len(s)
    p, u = tail(positive), tail(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / (2 * len(positive))) + np.sqrt(np.log(4 / delta) / (2 * len(unlabelled)))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(p > 0, (u + slack) / p, np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS, decay: float = 1e-3) -> Model:
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    used = np.flatnonzero(scale > 2e-3)  # the others say nothing and get weight zero

    def norm(x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), len(used) + 1), np.float32)
        np.clip((x[:, used] - mean[used]) / scale[used], -8, 8, out=out[:, :-1])
        return out

    p, u = norm(positive), norm(unlabelled)

    def separate(w: np.ndarray) -> np.ndarray:
        gp, gu = -_sigmoid(-(p[::2] @ w)) / len(p[::2]), _sigmoid(u[::2] @ w) / len(u[::2])
        return gp @ p[::2] + gu @ u[::2] + decay * w

    first = _descend(p.shape[1] - 1, separate, steps // 2)
    rest = (p[1::2], u[1::2]) if len(p) > 1 and len(u) > 1 else (p, u)
    prior = class_prior(rest[0] @ first, rest[1] @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        fp, fu = p @ w, u @ w
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = (_sigmoid(fu) / len(u)) @ u - prior * ((_sigmoid(fp) / len(p)) @ p)
        penalty = decay * np.append(w[:-1], 0.0)
        if negative < 0:
            return -g_negative + penalty
        return prior * ((-_sigmoid(-fp) / len(p)) @ p) + g_negative + penalty

    w = _descend(p.shape[1] - 1, risk, steps)
    weights = np.zeros(positive.shape[1])
    weights[used] = w[:-1]
    return Model(mean, scale, weights, float(w[-1]), prior)


def fit(
    docs: DataFrame, positives: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS
) -> Model | None:
    """Learns from about that many trusted positives (doc_id) and rows of `docs`, chosen by a hash of doc_id."""
    share = min(1.0, unlabelled_rows / max(docs.count(), 1))
    trusted = sample(positives.select("doc_id").distinct(), "doc_id", positive_rows, 7)
    trusted = F.broadcast(trusted.withColumn("trusted", F.lit(True)))  # at most about `positive_rows` ids
    rows = docs.select("doc_id", "text").join(trusted, "doc_id", "left").select(
        "doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"),
        (spread("doc_id", 8) < share).alias("unlabelled"),
    ).filter("trusted or unlabelled")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                x = describe(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("trusted"), part.column("unlabelled"), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["doc_id", "trusted", "unlabelled", "x"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        table = pa.concat_tables(tables)
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
        pick = lambda name: x[np.array(table.column(name), bool)]
        p, u = pick("trusted"), pick("unlabelled")
        if len(p) and len(u):
            m = train(p, u)
            flat = np.concatenate([m.mean, m.scale, m.weights, [m.intercept, m.prior]])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["flat"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    described = rows.mapInArrow(scan, f"doc_id {kind}, trusted boolean, unlabelled boolean, x binary")
    ordered = described.repartition(1).sortWithinPartitions(spread("doc_id", 9), "doc_id", "x")
    found = ordered.mapInArrow(learn, "flat array<double>").collect()
    if not found:
        return None
    flat = np.array(found[0]["flat"])
    mean, scale, weights = flat[:-2].reshape(3, WIDTH)
    return Model(mean, scale, weights, float(flat[-2]), float(flat[-1]))


def predict(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """The rows of `docs` with the score in a column of the given name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # four vectors of WIDTH numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = part.column("text")
                score = shared.value.score(describe(texts)) if shared.value else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(remainder(key, 4) == 2, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on documents and positive labels that are not held out."""
    positives = known_labels(labels, "quality").filter("label = 1").filter(remainder("doc_id", 4) != 2)
    return fit(docs.filter(remainder("doc_id", 4) != 2), positives)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score THRESHOLD or more. Without labels to learn from, all."""
    model = fit_on_labels(docs, labels)
    if model is None:
        return docs
    return predict(docs, model, "__score").filter(F.col("__score") >= THRESHOLD).select(*docs.columns)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on what is not held out, score all: doc_id, held_out, score, predicted."""
    model = fit_on_labels(docs, labels)
    scored = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
