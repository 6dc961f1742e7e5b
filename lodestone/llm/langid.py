"""Language identification: words first, then shorter and shorter character n-grams.

A known word scores its log frequency in each language. A word no language has seen backs
off to its longest character n-grams that any language knows, from five characters down to
one. The sums over a text give the language and its posterior probability.

A frequency is the count over the occurrences and kinds of its language (Witten and Bell), so
one sighting in a small language weighs more than one in a large one. What a language has not
seen gets one floor, the same for all languages and below every frequency, so that a language
gains nothing by having seen little.

Null texts and texts without a letter are `und` with score 0. Rows whose language is null
teach nothing. Without any training row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.llm import words as W
from lodestone.llm.tables import checkpoint, remainder, spread

#: Rows to learn from, about, over all languages, and of each language at least (all, if it has fewer).
TRAINING_ROWS = 10_000
LANGUAGE_ROWS = 1_000
#: Words and n-grams of a length that are kept, shared by the languages in equal parts, and the
#: least part of a language.
MAX_WORDS = 200_000
MAX_GRAMS = 100_000
LEAST_PART = 2_000
LONGEST_GRAM = 5
#: The floor, as a share of the smallest frequency there is.
_FLOOR = 0.5
UNDETERMINED = "und"


def _letters(texts: pa.Array) -> W.Words:
    """Runs of letters, lower-cased where the letter has one or two bytes of Latin script."""
    found = W.cut(texts, W.LETTER_BYTES, lower=True)
    data = found.data
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        if upper.any():
            data = data.copy()
            data[1:][upper] += 0x20
            found.data = data
    return found


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of `size` code points in the spans, and the span of each."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    if len(heads) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low = np.searchsorted(heads, starts)
    count = np.maximum(np.searchsorted(heads, ends) - low - size + 1, 0)
    owner = np.repeat(np.arange(len(starts)), count)
    first = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(owner))
    limits = np.append(heads, len(data))
    return W.hash_spans(data, heads[first], limits[first + size]), owner


@dataclass
class Model:
    """Per-language log frequencies of words and of n-grams by length."""

    languages: list[str]
    words: tuple[np.ndarray, np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]

    def tables(self) -> tuple[W.Table, dict[int, W.Table]]:
        return W.Table(self.words[0]), {n: W.Table(keys) for n, (keys, _) in self.grams.items()}


def count_batch(texts: pa.Array, lang: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n-gram length or 0 for words, keys, languages, counts) of a batch of texts."""
    batch, at = pa.record_batch([texts], names=["text"]), 0
    for part in W.slices(batch, "text"):
        found = _letters(part.column(0))
        of = lang[at + found.doc]
        at += part.num_rows
        hashes = found.hashes()
        for place in np.unique(of):
            own = np.flatnonzero(of == place)
            keys, first, n = np.unique(hashes[own], return_index=True, return_counts=True)
            yield 0, keys, place, n
            order = np.argsort(first)
            index = own[first[order]]
            for size in range(1, LONGEST_GRAM + 1):
                grams, owner = _grams(found.data, found.starts[index], found.ends[index], size)
                distinct, inverse = np.unique(grams, return_inverse=True)
                yield size, distinct, place, np.bincount(inverse, n[order][owner], len(distinct)).astype(np.int64)


def scores(model: Model, tables: tuple[W.Table, dict[int, W.Table]], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods (rows, languages), and whether a row has a word to judge."""
    found = _letters(texts)
    width = len(model.languages)
    out = np.zeros((len(texts), width))
    place = tables[0].find(found.hashes())
    seen = place >= 0
    for k in range(width):
        out[:, k] = np.bincount(found.doc[seen], model.words[1][place[seen], k], len(texts))
    left = np.flatnonzero(~seen)
    for size in range(LONGEST_GRAM, 0, -1):
        if not len(left):
            break
        hashes, owner = _grams(found.data, found.starts[left], found.ends[left], size)
        at = tables[1][size].find(hashes)
        hit = at >= 0
        n = np.bincount(owner[hit], minlength=len(left))
        done = n > 0
        weight = 1.0 / np.maximum(n, 1)
        docs = found.doc[left]
        for k in range(width):
            sums = np.bincount(owner[hit], model.grams[size][1][at[hit], k], len(left)) * weight
            out[:, k] += np.bincount(docs[done], sums[done], len(texts))
        left = left[~done]
    return out, found.counts() > 0


def has_letter(texts: pa.Array, candidates: np.ndarray) -> np.ndarray:
    """Of the rows with ASCII letters or bytes beyond ASCII, those with a Unicode letter."""
    out = np.zeros(len(texts), bool)
    data, offsets = W.as_bytes(texts)
    ascii_letters = np.concatenate(([0], np.cumsum(W.LETTER_BYTES[data] & (data < 0x80))))
    out[:] = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(candidates & ~out):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
    return out


def fit(docs: DataFrame, bound: int = TRAINING_ROWS) -> Model:
    """Learns from about `bound` rows of (doc_id, text, lang), chosen by a hash of doc_id.

    A language with less than LANGUAGE_ROWS of them gets about as many, or all it has, so
    every labelled language is learnt.
    Tasks count, Spark adds up. The most frequent words and n-grams of each language come to the
    driver: MAX_WORDS and MAX_GRAMS over the number of languages, or LEAST_PART, at most. Of those
    that occur equally often in a language all are kept or none.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, rows = sorted(sizes), max(1, sum(sizes.values()))
    # ids that repeat are chosen together, so a language of few rows is never sampled
    rates = [(name, float(max(bound / rows, LANGUAGE_ROWS / sizes[name]))) for name in languages]
    rate = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double"))
    chosen = known.join(rate, "lang").filter(spread("doc_id", 6) < F.col("rate"))
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for size, keys, of, n in count_batch(batch.column("text"), lang):
                sizes = np.full(len(keys), size, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes), pa.array(W.signed(keys)), pa.array(np.full(len(keys), of, np.int32)), pa.array(n)],
                    names=["size", "key", "lang", "n"],
                )

    each = chosen.select("text", "lang").mapInArrow(count, "size int, key long, lang int, n long")
    each = checkpoint(each.groupBy("size", "key", "lang").agg(F.sum("n").alias("n")))
    # counts in steps of a sixteenth of a power of two: at most 1,024 rows per language and length
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    histogram = each.groupBy("size", "lang", step).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect()
    mass = np.zeros((LONGEST_GRAM + 1, len(languages)))
    lowest: dict[tuple[int, int], int] = {}
    kept: dict[tuple[int, int], int] = {}
    for row in sorted(histogram, key=lambda r: -r["step"]):
        of = row["size"], row["lang"]
        mass[of] += row["n"] + row["kinds"]
        kept[of] = kept.get(of, 0) + row["kinds"]
        if kept[of] <= max(LEAST_PART, (MAX_GRAMS if row["size"] else MAX_WORDS) // len(languages)):
            lowest[of] = row["step"]
    limits = docs.sparkSession.createDataFrame([(*of, least) for of, least in lowest.items()], "size int, lang int, least int")
    wanted = each.join(F.broadcast(limits), ["size", "lang"]).filter(step >= F.col("least")).select("size", "key").distinct()
    rows = each.join(wanted, ["size", "key"]).groupBy("size", "key").agg(
        F.collect_list("lang").alias("lang"), F.collect_list("n").alias("n")
    ).toArrow().combine_chunks()
    tables = {size: _logs(rows.filter(pc.equal(rows.column("size"), size)), mass[size]) for size in range(LONGEST_GRAM + 1)}
    return Model(languages, tables.pop(0), tables)


def _logs(rows: pa.Table, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order and their log frequency in each language."""
    keys = W.unsigned(rows.column("key").to_numpy())
    logs = np.full((len(keys), len(mass)), np.log(_FLOOR / max(mass.max(initial=0.0), 1.0)))
    if len(keys):
        owner = np.repeat(np.arange(len(keys)), pc.list_value_length(rows.column("lang")).to_numpy())
        lang, n = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("lang", "n"))
        logs[owner, lang] = np.log(n / mass[lang])
    order = np.argsort(keys)
    return keys[order], logs[order].astype(np.float32)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of `docs` with the language and its probability in columns of the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tables = known.tables()
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = part.column("text")
                found, score = _decide(known, tables, texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.string()), pa.array(score)], names=[*part.schema.names, *names]
                )

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(scan, schema)


def _decide(model: Model, tables: tuple, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    logs, any_word = scores(model, tables, texts)
    best = logs.argmax(axis=1)
    top = logs.max(axis=1, keepdims=True)
    posterior = 1.0 / np.exp(np.maximum(logs - top, -700)).sum(axis=1)
    judged = has_letter(texts, any_word)
    names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, judged, strict=True)]
    return names, np.where(judged, posterior, 0.0)


#: A document below this probability is rejected.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a letter whose language is more likely than all others together."""
    judged = predict(docs, model, ("__lang", "__score"))
    return judged.filter((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(remainder(key, 4) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(remainder("doc_id", 4) != 2))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
