"""Phrases that occur together more often than their parts: collocations of a language.

Texts are lower-cased in A-Z and split at `.,;:!?` and line breaks into pieces, pieces into
words. One window per word holds it and the words that lead after it in the piece, padded
with empty words. Only these longest windows are counted; Spark's ROLLUP over the word columns
of the distinct ones adds up the prefixes, so it gives the counts of all shorter phrases and of
all words of a language, and no other n-gram is ever made into a row.

A window is padded early where it cannot matter: from the word on with which it is too rare to
reach `min_count`. To know that beforehand, short hashes of the runs of two words are added up,
then of those runs of three whose halves are frequent, and so on; one bit is kept for each
frequent hash, in a map of fixed size. Two runs with one hash or bit let more through and change
nothing: all counts come from the windows, and a window that was padded early still counts for
each of its prefixes that can reach `min_count`.

Everything is counted per `lang`, null as `und`. Null texts count as empty. Repeated rows
count as often as they occur. Other columns are ignored. Counts below 10^13 are exact in the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.llm import words as W
from lodestone.llm.tables import checkpoint

MAX_WORDS = 3
MIN_COUNT = 10
#: Percent of a phrase that one longer phrase must cover to replace it.
COVERED_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
NO_LANGUAGE = "und"
#: Bits of the hash of a run of words that are added up, in chunks of the last 16 of them, and of its
#: place in the map of frequent ones. A map takes 8 MB.
HASH_BITS = 32
CHUNK_BITS = 16
MAP_BITS = 26
#: Hashes a task adds up before it sends them on.
HELD_HASHES = 1 << 21
#: Bytes of text whose windows are added up at once, and rows sent to Spark at once.
SLICE_BYTES = 2 << 20
BATCH_ROWS = 1 << 17
#: Parts of a language that are ranked apart, round by round.
RANK_PARTS = (1024, 32, 1)

BREAK_BYTES = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
WORD_BYTES = ~BREAK_BYTES & ~np.isin(np.arange(256), [0x20, 0x09])


class _Part:
    """Words of a slice of rows (lang, text) and which of them have a neighbour after them."""

    def __init__(self, rows: pa.RecordBatch):
        self.words = words = W.cut(rows.column("text"), WORD_BYTES, lower=True)
        langs = pc.fill_null(rows.column("lang").cast(pa.string()), NO_LANGUAGE).dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[words.doc].astype(np.int64)
        breaks = np.concatenate(([0], np.cumsum(BREAK_BYTES[words.data])))[words.starts]
        self.joined = (words.doc[:-1] == words.doc[1:]) & (breaks[:-1] == breaks[1:])

    def runs(self, maps: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Which words start a frequent run of 2, 3, ... words, by one map each, then which start
        a run one word longer whose halves are frequent, and the hashes of those runs."""
        names = W.cut(self.langs, np.ones(256, bool))
        codes = np.zeros(len(self.langs), np.uint64)
        codes[names.doc] = names.hashes()
        hashes = self.words.hashes()
        run, open_, frequent = W.mix(hashes + codes[self.lang]), self.joined, []
        for order in range(1, len(maps) + 2):
            run = W.mix(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[order:])
            if order <= len(maps):
                place = run >> np.uint64(64 - bits)
                cell = maps[order - 1][(place >> np.uint64(3)).astype(np.int64)]
                frequent.append(open_ & ((cell >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1))
                open_ = frequent[-1][:-1] & frequent[-1][1:]
        return frequent, open_, run[open_] >> np.uint64(64 - HASH_BITS)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the words, equal for equal words, and the words by number; 0 is the empty word."""
        words = self.words
        sizes = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
        kept = words.data[WORD_BYTES[words.data]]
        texts = pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(sizes), pa.py_buffer(kept))
        coded = texts.dictionary_encode()
        names = pa.concat_arrays([pa.array([""], pa.large_string()), coded.dictionary])
        return coded.indices.to_numpy().astype(np.int64) + 1, names


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    for batch in batches:
        for rows in W.slices(batch, "text", SLICE_BYTES):
            part = _Part(rows)
            if len(part.words.starts):
                yield part


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _chunks(keys: np.ndarray, n: np.ndarray, cap: int) -> pa.RecordBatch:
    """Rows (chunk, low, n): the last bits of the ascending keys of a chunk, and their counts up to `cap`."""
    chunk = keys >> np.uint32(CHUNK_BITS)
    first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
    ends = np.append(first, len(keys))

    def packed(values: np.ndarray) -> pa.Array:
        offsets = (ends * values.itemsize).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])

    counts = np.minimum(n, cap).astype("<u1" if cap < 256 else "<u4")
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk[first].astype(np.int32)), packed((keys & np.uint32(0xFFFF)).astype("<u2")), packed(counts)],
        names=["chunk", "low", "n"],
    )


def frequent_runs(docs: DataFrame, size: int, min_count: int = MIN_COUNT, bits: int = MAP_BITS) -> list[np.ndarray]:
    """Maps with a bit for every run of 2 to `size` words of a language that occurs `min_count` times or more.

    Tasks add up hashes, Spark brings the counts of a chunk of hashes together, and one row of
    bits per chunk comes to the driver. `bits` lie between CHUNK_BITS + 3 and HASH_BITS.
    """
    cap = 255 if min_count < 256 else (1 << 32) - 1
    maps: list[np.ndarray] = []
    while len(maps) < size - 1:
        sent = docs.sparkSession.sparkContext.broadcast(maps)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for part in _parts(batches):
                held.append(np.unique(part.runs(sent.value, bits)[2].astype(np.uint32), return_counts=True))
                if sum(len(k) for k, _ in held) > 2 * HELD_HASHES:
                    held = [_added(held)]
                    if len(held[0][0]) > HELD_HASHES:
                        yield _chunks(*held.pop(), cap)
            keys, n = _added(held) if held else (np.empty(0, np.uint32), np.empty(0, np.int64))
            if len(keys):
                yield _chunks(keys, n, cap)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, lows, counts = -1, [], []

            def whole() -> pa.RecordBatch:
                low, n = _added([(np.frombuffer(b"".join(lows), "<u2"), np.frombuffer(b"".join(counts), "<u1" if cap < 256 else "<u4"))])
                flags = np.zeros(1 << (bits - HASH_BITS + CHUNK_BITS), bool)
                flags[low[n >= min_count] >> (HASH_BITS - bits)] = True
                cells = np.packbits(flags, bitorder="little").tobytes()
                return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([cells])], names=["chunk", "bits"])

            for batch in batches:
                for now, low, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if now != chunk and lows:
                        yield whole()
                        lows, counts = [], []
                    chunk = now
                    lows.append(low)
                    counts.append(n)
            if lows:
                yield whole()

        rows = docs.select("lang", "text").mapInArrow(scan, "chunk int, low binary, n binary")
        rows = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary").toArrow()
        found = np.zeros((1 << CHUNK_BITS, (1 << (bits - HASH_BITS + CHUNK_BITS)) >> 3), np.uint8)
        for chunk, cells in zip(rows.column("chunk").to_pylist(), rows.column("bits").to_pylist(), strict=True):
            found[chunk] = np.frombuffer(cells, np.uint8)
        maps.append(found.ravel())
    return maps


def windows(docs: DataFrame, size: int, maps: list[np.ndarray], bits: int = MAP_BITS) -> DataFrame:
    """(lang, w0, w1, ..., n): the distinct padded windows of `size` words and how often they occur."""
    sent = docs.sparkSession.sparkContext.broadcast(maps)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            codes, texts = part.codes()
            columns = _lead(codes, part.runs(sent.value, bits)[0])
            first, n = _distinct([part.lang, *columns], [len(part.langs), *[len(texts)] * size])
            for at in range(0, len(first), BATCH_ROWS):
                rows = first[at:at + BATCH_ROWS]
                taken = [texts.take(pa.array(c[rows])) for c in columns]
                # a word holds no blank, so the words of a window can travel as one text
                joined = pc.binary_join_element_wise(*taken, pa.scalar(" ", pa.large_string())).cast(pa.string())
                langs = part.langs.take(pa.array(part.lang[rows]))
                yield pa.RecordBatch.from_arrays([langs, joined, pa.array(n[at:at + BATCH_ROWS])], names=["lang", "window", "n"])

    counted = docs.select("lang", "text").mapInArrow(scan, "lang string, window string, n long")
    counted = counted.groupBy("lang", "window").agg(F.sum("n").alias("n"))
    words = F.split("window", " ")
    return counted.select("lang", *[words[k].alias(f"w{k}") for k in range(size)], "n")


def _lead(codes: np.ndarray, frequent: list[np.ndarray]) -> list[np.ndarray]:
    """The word and the next ones as columns; 0 from the first that makes the run too rare."""
    columns = [codes]
    for k, kept in enumerate(frequent, 1):
        ahead = np.zeros(len(codes), np.int64)
        ahead[:len(kept)] = np.where(kept, codes[k:], 0)
        columns.append(ahead)
    return columns


def _distinct(columns: list[np.ndarray], bases: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The first places of the distinct rows of some columns, and their counts. Values lie below their bases."""
    key, size = np.zeros(len(columns[0]), np.int64), 1
    for column, base in zip(columns, bases, strict=True):
        if size * base >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * base + column, size * base
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def phrase_counts(docs: DataFrame, size: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, words, phrase, a): phrases of 1 to `size` words that occur `min_count` times or more.

    A row without words (0, null) has the count of all words of the language.
    """
    names = [f"w{k}" for k in range(size)]
    rolled = docs.sparkSession.sql(
        f"select {', '.join(names)}, lang, grouping_id() as level, sum(n) as a from {{rows}} "
        f"group by lang, rollup({', '.join(names)})",
        rows=windows(docs, size, frequent_runs(docs, size, min_count)),
    )
    words = F.lit(size) - F.bit_count("level")
    last = F.coalesce(*[F.col(w) for w in reversed(names)])
    counted = rolled.select(
        "lang", words.alias("words"), F.when(words > 0, F.concat_ws(" ", *names)).alias("phrase"), "a", last.alias("last")
    )
    return counted.filter(((F.col("last") != "") & (F.col("a") >= min_count)) | (F.col("words") == 0)).drop("last")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of every phrase of two words or more, by its weakest cut."""
    parts = F.split("phrase", " ")
    cuts = counts.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({
        "first": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "),
        "rest": F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " "),
    })
    known = counts.filter("words > 0")
    left = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    exact = "cast({} as decimal(19, 0))".format
    score = F.expr(f"(cast({SCALE} as decimal(38, 0)) * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return joined.groupBy("lang", "words", "phrase", "a").agg(weakest).select(
        "lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def without_parts(phrases: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """Phrases but those inside a longer one that occurs at least `percent` percent as often."""
    parts = F.split("phrase", " ")
    sizes = F.explode(F.sequence(F.lit(2), F.col("words") - 1))
    inner = phrases.filter("words > 2").withColumn("size", sizes)
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    covered = inner.select(
        "lang", F.array_join(F.slice(parts, F.col("at"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer")
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = phrases.join(covered, ["lang", "phrase"], "left")
    return joined.filter(f"longer is null or 100 * longer < {percent} * a").drop("longer")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The best `top` of each language with their rank. Parts of a language are ranked apart first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in RANK_PARTS:
        split = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        phrases = phrases.withColumn("rank", F.row_number().over(split).cast("long")).filter(F.col("rank") <= top)
    return phrases


def collocations(docs: DataFrame, size: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    counts = checkpoint(phrase_counts(docs, size, min_count))
    totals = counts.filter("words = 0").select("lang", F.col("a").alias("n"))
    best = ranked(without_parts(checkpoint(scored(counts))), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
