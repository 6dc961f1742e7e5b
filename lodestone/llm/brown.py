"""Language-model scores by Brown class-based bigrams.

The most frequent words are put into classes by exchange: each word in turn moves to the
class that raises the likelihood of the class bigrams most (Brown et al. 1992, Martin et al.
1998). From there all words that occur MIN_COUNT times or more in training are put into
classes by the same measure, in Spark rounds: each word's counts before and after each class
are gathered, and all words move at once. A round that does not raise the likelihood is taken
back, and fewer words move. Words outside the head are placed in the last round, by their
neighbours from the head. Rarer words, unknown ones among them, share one
class, and the end of a text has its own. A text's probability is the product of class transitions and word emissions, from
end to end. Both are smoothed, so the symbols known in training and one for all others sum
to one.

Counts are over all training texts: tasks count, Spark adds up. The most frequent words and
their counts and classes are sent to the tasks (HEAD_WORDS at most); rarer words of a text are
joined with the tables of counts and classes, so every token has its true count and class.

Null texts count as empty: they consist of their end. Rows may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm import words as W
from lodestone.llm.tables import checkpoint, frequent, remainder
from lodestone.plans.scratch import materialize, run_folder

#: Words whose counts are sent to every task, 16 bytes each.
HEAD_WORDS = 500_000
#: Words whose classes are exchanged one by one first; their bigrams are at most (CLASS_WORDS + 2) squared.
CLASS_WORDS = 1_500
#: Words that occur as often in training are put into classes, however many they are.
MIN_COUNT = 5
#: Rounds in which all of these words may move at once.
ROUNDS = 2
CLASSES = 48
SWEEPS = 6
#: Entries (word, neighbouring class) that a task adds up before it sends them on.
HELD_CONTEXTS = 1 << 20
_CODE_SPACE = 1 << 16
_CONTEXT = "kind int, word long, codes binary, counts binary"
#: Weight of the class frequencies in the smoothed transitions.
BACKOFF = 20.0


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task, added up as far as memory allows."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    waiting, size = [], 0

    def merge() -> None:
        nonlocal keys, counts, waiting, size
        new = np.concatenate([keys, *[k for k, _ in waiting]])
        n = np.concatenate([counts, *[c for _, c in waiting]])
        keys, place = np.unique(new, return_inverse=True)
        counts = np.bincount(place, n, len(keys)).astype(np.int64)
        waiting, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(W.signed(keys)), pa.array(counts)], names=["word", "n"])

    for batch in batches:
        for part in W.slices(batch, "text"):
            k, n = np.unique(W.cut(part.column("text"), lower=True).hashes(), return_counts=True)
            waiting.append((k, n))
            size += len(k)
            if size > 500_000:
                merge()
                if len(keys) > 2_000_000:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
    merge()
    if len(keys):
        yield out()


@dataclass
class Classes:
    """The head words with their counts and classes, the classes of frequent words outside the head, totals."""

    words: np.ndarray  # ascending hashes
    counts: np.ndarray
    classes: np.ndarray  # of the head words; CLASSES for all that are not clustered
    tail: DataFrame | None  # (word, class) of the clustered words outside the head
    tokens: int
    types: int
    ends: int
    rest_tokens: int
    rest_types: int
    likelihood: float  # of the classes of the head words, see `likelihood`

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1.0) / (self.tokens + self.types + 1.0))


@dataclass
class Model(Classes):
    """Classes, and log10 of the smoothed probabilities."""

    transitions: np.ndarray  # (CLASSES + 2) x (CLASSES + 2) log10, the last class is the end
    class_counts: np.ndarray

    def norms(self) -> np.ndarray:
        """log10 of what the count of a word is divided by, for each class.

        Words outside the classes, and one place for those never seen, count one more.
        """
        own = np.log10(np.maximum(self.class_counts[:CLASSES], 1.0))
        return np.concatenate([own, [np.log10(self.rest_tokens + self.rest_types + 1.0), 0.0]])


def exchange(bigrams: np.ndarray, classes: int, sweeps: int, movable: int) -> np.ndarray:
    """Classes of the first `movable` symbols of a square count table, in order of frequency.

    The other symbols keep classes of their own: `classes`, `classes` + 1 and so on. Each move
    compares, for every class at once, the change of the sum of n log n over class pairs less
    that over class counts.
    """
    symbols = len(bigrams)
    total = classes + symbols - movable
    of = np.concatenate([np.arange(movable) % classes, np.arange(classes, total)])
    n = bigrams.astype(np.float64)
    onto = np.zeros((symbols, total))
    onto[np.arange(symbols), of] = 1.0
    right, left = n @ onto, (onto.T @ n).T  # counts of a symbol before, after each class
    pairs = onto.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            own, r, l, same = of[w], right[w].copy(), left[w].copy(), n[w, w]
            if r.sum() + l.sum() == 0:
                continue
            # take the word out; its own bigrams with itself are counted apart
            r[own] -= same
            l[own] -= same
            pairs[own, :] -= r
            pairs[:, own] -= l
            pairs[own, own] -= same
            # wherever the word goes, it follows and precedes the same classes
            rows, columns = pairs.sum(axis=1) + l, pairs.sum(axis=0) + r
            gain = (f(pairs[:classes] + r) - f(pairs[:classes])).sum(axis=1)
            gain += (f(pairs[:, :classes] + l[:, None]) - f(pairs[:, :classes])).sum(axis=0)
            d = np.diagonal(pairs)[:classes]
            here = np.arange(classes)
            gain += f(d + r[here] + l[here] + same) - f(d + r[here]) - f(d + l[here]) + f(d)
            out, into = r.sum() + same, l.sum() + same
            gain -= f(rows[:classes] + out) - f(rows[:classes]) + f(columns[:classes] + into) - f(columns[:classes])
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            pairs[best, :] += r
            pairs[:, best] += l
            pairs[best, best] += same
            if best != own:
                of[w] = best
                right[:, own] -= n[:, w]
                right[:, best] += n[:, w]
                left[:, own] -= n[w, :]
                left[:, best] += n[w, :]
                moved += 1
        if not moved:
            break
    return of


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, words as 64-bit hashes."""
    each = docs.select("text").mapInArrow(_word_counts, "word long, n long")
    return checkpoint(each.groupBy("word").agg(F.sum("n").alias("n")))


def _seed(docs: DataFrame, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of the CLASS_WORDS most frequent head words by exchange; CLASSES for all others."""
    clustered = np.lexsort((words, -n))[:CLASS_WORDS]
    symbol = np.full(len(words), len(clustered), np.int64)
    symbol[clustered] = np.arange(len(clustered))
    symbols = len(clustered) + 2
    shared = docs.sparkSession.sparkContext.broadcast((words, symbol))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shared.value
        table, total = W.Table(known), np.zeros(symbols * symbols, np.int64)
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = W.cut(part.column("text"), lower=True)
                at = table.find(found.hashes())
                of = np.where(at >= 0, place[at], symbols - 2) if len(place) else np.full(len(at), symbols - 2)
                before, after, _ = _with_ends(of, found.counts(), symbols - 1)
                total += np.bincount(before * symbols + after, minlength=symbols * symbols)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # at most (CLASS_WORDS + 2) squared rows
    bigrams = np.zeros(symbols * symbols)
    bigrams[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    of = exchange(bigrams.reshape(symbols, symbols), CLASSES, SWEEPS, len(clustered))
    return of[symbol]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _packed(kind: np.ndarray | int, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row (kind, word, codes, counts) per run of equal words; counts of 2^32 and more take several entries."""
    if len(n) and n.max() >= 1 << 32:
        times = 1 + n // ((1 << 32) - 1)
        word, code = np.repeat(word, times), np.repeat(code, times)
        kind = np.repeat(kind, times) if isinstance(kind, np.ndarray) else kind
        last = np.cumsum(times) - 1
        n, rest = np.full(len(word), (1 << 32) - 1, np.int64), n % ((1 << 32) - 1)
        n[last] = rest
    kinds = kind if isinstance(kind, np.ndarray) else np.full(len(word), kind, np.int32)
    first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (kinds[1:] != kinds[:-1])))) if len(word) else np.empty(0, np.int64)
    ends = np.append(first, len(word))

    def binary(values: np.ndarray) -> pa.Array:
        offsets = pa.py_buffer((ends * values.itemsize).astype(np.int32))
        return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(values.tobytes())])

    return pa.RecordBatch.from_arrays(
        [pa.array(kinds[first]), pa.array(W.signed(word[first])), binary(code.astype("<u2")), binary(n.astype("<u4"))],
        names=["kind", "word", "codes", "counts"],
    )


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of every entry."""
    rows = rows.combine_chunks()

    def flat(name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows.column(name).chunk(0).cast(pa.binary()) if rows.num_rows else pa.array([], pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(column) else np.empty(0, np.uint8)
        return np.frombuffer(data.tobytes(), kind), np.diff(offsets)

    code, sizes = flat("codes", "<u2")
    n, _ = flat("counts", "<u4")
    return np.repeat(np.arange(rows.num_rows), sizes // 2), code.astype(np.int64), n.astype(np.int64)


def _contexts(docs: DataFrame, words: np.ndarray, classes: np.ndarray, movable: np.ndarray, tail: bool) -> DataFrame:
    """(kind, word, codes, counts): how often a word is followed (code: class) or preceded (code: classes + class) by a class.

    Twice the number of classes is the code of a word that follows itself. Kind 0 are the
    movable head words, kind 1 (if `tail`) the words outside the head, kind 2 the class
    bigrams, with the pair as their code. Entries of a word travel together, and move once.
    """
    width, end = CLASSES + 2, CLASSES + 1
    codes = 2 * width + 1
    shared = docs.sparkSession.sparkContext.broadcast((words, classes, movable))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_known, moves = shared.value
        table, total = W.Table(known), np.zeros(width * width, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = W.cut(part.column("text"), lower=True)
                hashes = found.hashes()
                at = table.find(hashes)
                of = np.where(at >= 0, of_known[at], CLASSES) if len(known) else np.full(len(at), CLASSES)
                before, after, _ = _with_ends(of, found.counts(), end)
                total += np.bincount(before * width + after, minlength=width * width)
                # the steps into and out of each word; the last step of a row leads to its end
                into = np.flatnonzero(~_lasts(found.counts()))
                right, left = after[into + 1].copy(), before[into] + width
                same = np.zeros(len(hashes), bool)
                same[:-1] = (hashes[1:] == hashes[:-1]) & (found.doc[1:] == found.doc[:-1])
                right[same] = 2 * width
                first = np.ones(len(hashes), bool)
                first[1:] = ~same[:-1]
                heads = at >= 0
                if len(known):
                    heads &= moves[at]
                new = np.concatenate([at[heads] * codes + right[heads], at[heads & first] * codes + left[heads & first]])
                held.append(np.unique(new, return_counts=True))
                if sum(len(k) for k, _ in held) > 2 * HELD_CONTEXTS:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD_CONTEXTS:
                        keys, n = held.pop()
                        yield _packed(0, known[keys // codes], keys % codes, n)
                if tail:
                    rare = at < 0
                    own, place = np.unique(hashes[rare], return_inverse=True)
                    place_of = np.zeros(len(hashes), np.int64)
                    place_of[rare] = place
                    new = np.concatenate([place * codes + right[rare], place_of[rare & first] * codes + left[rare & first]])
                    keys, n = np.unique(new, return_counts=True)
                    yield _packed(1, own[keys // codes], keys % codes, n)
        if held:
            keys, n = _merged(held)
            yield _packed(0, known[keys // codes], keys % codes, n)
        some = np.flatnonzero(total)
        yield _packed(2, np.zeros(len(some), np.uint64), some, total[some])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(rows: pa.Table) -> pa.RecordBatch:
            kind, word = rows.column("kind").to_numpy(), rows.column("word").to_numpy()
            group = np.cumsum(np.concatenate(([False], (kind[1:] != kind[:-1]) | (word[1:] != word[:-1]))))
            row, code, n = _unpacked(rows)
            keys, n = _merged([(group[row] * _CODE_SPACE + code, n)])
            of = np.searchsorted(group, keys // _CODE_SPACE)
            return _packed(kind[of], W.unsigned(word[of]), keys % _CODE_SPACE, n)

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            kind, word = rows.column("kind").to_numpy(), rows.column("word").to_numpy()
            # the last word may go on
            stop = int(np.flatnonzero((kind != kind[-1]) | (word != word[-1]))[-1]) + 1 if (kind[0], word[0]) != (kind[-1], word[-1]) else 0
            if stop:
                yield whole(rows.slice(0, stop))
            held = rows.slice(stop)
        if held is not None and held.num_rows:
            yield whole(held)

    each = docs.select("text").mapInArrow(count, _CONTEXT)
    return each.repartition("kind", "word").sortWithinPartitions("kind", "word").mapInArrow(add_up, _CONTEXT)


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log likelihood of the class bigrams that depends on the classes."""
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    return float(f(pairs).sum() - f(pairs.sum(axis=0)).sum() - f(pairs.sum(axis=1)).sum())


def _class_pairs(docs: DataFrame, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class bigrams under given classes: (CLASSES + 2) squared numbers."""
    nothing = np.zeros(len(words), bool)
    return _pairs_of(_contexts(docs, words, classes, nothing, False).filter("kind = 2"))


def _pairs_of(rows: DataFrame) -> np.ndarray:
    width = CLASSES + 2
    _, code, n = _unpacked(rows.select("codes", "counts").toArrow())
    return np.bincount(code, n, width * width).reshape(width, width)


def best_classes(pairs: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The best class of each word by the measure of `exchange`, if it alone moves.

    `pairs` are the class bigrams, `own` the classes of the words in them, `right` and `left`
    (words, classes) their counts before and after each class, without `same`, the word itself.
    """
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    out, size = own.copy(), CLASSES
    for at in range(0, len(own), 256):
        o, r, l, s = own[at:at + 256], right[at:at + 256], left[at:at + 256], same[at:at + 256]
        each = np.arange(len(o))
        p = np.repeat(pairs[None], len(o), axis=0)
        p[each, o, :] -= r
        p[each, :, o] -= l
        p[each, o, o] -= s
        rows, columns = p.sum(axis=2)[:, :size] + l[:, :size], p.sum(axis=1)[:, :size] + r[:, :size]
        gain = (f(p[:, :size] + r[:, None, :]) - f(p[:, :size])).sum(axis=2)
        gain += (f(p[:, :, :size] + l[:, :, None]) - f(p[:, :, :size])).sum(axis=1)
        d = np.diagonal(p, axis1=1, axis2=2)[:, :size]
        a, b = r[:, :size], l[:, :size]
        gain += f(d + a + b + s[:, None]) - f(d + a) - f(d + b) + f(d)
        n, m = (r.sum(axis=1) + s)[:, None], (l.sum(axis=1) + s)[:, None]
        gain -= f(rows + n) - f(rows) + f(columns + m) - f(columns)
        best = gain.argmax(axis=1)
        stay = np.where(o < size, gain[each, np.minimum(o, size - 1)], -np.inf)
        out[at:at + 256] = np.where(gain[each, best] > stay + 1e-9, best, o)
    return out


def _round(contexts: DataFrame, words: np.ndarray, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(kind, word, class): every counted word against the class bigrams, which are all that is sent."""
    width = CLASSES + 2
    codes = 2 * width + 1
    shared = contexts.sparkSession.sparkContext.broadcast((words, classes, pairs))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_known, moves = shared.value
        find = W.Table(known)
        for batch in batches:
            row, code, n = _unpacked(pa.Table.from_batches([batch]))
            sums = np.bincount(row * codes + code, n, batch.num_rows * codes).reshape(-1, codes)
            at = find.find(W.unsigned(batch.column("word").to_numpy()))
            own = np.where(at >= 0, of_known[at], CLASSES) if len(known) else np.full(len(at), CLASSES)
            right, left, same = sums[:, :width], sums[:, width:2 * width], sums[:, -1]
            often = (right.sum(axis=1) + same >= MIN_COUNT) | (at >= 0)
            best = own.copy()
            best[often] = best_classes(moves, own[often], right[often], left[often], same[often])
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("word"), pa.array(best.astype(np.int32))], names=["kind", "word", "class"]
            ).filter(pa.array(often))

    return contexts.filter("kind < 2").mapInArrow(decide, "kind int, word long, class int")


def cluster(docs: DataFrame, counts: DataFrame, rounds: int | None = None) -> Classes:
    """Classes of all words that occur MIN_COUNT times or more in `docs`, whose word counts are given.

    The likelihood of the classes never falls from round to round: what a round reaches is
    measured, and if it is less, its moves are taken back and the words of a seeded half move
    instead, then of a quarter, and so on.
    """
    rounds = ROUNDS if rounds is None else rounds
    spark = docs.sparkSession
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = F.col("n") >= MIN_COUNT
    many, inside = counts.filter(often).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = docs.count()
    head = frequent(counts, "n", HEAD_WORDS).toArrow()
    words, n = W.unsigned(head.column("word").to_numpy()), head.column("n").to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    classes = _seed(docs, words, n)
    movable = (n >= MIN_COUNT) | (classes < CLASSES)
    rare_seeds = (n < MIN_COUNT) & (classes < CLASSES)
    tail = None
    with_tail = many > int((n >= MIN_COUNT).sum())
    best, reached, share = classes, -np.inf, 1.0
    with run_folder(spark, "contexts") as folder:
        kept: tuple[DataFrame, np.ndarray] | None = None
        for k in range(rounds if movable.any() or with_tail else 0):
            last = with_tail and k == rounds - 1
            contexts = materialize(_contexts(docs, words, classes, movable, last), "round", folder)
            pairs = _pairs_of(contexts.filter("kind = 2"))
            if likelihood(pairs) > reached or kept is None:
                best, reached, kept = classes, likelihood(pairs), (contexts, pairs)
            else:
                share /= 2
            if last:
                # placed by their neighbours' classes as this round found them
                tail = checkpoint(_round(contexts.filter("kind = 1"), words, classes, pairs).select("word", "class"))
            moved = _round(kept[0].filter("kind = 0"), words, best, kept[1]).select("word", "class").toArrow()  # HEAD_WORDS at most
            word = W.unsigned(moved.column("word").to_numpy())
            chosen = W.mix(word + np.uint64(k)) * 2.0**-64 <= share
            classes = best.copy()
            classes[np.searchsorted(words, word[chosen])] = moved.column("class").to_numpy()[chosen]
    pairs = _class_pairs(docs, words, classes)
    if likelihood(pairs) > reached:
        best, reached = classes, likelihood(pairs)
    return Classes(
        words, n, best, tail, int(tokens) + ends, int(types) + (1 if ends else 0), ends,
        int(tokens) - int(inside) - int(n[rare_seeds].sum()), int(types) - int(many) - int(rare_seeds.sum()), reached,
    )


def _lasts(counts: np.ndarray) -> np.ndarray:
    """Which of the steps of rows with so many words leads to the end."""
    out = np.zeros(int(counts.sum()) + len(counts), bool)
    out[np.cumsum(counts + 1) - 1] = True
    return out


def _with_ends(of: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols before and after each step of the rows, end to end, and the row of each step."""
    steps = counts + 1
    doc = np.repeat(np.arange(len(counts)), steps)
    last = np.cumsum(steps) - 1
    after = np.full(len(doc), end, np.int64)
    after[~_lasts(counts)] = of
    before = np.full(len(doc), end, np.int64)
    before[1:] = after[:-1]
    before[last - counts] = end
    return before, after, doc


#: Stands for a word outside the head until its class is joined. Classes are one ASCII character each.
_OPEN = 127


def _as_text(of: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(of.astype(np.uint8)))


def tag(docs: DataFrame, counts: DataFrame, known: Classes) -> DataFrame:
    """The rows of (doc_id, held_out, training, text) with the classes of their words in place of the text.

    Further columns: n_tokens, n_known, base_score, and `own`, the sum of the logarithms of
    the words' counts, which the classes' norms are taken from.
    """
    tail = known.tail
    head = (known.words, known.counts, known.classes)
    shared = docs.sparkSession.sparkContext.broadcast((head, known.base(known.counts), float(known.base(np.float64(known.ends)))))
    ends, open_class = known.ends, CLASSES if tail is None else _OPEN
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "training", "n_tokens", "n_known", "base_score", "own", "classes", "rare"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, n, classes), base_of, end_base = shared.value
        row = TaskContext.get().partitionId() << 36
        table, emission = W.Table(words), np.log10(n + (classes == CLASSES))
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = W.cut(part.column("text"), lower=True)
                hashes, rows = found.hashes(), part.num_rows
                at = table.find(hashes)
                seen = at >= 0
                of = np.full(len(at), open_class, np.int64)
                of[seen] = classes[at[seen]]
                own = np.bincount(found.doc[seen], emission[at[seen]], rows).astype(float)
                base = np.bincount(found.doc[seen], base_of[at[seen]], rows) + end_base
                hits = np.bincount(found.doc[seen], minlength=rows) + (1 if ends else 0)
                rare = np.searchsorted(found.doc[~seen], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + rows)), *[part.column(c) for c in names[1:4]],
                        pa.array(found.counts() + 1), pa.array(hits), pa.array(base), pa.array(own),
                        _as_text(of, found.counts()),
                        pa.ListArray.from_arrays(pa.array(rare), pa.array(W.signed(hashes[~seen]))),
                    ],
                    names=names,
                )
                row += rows

    partial = checkpoint(docs.select("doc_id", "held_out", "training", "text").mapInArrow(
        scan,
        f"row long, doc_id {kind}, held_out boolean, training boolean, n_tokens long, n_known long, base_score double, "
        "own double, classes string, rare array<long>",
    ))
    # words outside the head carry their true counts and classes: tables joined by word
    about = counts.withColumn("class", F.lit(CLASSES)) if tail is None else (
        counts.join(tail, "word", "left").withColumn("class", F.coalesce("class", F.lit(CLASSES)))
    )
    joined = (
        partial.select("row", F.posexplode("rare").alias("i", "word")).join(about, "word", "left")
        .select("row", "i", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(CLASSES)).alias("class"))
    )
    spaces = float(known.tokens + known.types + 1)
    sums = joined.groupBy("row").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("rare_known"),
        F.sum(F.log10((F.col("n") + 1) / F.lit(spaces))).alias("rare_base"),
        F.sum(F.log10(F.col("n") + (F.col("class") == CLASSES).cast("int"))).alias("rare_own"),
        *([] if tail is None else [F.array_sort(F.collect_list(F.struct("i", "class")))["class"].alias("rare_classes")]),
    )
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    whole = partial.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "training", "n_tokens", add("n_known", "rare_known"), add("base_score", "rare_base"),
        add("own", "rare_own"), "classes", *([] if tail is None else ["rare_classes"]),
    )
    if tail is None:
        return checkpoint(whole)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "classes"):
                data, offsets = W.as_bytes(part.column("classes"))
                data = data.copy()
                data[data == _OPEN] = part.column("rare_classes").flatten().to_numpy()
                columns = part.columns[:-2] + [_as_text(data, np.diff(offsets))]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return checkpoint(whole.mapInArrow(fill, whole.drop("rare_classes").schema))


def _learn(tagged: DataFrame, known: Classes) -> Model:
    """Transitions from the training rows of `tagged`."""
    width = CLASSES + 2

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for part in W.slices(batch, "classes"):
                data, offsets = W.as_bytes(part.column("classes"))
                before, after, _ = _with_ends(data, np.diff(offsets), width - 1)
                total += np.bincount(before * width + after, minlength=width * width)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    rows = tagged.filter("training").select("classes").mapInArrow(pairs, "pair long, n long")
    table = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    moves = np.zeros(width * width)
    moves[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    moves = moves.reshape(width, width)
    class_counts = moves.sum(axis=0)
    frequency = (class_counts + 1.0) / (class_counts.sum() + width)
    given = moves.sum(axis=1, keepdims=True)
    transitions = np.log10((moves + BACKOFF * frequency) / (given + BACKOFF))
    return Model(**vars(known), transitions=transitions, class_counts=class_counts)


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """Learns classes and transitions from all texts of `docs`, whose word counts are given."""
    known = cluster(docs, counts)
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), F.lit(True).alias("training"), "text")
    return _learn(tag(rows, counts, known), known)


def score(tagged: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for the rows of `tag`."""
    shared = tagged.sparkSession.sparkContext.broadcast((model.transitions, model.norms()))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, norms = shared.value
        steps = transitions - norms  # each step leads to one word or the end
        for batch in batches:
            for part in W.slices(batch, "classes"):
                data, offsets = W.as_bytes(part.column("classes"))
                before, after, doc = _with_ends(data, np.diff(offsets), CLASSES + 1)
                value = np.bincount(doc, steps[before, after], part.num_rows) + part.column("own").to_numpy()
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(value)], names=[*names, "score"])

    kind = tagged.schema["doc_id"].dataType.simpleString()
    rows = tagged.mapInArrow(
        scan, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(remainder(key, 7) == 2, F.lit(False))


def evaluate(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, score all."""
    trained = remainder("doc_id", 7) != 2
    training = docs.filter(trained)
    counts = count_words(training)
    known = cluster(training, counts)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(trained, F.lit(False)).alias("training"), "text")
    tagged = tag(rows, counts, known)
    return score(tagged, _learn(tagged, known))
