"""Packing under several limits at once, by the dot-product heuristic.

Examples go to sequences under simultaneous limits on tokens, segments and loss-bearing
tokens. A sequence takes, among the examples that fit in every dimension, the one whose
demands have the largest dot product with what is left, both as shares of the limits
(Panigrahy et al. 2011). Each task packs its own rows from a bounded pool, so nothing is
shuffled and no task needs more than the pool.

Documents may be cut: whole sequences come off a long document first, its rest joins the
pool, and what stays free in a sequence is filled with the head of the longest rest. The
last sequence of a task is cut at powers of two, lengths that need no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEQUENCE_TOKENS = 1024
MAX_SEGMENTS = 128
END_ID = 0
#: Examples that wait in a task; packing starts when it is full.
POOL = 2048
_SPECIAL = "<|endoftext|>"
#: White space in a row that the faster encoder is not given; it fails from a million on.
_LONG_RUN = 500_000
_SPACES = re.compile(rf"\s{{{_LONG_RUN}}}")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Token ids by a byte-level BPE file, no special tokens added.

    The ranks of the same vocabulary, beside it with the ending .tiktoken, give the same ids
    several times faster. Texts that spell a special token, or hold a run of white space that
    its pattern matcher cannot take, go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _SPECIAL in text or (len(text) >= _LONG_RUN and _SPACES.search(text)):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class Pool:
    """Waiting examples as demand vectors (tokens, 1 segment, loss-bearing tokens)."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, np.float64)
        self.demand = np.zeros((0, 3))
        self.items: list[object] = []

    def __len__(self) -> int:
        return len(self.items)

    def add(self, items: list[object], demands: list[tuple[int, int, int]]) -> None:
        if items:
            self.demand = np.concatenate([self.demand, np.array(demands, np.float64)])
            self.items.extend(items)

    def take(self, i: int) -> object:
        """Remove an example; the last one moves to its place."""
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.demand[i] = self.demand[-1]
        self.demand = self.demand[:-1]
        return item

    def best(self, left: np.ndarray) -> int:
        """The example to place, -1 if none fits. Ties go to the one that came first."""
        fits = (self.demand <= left).all(axis=1)
        if not fits.any():
            return -1
        score = (self.demand / self.limits) @ (left / self.limits)
        return int(np.argmax(np.where(fits, score, -1.0)))

    def fill(self) -> tuple[list[object], np.ndarray]:
        """One sequence of whole examples, and what it leaves free."""
        left, chosen = self.limits.copy(), []
        while len(self) and (i := self.best(left)) >= 0:
            left = left - self.demand[i]
            chosen.append(self.take(i))
        return chosen, left


def pack_examples(
    examples: DataFrame, limits: tuple[int, int, int], key: str = "example_id", tokens: str = "n_tokens", loss: str = "n_loss"
) -> DataFrame:
    """Whole examples: (key, sequence_id, slot, over). Each row gets one place.

    limits: tokens, segments, loss-bearing tokens of a sequence. An example beyond a limit
    gets a sequence of its own, marked `over`. Null counts are zero.
    """

    kind = examples.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, next_id = Pool(limits), _sequence_ids()

        def emit(sequences: list[list[object]], over: bool, of: pa.DataType) -> pa.RecordBatch:
            rows = [(k, number, slot) for group in sequences for number in (next_id(),) for slot, k in enumerate(group)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], of), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32()), pa.array([over] * len(rows), pa.bool_()),
                ],
                names=[key, "sequence_id", "slot", "over"],
            )

        of = None
        for batch in batches:
            of = batch.column(0).type
            counts = [[v or 0 for v in batch.column(i).to_pylist()] for i in (1, 2)]
            rows = list(zip(batch.column(0).to_pylist(), *counts, strict=True))
            beyond = [n > limits[0] or m > limits[2] for _, n, m in rows]
            yield emit([[row[0]] for row, big in zip(rows, beyond, strict=True) if big], True, of)
            fitting = [row for row, big in zip(rows, beyond, strict=True) if not big]
            for at in range(0, len(fitting), POOL):
                part = fitting[at:at + POOL]
                pool.add([row[0] for row in part], [(n, 1, m) for _, n, m in part])
                full = []
                while len(pool) >= POOL:
                    full.append(pool.fill()[0])
                yield emit(full, False, of)
        rest = []
        while len(pool):
            rest.append(pool.fill()[0])
        if rest:
            yield emit(rest, False, of)

    return examples.select(key, tokens, loss).mapInArrow(scan, f"{key} {kind}, sequence_id long, slot int, over boolean")


def _sequence_ids() -> Callable[[], int]:
    """Numbers no other task gives; a repeated task gives the same ones."""
    context = TaskContext.get()
    state = [(context.partitionId() if context else 0) << 40]

    def following() -> int:
        state[0] += 1
        return state[0]

    return following


@dataclass
class Piece:
    """Consecutive ids of one document. `start` ids of it come before, `total` is its number."""

    doc: object
    total: int
    start: int
    ids: np.ndarray

    def split(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.total, self.start, self.ids[:n]),
            Piece(self.doc, self.total, self.start + n, self.ids[n:]),
        )


def pack_documents(
    docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, segments: int = MAX_SEGMENTS
) -> DataFrame:
    """All token ids of all documents in sequences of at most `size` tokens, one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document's
    ids end with END_ID; a null text is empty and has that id alone. Every token of a
    document bears loss. Rows with equal ids are packed each for itself.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_id, pool = encoder(path), _sequence_ids(), Pool((size, segments, size))
        of, placed = None, []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*placed, strict=True)) or [()] * 7
            out = [pa.array(columns[0], of), *(pa.array(c, pa.int64()) for c in columns[1:])]
            placed.clear()
            return pa.RecordBatch.from_arrays(out, names=_PIECE_COLUMNS)

        def place(pieces: list[Piece]) -> None:
            number, offset = next_id(), 0
            for piece in pieces:
                n = len(piece.ids)
                placed.append((piece.doc, piece.start, n, zlib.crc32(piece.ids.tobytes()), piece.total, number, offset))
                offset += n

        for batch in batches:
            of = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                rest = Piece(doc, len(ids), 0, ids)
                while len(rest.ids) >= size:
                    whole, rest = rest.split(size)
                    place([whole])
                if n := len(rest.ids):
                    pool.add([rest], [(n, 1, n)])
                while len(pool) >= POOL:
                    place(_sequence(pool))
                if len(placed) >= 8192:
                    yield emit()
        while len(pool):
            last = _sequence(pool)
            if len(pool):
                place(last)
            else:
                for pieces in _by_powers(last):
                    place(pieces)
        if of is not None:
            yield emit()

    columns = ", ".join(f"{c} long" for c in _PIECE_COLUMNS[1:])
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {columns}")


_PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _sequence(pool: Pool) -> list[Piece]:
    """Whole pieces by the heuristic, then the head of the longest waiting piece."""
    chosen, left = pool.fill()
    room = int(min(left[0], left[2]))
    if room and left[1] >= 1 and len(pool):
        i = int(np.argmax(pool.demand[:, 0]))
        head, tail = pool.take(i).split(room)
        chosen.append(head)
        pool.add([tail], [(len(tail.ids), 1, len(tail.ids))])
    return chosen


def _by_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into sequences whose lengths are the powers of two of their sum."""
    total, out = sum(len(p.ids) for p in pieces), []
    waiting = pieces[::-1]
    for power in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        out.append([])
        while power:
            piece = waiting.pop()
            if len(piece.ids) > power:
                piece, tail = piece.split(power)
                waiting.append(tail)
            out[-1].append(piece)
            power -= len(piece.ids)
    return out
