"""Words of whole texts as numpy arrays: places, hashes, windows, look-up tables.

Everything works on the bytes of an Arrow string column, so a batch of texts is cut into
words and hashed without a Python step per word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; the arrays of a slice are about 40 times as large.
SLICE_BYTES = 1 << 20

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
WORD_BYTES = ~_SPACE
LETTER_BYTES = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
LETTER_OR_DIGIT_BYTES = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER_BYTES = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, n of each."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()

        def powers(base: int) -> np.ndarray:
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        _powers, _inverses = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
    return _powers, _inverses


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; starts must ascend. Equal bytes have equal hashes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(starts, low + SLICE_BYTES)))
        high = int(ends[stop - 1])
        powers, inverses = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64))
        at = stop
    return out


@dataclass
class Words:
    """Words of a slice of texts, in order. `doc` is the row of the slice a word belongs to."""

    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)

    def text(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "replace")


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def cut(texts: pa.Array, kind: np.ndarray = WORD_BYTES, lower: bool = False) -> Words:
    """Runs of bytes of one kind, never across rows."""
    data, offsets = as_bytes(texts)
    if lower:
        data = LOWER_BYTES[data]
    rows, n = len(texts), len(data)
    inside = kind[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(rows, data, offsets, starts, ends, np.searchsorted(offsets[1:], starts, side="right"))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about `size` bytes of text; a longer text is a slice of its own."""
    _, offsets = as_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside one row, and their rows."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, doc.dtype)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += hashes[k:k + n]
    whole = doc[:n] == doc[size - 1:]
    return mix(total[whole]), doc[:n][whole]


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `size`-word shingles and their rows, in row order.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    hashes = words.hashes()
    values, doc = windows(hashes, words.doc, size)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short) == 0:
        return values, doc
    first = np.searchsorted(words.doc, short)
    extra = np.array(
        [mix(_fold(hashes[a:a + counts[row]]))[0] for row, a in zip(short, first, strict=True)], np.uint64
    )
    doc, values = np.concatenate([doc, short]), np.concatenate([values, extra])
    order = np.argsort(doc, kind="stable")
    return values[order], doc[order]


def _fold(hashes: np.ndarray) -> np.ndarray:
    total = np.full(1, len(hashes), np.uint64)
    for value in hashes:
        total = total * np.uint64(0xD6E8FEB86659FD93) + value
    return total


class Table:
    """A read-only map from 64-bit hashes to positions, for whole arrays of look-ups."""

    def __init__(self, keys: np.ndarray):
        """keys: distinct and ascending."""
        self.keys = keys
        self.bits = max(1, int(len(keys) - 1).bit_length()) if len(keys) else 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << self.bits) + 1))
        self.longest = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes in `keys`, -1 where absent."""
        found = np.full(len(hashes), -1, np.int64)
        if not self.longest:
            return found
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            place = at[left]
            hit = self.keys[place] == hashes[left]
            found[left[hit]] = place[hit]
            at[left] += 1
            left = left[~hit & (at[left] < stop[left])]
        return found


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return values.view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, np.int64).view(np.uint64)
