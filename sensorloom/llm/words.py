"""Words of many texts at once, as flat NumPy arrays, for use inside Arrow tasks.

A word is a run of bytes other than space and the control characters 0x09 to 0x0D. A batch of texts is one
byte array; words are start and end positions in it, so that hashing and counting need no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


@dataclass
class Words:
    """``starts`` and ``ends`` are byte positions in ``data``; text i has words first[i] to first[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each; a longer text is a range of its own."""
    offsets = _offsets(texts)
    start, rows = 0, len(texts)
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[1], dtype=kind)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts without a copy, and each text's bounds in them."""
    offsets = _offsets(texts)
    buffer = texts.buffers()[2] if len(texts) else None
    if buffer is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """The words of an array of non-null strings; A-Z become a-z if ``lower``."""
    data, offsets = flat_bytes(texts)
    if lower:
        data = LOWERED[data]
    return mark_words(data, offsets)


def mark_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~IS_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        bounds = offsets[:-1][np.diff(offsets) > 0]
        begins[bounds] = inside[bounds]
        bounds = offsets[1:][np.diff(offsets) > 0] - 1
        stops[bounds] = inside[bounds]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values over all bits."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def _power_table(base: int, size: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.full(max(size, 2 * CHUNK_BYTES), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if len(table) <= 8 * CHUNK_BYTES:  # the table of a giant text is not kept
            _powers[base] = table
    return table[:size]


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash per word that depends on its bytes alone: a polynomial modulo 2**64, then mixed."""
    size = len(words.data)
    if not len(words.starts):
        return np.zeros(0, dtype=np.uint64)
    terms = (words.data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, size)
    terms[IS_SPACE[words.data]] = 0
    sums = np.add.reduceat(terms, words.starts)
    return mixed(sums * _power_table(_INVERSE, size)[words.starts])


def joined_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of ``n`` consecutive values (windows over text bounds included)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:size].copy()
    for i in range(1, n):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += hashes[i : i + size]
    return mixed(total)


def window_starts(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and text of each window of ``n`` words that lies inside one text."""
    if len(words.starts) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = words.text_of_word()
    index = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    return index, text[index]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each segment; segments are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(data))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
    sums = total[ends] - total[starts]
    return mixed(sums * _power_table(_INVERSE, len(data) + 1)[starts])


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the values in each range, wherever it lies; ranges may overlap."""
    terms = hashes * _power_table(_BASE, len(hashes))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return mixed((total[ends] - total[starts]) * _power_table(_INVERSE, len(hashes) + 1)[starts])


def space_joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words in order with one space after each, and each word's start and end there."""
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
    inside = np.ones(len(joined), dtype=bool)
    inside[ends] = False
    joined[inside] = words.data[~IS_SPACE[words.data]]
    return joined, begins, ends


# The five primes of the XXH64 specification.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)


def _rotated(values: np.ndarray, by: int) -> np.ndarray:
    return (values << np.uint64(by)) | (values >> np.uint64(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the byte ranges of ``data``; those of 32 bytes and more are hashed one by one."""
    lengths = ends - starts
    result = np.empty(len(starts), dtype=np.uint64)
    long = np.flatnonzero(lengths >= 32)
    if len(long):
        raw, digest = data.tobytes(), xxhash.xxh64_intdigest
        result[long] = np.fromiter(
            (digest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long)
        )
    short = np.flatnonzero(lengths < 32)
    short = short[np.argsort(lengths[short].astype(np.uint8), kind="stable")]
    if not len(short):
        return result
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(data) + 1,), (1,))
    at, size = starts[short], lengths[short]
    total = np.uint64(seed) + _P5 + size.astype(np.uint64)
    for lane in range(3):  # rows are in order of length: those with another eight bytes come last
        low = int(np.searchsorted(size, 8 * lane + 8))
        part = total[low:]
        part ^= _rotated(eight[at[low:] + 8 * lane] * _P2, 31) * _P1
        total[low:] = _rotated(part, 27) * _P1 + _P4
    done = size & ~7
    rows = np.flatnonzero(size & 4)
    value = eight[at[rows] + done[rows]] & np.uint64(0xFFFFFFFF)
    total[rows] = _rotated(total[rows] ^ (value * _P1), 23) * _P2 + _P3
    done = size & ~3
    for step in range(3):
        rows = np.flatnonzero((size & 3) > step)
        value = padded[at[rows] + done[rows] + step].astype(np.uint64)
        total[rows] = _rotated(total[rows] ^ (value * _P5), 11) * _P1
    total ^= total >> np.uint64(33)
    total *= _P2
    total ^= total >> np.uint64(29)
    total *= _P3
    total ^= total >> np.uint64(32)
    result[short] = total
    return result
