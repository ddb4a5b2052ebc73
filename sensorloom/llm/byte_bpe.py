"""Token ids of many texts at once with a public byte-level BPE vocabulary.

Texts are cut into the vocabulary's word pieces with array operations; only pieces not met before go through
the vocabulary's ranks. Texts with other letters than ASCII and Latin-1, or with an apostrophe, go through the
tokenizer whole. The ids are the tokenizer's in all cases.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sensorloom.llm.words import _BASE, _INVERSE, _power_table, chunks, flat_bytes, mixed

VOCABULARY = "byte_bpe_50k"
_SLOT_BITS = 22
_MOST_PIECES = 1 << 20
_LETTER, _DIGIT, _OTHER, _SPACE, _BLANK = range(5)

_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[list(range(65, 91)) + list(range(97, 123))] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[32] = _SPACE
_CLASS[9:14] = _BLANK
_CLASS[128:] = _LETTER


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a ``.json`` file; the strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


def ranks(path: str):
    """The byte pairs of a ``.tiktoken`` file, for single word pieces."""
    import tiktoken

    with open(path, "rb") as lines:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=pairs, special_tokens={})


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary without its extension: next to it lie the ``.json`` and ``.tiktoken`` forms."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json").removesuffix(".json")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where word pieces begin, for texts of ASCII and Latin-1 letters without apostrophes.

    A piece is a run of letters, of digits or of other characters with one space before it if there is one; of
    blanks before such a run all but the last are a piece, and the last one is its own unless it is a space.
    """
    kind = _CLASS[data]
    blank = kind >= _SPACE
    size = len(data)
    first = np.zeros(size + 1, dtype=bool)
    first[offsets[:-1]] = True
    first = first[:size]
    before = np.empty_like(kind)
    before[1:], before[:1] = kind[:-1], _OTHER
    blank_before = before >= _SPACE
    run_follows = np.zeros(size, dtype=bool)
    run_follows[:-1] = ~blank[1:] & ~first[1:]
    begins = first | (blank & ~blank_before) | (blank & run_follows)
    begins |= ~blank & (kind != before) & (before != _SPACE)
    return np.flatnonzero(begins)


def _simple(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, whether ``piece_starts`` holds for it."""
    odd = (data == 0x27) | (data > 0xC3)
    lead = np.zeros(len(data) + 1, dtype=bool)
    lead[1:] = data == 0xC3
    # After 0xC3 stand letters, but for the multiplication and the division sign.
    odd |= lead[:-1] & ((data == 0x97) | (data == 0xB7))
    odd |= (data >= 0x80) & (data < 0xC3) & ~lead[:-1]
    total = np.concatenate(([0], np.cumsum(odd)))
    return total[offsets[1:]] == total[offsets[:-1]]


class BpeEncoder:
    """Ids of whole texts; keeps the ids of the pieces it has met, up to a fixed number."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(f"{path}.json")
        self.ranks = ranks(f"{path}.tiktoken")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, dtype=np.uint64)
        self.places = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        self.count = 0
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Stores pieces and gives their places."""
        raw = data.tobytes()
        pairs = self.ranks.encode_ordinary
        found = [pairs(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        places = np.arange(self.count, self.count + len(found))
        while len(self.begin) < places[-1] + 1:
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
            self.size = np.concatenate((self.size, np.zeros_like(self.size)))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.begin[places] = self.used + np.cumsum(sizes) - sizes
        self.size[places] = sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.count += len(found)
        slots = keys >> np.uint64(64 - _SLOT_BITS)
        self.keys[slots] = keys
        self.places[slots] = places
        return places

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of ids per text."""
        result: list[np.ndarray] = []
        for start, stop in chunks(texts):
            result += self._encode(texts.slice(start, stop - start))
        return result

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        if self.count > _MOST_PIECES:
            self._clear()
        data, offsets = flat_bytes(texts)
        simple = _simple(data, offsets)
        whole = np.flatnonzero(~simple)
        by_row = dict(zip(whole.tolist(), self._encoded([texts[i].as_py() for i in whole.tolist()])))
        starts = piece_starts(data, offsets)
        first_piece = np.searchsorted(starts, offsets)
        ends = np.append(starts[1:], len(data))
        wanted = np.ones(len(starts), dtype=bool)
        if len(whole):
            wanted = np.repeat(simple, np.diff(first_piece))
        places = np.zeros(len(starts), dtype=np.int64)
        if len(starts):
            terms = (data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(data))
            sums = np.add.reduceat(terms, starts)
            keys = mixed(sums * _power_table(_INVERSE, len(data))[starts]) | np.uint64(1)
            slots = keys >> np.uint64(64 - _SLOT_BITS)
            places = self.places[slots].astype(np.int64)
            missing = np.flatnonzero((self.keys[slots] != keys) & wanted)
            if len(missing):
                new, where, back = np.unique(keys[missing], return_index=True, return_inverse=True)
                at = missing[where]
                places[missing] = self._learn(data, new, starts[at], ends[at])[back]
        sizes = np.where(wanted, self.size[places], 0)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        shift = np.repeat(np.where(wanted, self.begin[places], 0) - bounds[:-1], sizes)
        ids = self.ids[shift + np.arange(bounds[-1])]
        cuts = bounds[first_piece]
        return [
            np.asarray(by_row[i], dtype=np.uint32) if i in by_row else ids[cuts[i] : cuts[i + 1]]
            for i in range(len(texts))
        ]


@lru_cache(maxsize=2)
def encoder(path: str) -> BpeEncoder:
    """One encoder per Python worker and vocabulary."""
    return BpeEncoder(path)
