"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number of distinct shingles into classes of powers of two. For each class a
document is cut into windows of twice the class size that start every class size, so that an item lies
whole in some window and is at least a fixed share of it. An item is a candidate if one of its minima
equals the window's; candidates are verified by the containment of the item's shingles in the whole document.
Items of up to eight shingles would be too small a share of a window and are looked up by their shingles instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.tables import filled, quoted
from sensorloom.llm.words import LOWERED, chunks, joined_hashes, mixed, split_words, window_starts, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
PERMUTATIONS = 64
ITEMS_PER_BLOCK = 20_000
LOOKED_UP = 8
SMALLEST_CLASS = 16
_TABLE = bytes(LOWERED)
_FILTER_BITS = 22

_seeds = mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
_XOR = (_seeds[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32)
_FACTOR = (_seeds[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _shingles(text: str, width: int) -> set[bytes]:
    words = text.encode().translate(_TABLE).split()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _narrow(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _minima(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each permutation, the minimum over each run of ``sizes`` hashes from ``starts``."""
    # Runs are columns; a short one repeats its last hash.
    steps = np.minimum(np.arange(sizes.max())[:, None], sizes - 1)
    runs = hashes[starts + steps]
    result = np.empty((PERMUTATIONS, len(starts)), dtype=np.uint32)
    moved = np.empty_like(runs)
    for p in range(PERMUTATIONS):
        np.bitwise_xor(runs, _XOR[p], out=moved)
        np.multiply(moved, _FACTOR[p], out=moved)
        np.minimum.reduce(moved, axis=0, out=result[p])
    return result


@dataclass
class _Class:
    """The items of one width and size class: a filter over all minima, and the items of each minimum."""

    size: int
    present: np.ndarray
    items: dict[tuple[int, int], list[int]]


@dataclass
class _Lookup:
    """The items of one width that are looked up: ascending shingle hashes, and the items of each."""

    hashes: np.ndarray
    present: np.ndarray
    items: list[list[int]]


class ItemIndex:
    """A bounded block of items, ready to be sent to every task."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.shingles: list[set[bytes]] = []
        self.width: list[int] = []
        grouped: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        small: dict[int, dict[int, list[int]]] = {}
        for item_id, text in rows:
            words = len(text.encode().split())
            if words == 0:
                continue
            width = min(SHINGLE, words)
            parts = split_words(pa.array([text]))
            hashes = _narrow(joined_hashes(word_hashes(parts), width))
            shingles = _shingles(text, width)
            if len(shingles) <= LOOKED_UP:
                # A document that lacks less than this many shingles has one of them.
                enough = len(shingles) - math.ceil(CONTAINMENT * len(shingles)) + 1
                for value in np.unique(hashes)[:enough].tolist():
                    small.setdefault(width, {}).setdefault(value, []).append(len(self.ids))
            else:
                size = SMALLEST_CLASS
                while size < len(shingles):
                    size *= 2
                grouped.setdefault((width, size), []).append((len(self.ids), hashes))
            self.ids.append(item_id)
            self.shingles.append(shingles)
            self.width.append(width)
        self.classes: dict[int, list[_Class]] = {}
        for (width, size), members in sorted(grouped.items()):
            items: dict[tuple[int, int], list[int]] = {}
            present = np.zeros(1 << _FILTER_BITS, dtype=bool)
            for place, hashes in members:
                minima = _minima(hashes, np.zeros(1, dtype=np.int64), np.array([len(hashes)]))[:, 0]
                present[minima >> np.uint32(32 - _FILTER_BITS)] = True
                for p, value in enumerate(minima.tolist()):
                    items.setdefault((p, value), []).append(place)
            self.classes.setdefault(width, []).append(_Class(size, present, items))
        self.lookups: dict[int, _Lookup] = {}
        for width, places in sorted(small.items()):
            hashes = np.array(sorted(places), dtype=np.uint32)
            present = np.zeros(1 << _FILTER_BITS, dtype=bool)
            present[hashes >> np.uint32(32 - _FILTER_BITS)] = True
            self.lookups[width] = _Lookup(hashes, present, [places[value] for value in hashes.tolist()])

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """Row of ``texts``, place of the item and number of shared shingles, for every contained item."""
        candidates: set[tuple[int, int]] = set()
        words = split_words(texts)
        hashes = word_hashes(words)
        for width in sorted({*self.classes, *self.lookups}):
            at, of = window_starts(words, width)
            if len(at):
                shingled = _narrow(joined_hashes(hashes, width)[at])
                if width in self.lookups:
                    self._looked_up(shingled, of, self.lookups[width], candidates)
                if width in self.classes:
                    self._candidates(shingled, of, self.classes[width], candidates)
        found = []
        known: tuple[int, int] | None = None
        shingles: set[bytes] = set()
        for row, place in sorted(candidates, key=lambda c: (c[0], self.width[c[1]], c[1])):
            if known != (row, self.width[place]):
                known = (row, self.width[place])
                shingles = _shingles(texts[row].as_py(), self.width[place])
            shared = len(self.shingles[place] & shingles)
            if shared >= CONTAINMENT * len(self.shingles[place]):
                found.append((row, place, shared))
        return found

    def _looked_up(self, hashes: np.ndarray, of: np.ndarray, lookup: _Lookup, candidates: set[tuple[int, int]]) -> None:
        """Adds (row, item) where a row has one of the item's hashes."""
        at = np.flatnonzero(lookup.present[hashes >> np.uint32(32 - _FILTER_BITS)])
        found = np.minimum(np.searchsorted(lookup.hashes, hashes[at]), len(lookup.hashes) - 1)
        equal = lookup.hashes[found] == hashes[at]
        for row, key in np.unique(np.stack((of[at[equal]], found[equal])), axis=1).T.tolist():
            candidates.update((row, place) for place in lookup.items[key])

    def _candidates(
        self, hashes: np.ndarray, of: np.ndarray, classes: list[_Class], candidates: set[tuple[int, int]]
    ) -> None:
        """Adds (row, item) where a window and an item have a minimum in common."""
        firsts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        sizes = np.diff(np.concatenate((firsts, [len(of)])))
        smallest = classes[0].size
        blocks = -(-sizes // smallest)
        owner = np.cumsum(blocks) - blocks
        run = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(len(run)) - owner[run]
        minima = _minima(hashes, firsts[run] + number * smallest, np.minimum(smallest, sizes[run] - number * smallest))
        size = smallest
        for level in classes:
            while size < level.size:  # two neighbours become one block of the next size
                even = np.flatnonzero(number % 2 == 0)
                has_next = np.append(run[1:] == run[:-1], False)[even]
                pairs = minima[:, even]
                pairs[:, has_next] = np.minimum(pairs[:, has_next], minima[:, even[has_next] + 1])
                minima, run, number = pairs, run[even], number[even] // 2
                size *= 2
            windows = minima.copy()
            inner = np.flatnonzero(run[1:] == run[:-1])
            windows[:, inner] = np.minimum(minima[:, inner], minima[:, inner + 1])
            hits = np.nonzero(level.present[windows >> np.uint32(32 - _FILTER_BITS)])
            rows = of[firsts[run[hits[1]]]]
            for p, value, row in zip(hits[0].tolist(), windows[hits].tolist(), rows.tolist()):
                for place in level.items.get((p, value), ()):
                    candidates.add((row, place))


def item_blocks(items: DataFrame, item_id: str, text: str, size: int = ITEMS_PER_BLOCK) -> Iterator[list]:
    """The items in blocks of at most ``size`` rows, each with its id and text. Null texts are left out."""
    chosen = items.where(F.col(quoted(text)).isNotNull()).select(F.col(quoted(item_id)), F.col(quoted(text)))
    block: list[tuple[int, str]] = []
    for row in chosen.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment`` of every item contained in a document.

    An item is contained if at least 0.8 of its distinct shingles of five words (A-Z lowered) are in the
    document; an item with fewer words is one shingle of all of them, and one without words is never
    contained. Null texts have no words; null ids are kept; repeated documents and items give repeated rows.
    The items are the query set: they are sent to the tasks in blocks of 20,000, and each block reads the
    documents once. Documents are not shuffled. Items of up to eight shingles are found exactly. For a larger one that lies
    whole in a window, the Jaccard similarity with the window is at least 0.19 if it contains the item by 0.8, and
    all 64 minima differ with a probability below 2e-6.
    """
    schema = T.StructType(
        [
            docs.schema[doc_id],
            items.schema[item_id],
            T.StructField("n_shared", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("containment", T.DoubleType()),
        ]
    )
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(
        ("doc_id", "item_id", "n_shared", "n_shingles", "containment"), schema.fields)])
    context = docs.sparkSession.sparkContext
    chosen = docs.select(F.col(quoted(doc_id)), F.coalesce(F.col(quoted(text)), F.lit("")).alias("kernel_text"))
    result = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, item_id, item_text):
        index = context.broadcast(ItemIndex(block))
        result = result.unionByName(chosen.mapInArrow(_search(index), schema))
    return result


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for start, stop in chunks(texts):
                found = index.value.matches(texts.slice(start, stop - start))
                if found:
                    places = [place for _, place, _ in found]
                    sizes = [len(index.value.shingles[place]) for place in places]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([start + row for row, _, _ in found])),
                            pa.array([index.value.ids[place] for place in places]),
                            pa.array([shared for _, _, shared in found], pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array([f[2] / s for f, s in zip(found, sizes)], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"],
                    )

    return run


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that contain no item, with the same columns. No key is needed, nothing is shuffled."""
    context = docs.sparkSession.sparkContext
    for block in item_blocks(items, item_id, item_text):
        index = context.broadcast(ItemIndex(block))
        docs = docs.mapInArrow(_clean_rows(index, docs.columns.index(text)), docs.schema)
    return docs


def _clean_rows(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(at))
            clean = np.ones(len(texts), dtype=bool)
            for start, stop in chunks(texts):
                for row, _, _ in index.value.matches(texts.slice(start, stop - start)):
                    clean[start + row] = False
            yield batch if clean.all() else batch.filter(pa.array(clean))

    return run
