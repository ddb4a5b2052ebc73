"""Near-duplicate groups by SimHash with pigeonring filtering.

Fingerprints of equal bits are one node. Two fingerprints within the radius of three bits agree in one of
four 16-bit segments, and within the other three segments in one of four 12-bit parts; those two form the
block key. Inside a block, pairs pass a chain test on the ring of segments before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import near_copies
from sensorloom.llm.components import connected_components
from sensorloom.llm.tables import BROADCAST_ROWS, fresh, quoted, with_text_columns
from sensorloom.llm.words import chunks, space_joined, split_words, xxh64
from sensorloom.sources.scratch import materialize

SEED = 42
BITS = 64
RADIUS = 3
RING = 8
BLOCK_ROWS = 4096


# Fingerprints


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The SimHash of each text as unsigned 64-bit integers; 0 for a text without words."""
    parts = [_fingerprints(texts.slice(a, b - a), shingle) for a, b in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    words = split_words(texts)
    counts = words.counts()
    result = np.zeros(len(texts), dtype=np.uint64)
    if not len(words.starts):
        return result
    joined, begins, ends = space_joined(words)
    # A text with fewer words than a shingle is one shingle.
    shingles = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    width = np.minimum(counts, shingle)
    bounds = np.concatenate(([0], np.cumsum(shingles)))
    of = np.repeat(np.arange(len(counts)), shingles)
    first = words.first[of] + np.arange(bounds[-1]) - bounds[of]
    hashes = xxh64(joined, begins[first], ends[first + width[of] - 1], SEED)
    filled = np.flatnonzero(shingles)
    ones = bit_counts(hashes, bounds[filled], shingles[filled])
    result[filled] = np.packbits(2 * ones > shingles[filled, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return result


# For each byte value, its eight bits as eight one-byte counters.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def bit_counts(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each of the consecutive runs of ``hashes``."""
    # Runs are cut into pieces of at most 255, so that one-byte counters cannot overflow.
    pieces = -(-sizes // 255)
    owner = np.cumsum(pieces) - pieces
    piece_of = np.repeat(np.arange(len(sizes)), pieces)
    cuts = starts[piece_of] + 255 * (np.arange(len(piece_of)) - owner[piece_of])
    counters = np.add.reduceat(_COUNTERS[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    return np.add.reduceat(counters.view(np.uint8).reshape(len(cuts), BITS), owner, axis=0, dtype=np.int64)


def with_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = 3) -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed long."""
    field = T.StructField(name, T.LongType(), False)
    return with_text_columns(
        docs, text, [field], lambda texts: [pa.array(fingerprints(texts, shingle).view(np.int64))]
    )


# Blocks. A mask says which bits are still open; a block's rows agree in all bits outside it.


def _parts(mask: int, count: int = RADIUS + 1) -> list[int]:
    """The bits of ``mask`` in ``count`` consecutive parts of about equal size, as masks."""
    places = [i for i in range(BITS) if mask >> i & 1]
    bounds = [round(k * len(places) / count) for k in range(count + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(bounds, bounds[1:])]


def _refined(masks: list[int]) -> list[int]:
    """Each open mask without one of its four parts: a close pair agrees in at least one of them."""
    return [mask & ~part for mask in masks for part in _parts(mask)]


_BLOCKED = "open long, key long, fingerprint long"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints with the mask of their block -> rows of the smaller blocks; the key is the bits that are fixed."""
    for batch in batches:
        points, masks = (c.to_numpy().view(np.uint64) for c in batch.columns)
        for mask in np.unique(masks).tolist():
            chosen = points[masks == np.uint64(mask)]
            for smaller in _refined([mask]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(chosen), np.uint64(smaller)).view(np.int64)),
                        pa.array((chosen & np.uint64(~smaller % (1 << BITS))).view(np.int64)),
                        pa.array(chosen.view(np.int64)),
                    ],
                    names=["open", "key", "fingerprint"],
                )


def ring_pairs(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within ``radius`` bits, by the pigeonring test and then the whole distance.

    The bits are a ring of eight segments. If the whole distance is at most ``radius``, some segment starts a
    chain whose running distance after k segments is at most k * radius / 8, for every k. Chains of up to three
    segments are required; what passes is compared in full.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    width = BITS // RING
    segments = points.view(np.uint8).reshape(-1, BITS // 8)
    assert width == 8
    for at in range(0, len(points) - 1, 256):
        stop = min(at + 256, len(points))
        left, right = segments[at:stop, None, :], segments[None, at:, :]
        distance = np.bitwise_count(left ^ right)
        alive = np.ones(distance.shape, dtype=bool)
        running = np.zeros(distance.shape, dtype=np.uint8)
        for k in range(1, 4):
            running = running + np.roll(distance, 1 - k, axis=2)
            alive &= running <= k * radius // RING
        i, j = np.nonzero(alive.any(axis=2))
        later = i < j
        i, j = i[later] + at, j[later] + at
        close = np.bitwise_count(points[i] ^ points[j]) <= radius
        found.append((i[close], j[close]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spanning_links(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``ring_pairs`` joins, at most one less than there are points."""
    left, right = ring_pairs(points, radius)
    parent = list(range(len(points)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for n, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            kept.append(n)
    return left[kept], right[kept]


_LINKS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("a", "b", "open")]
)


def _block_links(block_rows: int):
    """Rows sorted by block -> links; a block of more rows is passed on as rows with their mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "open"]
        none = np.zeros(0, dtype=np.int64)
        held, key, too_large = none, None, False

        def links(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            points = np.unique(points)
            i, j = spanning_links(points.view(np.uint64)) if len(points) > 1 else (none, none)
            return points[i], points[j]

        def batch(a, b, mask=None):
            mask = pa.nulls(len(a), pa.int64()) if mask is None else pa.array(mask)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), mask], names=names)

        for rows in batches:
            masks, keys, points = (c.to_numpy(zero_copy_only=False) for c in rows.columns)
            if not len(points):
                continue
            cuts = np.flatnonzero((masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])) + 1
            bounds = np.concatenate(([0], cuts, [len(points)]))
            a_parts, b_parts = [], []
            for low, high in zip(bounds[:-1], bounds[1:]):
                this = (masks[low], keys[low])
                if this != key:
                    if not too_large and len(held) > 1:
                        a, b = links(held)
                        a_parts.append(a), b_parts.append(b)
                    held, key, too_large = none, this, False
                if high - low == 1 and not too_large and not len(held) and high < len(points):
                    continue  # a block of one row
                held = np.concatenate((held, points[low:high]))
                if too_large or len(held) > block_rows:
                    too_large = True
                    yield batch(held, held, np.full(len(held), masks[low]))
                    held = none
            if a_parts:
                yield batch(np.concatenate(a_parts), np.concatenate(b_parts))
        if not too_large and len(held) > 1:
            yield batch(*links(held))

    return run


def fingerprint_links(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: links that connect every two of the distinct ``fingerprint`` values within three bits.

    A block of more than ``block_rows`` fingerprints is divided again by the same rule on its open bits, until it is
    small enough; at twelve open bits a block cannot have more than 4,096. No pair is lost and no block is unbounded.
    """
    blocks = (
        points.select("fingerprint", F.lit(-1).cast("long").alias("open"))
        .mapInArrow(_expand, _BLOCKED)
        .select("fingerprint", "open")
        .mapInArrow(_expand, _BLOCKED)
    )
    found: DataFrame | None = None
    while True:
        # The level's table holds links and the rows of blocks that were too large.
        level = materialize(
            blocks.repartition("open", "key").sortWithinPartitions("open", "key").mapInArrow(_block_links(block_rows), _LINKS),
            "fingerprint-links",
        )
        links = level.where(F.col("open").isNull()).select("a", "b")
        found = links if found is None else found.unionByName(links)
        large = level.where(F.col("open").isNotNull()).select(F.col("a").alias("fingerprint"), "open")
        if large.isEmpty():
            return found
        blocks = large.mapInArrow(_expand, _BLOCKED)


# Documents


def _with_node(docs: DataFrame, text: str, name: str, shingle: int, least_percent: int | None) -> DataFrame:
    if least_percent is None:
        return with_fingerprint(docs, text, name, shingle)
    return near_copies.with_set_hash(docs, text, name, shingle)


def near_duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, least_percent: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (long), ``component_id`` and ``component``.

    ``component`` is the smallest fingerprint of the group and never null.

    ``component_id`` is the smallest id that is reachable over links of at most three differing bits, the
    row's own included. A null or wordless text has fingerprint 0 and links like any other. Rows with a
    null id take part in linking and have the component of the ids they reach, null if there are none. Repeated
    rows give repeated rows. Equal fingerprints are one node, so a group of exact copies of any size is one row.

    With ``least_percent`` links are pairs of at least that Jaccard similarity in percent instead, as many as connect the
    groups (``near_copies``); ``fingerprint`` is then a hash of the shingle set.
    """
    node = fresh(docs.select(F.col(quoted(doc_id))), "fingerprint")
    prints = materialize(
        _with_node(docs.select(F.col(quoted(doc_id)), F.col(quoted(text))), text, node, shingle, least_percent)
        .select(F.col(quoted(doc_id)), F.col(node).alias("fingerprint")),
        "fingerprints",
    )
    points = materialize(
        prints.groupBy("fingerprint").agg(F.min(quoted(doc_id)).alias("least_id")), "fingerprint-nodes"
    )
    if least_percent is None:
        links = fingerprint_links(points.select("fingerprint"))
    else:
        links = near_copies.similar_links(docs, text, shingle, least_percent)
    components = connected_components(links)
    labelled = materialize(
        points.join(components.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left").select(
            "fingerprint", "least_id", F.coalesce("component", "fingerprint").alias("component")
        ),
        "fingerprint-components",
    )
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_print = labelled.join(least, "component").select("fingerprint", "component_id", "component")
    return prints.join(by_print, "fingerprint").select(
        F.col(quoted(doc_id)), "fingerprint", "component_id", "component"
    )


def keep_one_of_each_group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, least_percent: int | None = None
) -> DataFrame:
    """``docs`` with one row of each group, that with the smallest id, and the same columns.

    Of rows that share this id the one with the smallest fingerprint stays, and one of equal rows. A group
    whose ids are all null keeps one row as well. Texts are not shuffled as long as the keys of the rows to be
    removed can be broadcast; fingerprints are computed again for the join instead.
    """
    groups = materialize(
        near_duplicate_groups(docs, doc_id, text, shingle, least_percent).select(
            F.col(quoted(doc_id)).alias("id"), "fingerprint", "component_id", "component"
        ),
        "groups",
    )
    keepers = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(
        F.min("fingerprint").alias("kept_print")
    )
    rows = groups.groupBy("id", "fingerprint", "component", "component_id").agg(F.count(F.lit(1)).alias("copies"))
    mark, print_ = fresh(docs, "group_action"), fresh(docs, "fingerprint")
    # Most rows of a large group have another id than the group; only the others need the group's kept fingerprint.
    own = F.col("id").eqNullSafe(F.col("component_id"))
    judged = rows.where(own).join(keepers, "component").withColumn(
        mark,
        F.when(F.col("fingerprint") != F.col("kept_print"), "none").when(F.col("copies") > 1, "one"),
    )
    others = rows.where(~own).withColumn(mark, F.lit("none"))
    action = [F.col("id").alias("action_id"), F.col("fingerprint").alias("action_print"), F.col(mark)]
    actions = materialize(
        others.select(*action).unionByName(judged.where(F.col(mark).isNotNull()).select(*action)), "group-actions"
    )
    with_repeats = not actions.where(F.col(mark) == "one").isEmpty()
    if actions.count() <= BROADCAST_ROWS:
        actions = F.broadcast(actions)
    printed = _with_node(docs, text, print_, shingle, least_percent)
    marked = printed.join(
        actions,
        F.col(quoted(doc_id)).eqNullSafe(F.col("action_id")) & (F.col(print_) == F.col("action_print")),
        "left",
    )
    names = [F.col(quoted(c)) for c in docs.columns]
    single = marked.where(F.col(mark).isNull()).select(*names)
    if not with_repeats:
        return single
    repeated = marked.where(F.col(mark) == "one").select(*names, F.col(print_))
    return single.unionByName(repeated.dropDuplicates([doc_id, print_]).select(*names))
