"""Near copies: groups of texts whose word shingles have at least a given Jaccard similarity.

Texts of equal shingle sets are one node. Nodes meet under bands of minimum hashes; what meets is verified on the whole
sets. A group is what links connect, so not all its pairs are needed: nodes of a band are compared with a first node and
with neighbours in random orders, and again only across what is not yet connected. Candidates grow with the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.components import connected_components
from sensorloom.llm.tables import filled, join_sized, quoted, shuffles_removed, with_text_columns
from sensorloom.llm.words import chunks, joined_hashes, mixed, split_words, window_starts, word_hashes
from sensorloom.sources.scratch import materialize, release

SHINGLE = 5
LEAST_PERCENT = 80
# Two sets of similarity 0.8 share one of twenty bands of four minima but for 3 pairs in 100,000.
BANDS = 20
BAND_MINIMA = 4
# In the first round each row of a band meets its first one. Later, bands of so few nodes are compared in full; in larger ones a
# row meets so many before it in a random order, four times as many in each round, up to a limit.
SMALL_BAND = 16
NEIGHBOURS = 3
MOST_NEIGHBOURS = 48
# Rows of one band that a task holds at a time.
HELD_ROWS = 4096
# Sets that meet one set in a task.
PARTNERS = 512
# Bits of a set's signature.
SIGN_BITS = 1024
# Pairs of which signatures are compared at a time.
SIGN_PAIRS = 1 << 16
# At least so many rounds, and no more once one finds no link.
LEAST_ROUNDS = 2
_SEEDS = mixed(np.arange(1, BANDS * BAND_MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and their bounds per text.

    A text with fewer words than a shingle is one shingle of all of them; one without words has none.
    """
    words = split_words(texts)
    hashes, counts = word_hashes(words), words.counts()
    at, of = window_starts(words, shingle)
    keys, owners = [joined_hashes(hashes, shingle)[at]], [of]
    for size in range(1, shingle):
        short = np.flatnonzero(counts == size)
        if len(short):
            keys.append(joined_hashes(hashes, size)[words.first[short]])
            owners.append(short)
    key, of = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    if len(key):
        keep = np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
        key, of = key[keep], of[keep]
    return key, np.searchsorted(of, np.arange(len(texts) + 1))


def set_hashes(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit hash for each text's shingle set; 0 for a text without words."""
    result = np.zeros(len(texts), dtype=np.uint64)
    for start, stop in chunks(texts):
        result[start:stop] = _hashes_of(*shingle_sets(texts.slice(start, stop - start), shingle))
    return result


def _hashes_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sizes = np.diff(bounds)
    result = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        result[some] = mixed(np.add.reduceat(mixed(keys), bounds[some]) + sizes[some].astype(np.uint64))
    return result


def with_set_hash(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` and the hash of the text's shingle set as a signed long."""
    field = T.StructField(name, T.LongType(), False)
    return with_text_columns(docs, text, [field], lambda texts: [pa.array(set_hashes(texts, shingle).view(np.int64))])


def _sets(shingle: int):
    """Texts -> node and shingle set of each node that is new in its task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        seen: set[int] = {0}
        for batch in batches:
            texts = filled(batch.column(0))
            for start, stop in chunks(texts):
                keys, bounds = shingle_sets(texts.slice(start, stop - start), shingle)
                nodes = _hashes_of(keys, bounds).view(np.int64)
                new = []
                for row, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        new.append(row)
                if new:
                    yield nodes, keys, bounds, np.array(new)

    return of


def band_keys(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each non-empty set and band a hash of the band and its minima."""
    starts = bounds[:-1]
    result = np.empty((len(starts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        total = np.full(len(starts), band + 1, dtype=np.uint64)
        for seed in _SEEDS[band * BAND_MINIMA : (band + 1) * BAND_MINIMA]:
            least = np.minimum.reduceat((keys ^ (seed >> np.uint64(7))) * seed, starts)
            total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + least)
        result[:, band] = total
    return result


def _banded(shingle: int):
    """Texts -> ``key, node, size``: a row for each band of each node that is new in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, keys, bounds, new in _sets(shingle)(batches):
            sizes = np.diff(bounds)
            wanted = np.zeros(len(sizes), dtype=bool)
            wanted[new] = True
            chosen = keys[np.repeat(wanted, sizes)]
            found = band_keys(chosen, np.concatenate(([0], np.cumsum(sizes[new])))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.reshape(-1)), pa.array(np.repeat(nodes[new], BANDS)), pa.array(np.repeat(sizes[new], BANDS))],
                names=["key", "node", "size"],
            )

    return run


def _all_pairs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) inside each of the runs; runs are short."""
    i, j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for step in range(1, int(lengths.max(initial=0))):
        wide = lengths > step
        inside = np.repeat(starts[wide], lengths[wide] - step)
        inside += np.arange(len(inside)) - np.repeat(np.cumsum(lengths[wide] - step) - (lengths[wide] - step), lengths[wide] - step)
        i.append(inside)
        j.append(inside + step)
    return np.concatenate(i), np.concatenate(j)


def signature(keys: np.ndarray) -> bytes:
    """For each bit whether an odd number of the set's keys falls on it."""
    bits = (mixed(keys) % np.uint64(SIGN_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=SIGN_BITS).astype(np.uint8) & 1).tobytes()


def may_be_similar(
    left: np.ndarray, right: np.ndarray, sizes: np.ndarray, least_percent: int
) -> np.ndarray:
    """Whether sets with these signatures (rows of unsigned longs) and this sum of their sizes can be similar enough.

    A bit that differs has a key that only one of the sets has, so the differing bits are no more than such keys are. Of sets
    similar enough those are at most a share of both sizes: no such pair is refused.
    """
    differing = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    return (100 + least_percent) * differing <= (100 - least_percent) * sizes


def _signs(column: pa.Array) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64)
    return rows.reshape(-1, SIGN_BITS // 64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and their sets -> nodes with size and signature."""
    for batch in batches:
        sets = [np.frombuffer(keys.as_buffer(), dtype=np.uint64) for keys in batch.column("keys")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("node"),
                pa.array([len(keys) for keys in sets], pa.int64()),
                pa.array([signature(keys) for keys in sets], pa.binary()),
            ],
            names=["node", "size", "sign"],
        )


def _possible(least_percent: int):
    """Pairs with the signatures of both and the sum of their sizes -> those that can be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _signs(batch.column("a_sign")), _signs(batch.column("b_sign"))
            keep = may_be_similar(left, right, batch.column("sizes").to_numpy(), least_percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def possible_pairs(pairs: DataFrame, signs: DataFrame, least_percent: int) -> DataFrame:
    """The candidates ``a, b`` without those whose signatures exclude the similarity."""
    sides = [
        signs.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("sign").alias(f"{s}_sign")) for s in "ab"
    ]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    both = both.select("a", "b", "a_sign", "b_sign", (F.col("a_size") + F.col("b_size")).alias("sizes"))
    return both.mapInArrow(_possible(least_percent), "a long, b long")


def _met(least_percent: int, turn: int):
    """Rows sorted by band and a random order -> candidate pairs, and the rows of bands that are still of interest.

    Candidates have different components, and sizes and (after the first round) signatures that allow the similarity. A row
    without a key is a pair.
    """
    reach = min(MOST_NEIGHBOURS, NEIGHBOURS << 2 * max(turn - 1, 0))

    def pairs(key: np.ndarray, node: np.ndarray, size: np.ndarray, component: np.ndarray, sign: np.ndarray, bound: bool):
        new = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(key)))
        inside = np.arange(len(key)) - np.repeat(starts, lengths)
        small = (lengths <= SMALL_BAND) & (turn > 0)
        if turn == 0:
            later = np.flatnonzero(~new)
            i, j = later - inside[later], later
        else:
            parts = [_all_pairs(starts[small], lengths[small])]
            wide = np.repeat(~small, lengths)
            for step in range(1, reach + 1):
                later = np.flatnonzero(wide & (inside >= step))
                parts.append((later - step, later))
            i, j = map(np.concatenate, zip(*parts))
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        open_ = (component[i] != component[j]) & (100 * low >= least_percent * high)
        i, j = i[open_], j[open_]
        if turn:
            possible = [np.zeros(0, dtype=bool)]
            for at in range(0, len(i), SIGN_PAIRS):
                x, y = i[at : at + SIGN_PAIRS], j[at : at + SIGN_PAIRS]
                possible.append(may_be_similar(sign[x], sign[y], size[x] + size[y], least_percent))
            allowed = np.concatenate(possible)
            i, j = i[allowed], j[allowed]
        a, b = node[i], node[j]
        if turn:
            a, b = np.minimum(a, b), np.maximum(a, b)
        found = np.unique(np.stack((a, b)), axis=1)
        # A band stays if it has nodes of several components and was not compared in full; or if it may go on elsewhere.
        stays = (np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)) & ~small
        if bound:
            stays[[0, -1]] = True
        kept = np.repeat(stays, lengths)
        return found, key[kept], node[kept], size[kept]

    def made(columns: list[np.ndarray], bound: bool) -> pa.RecordBatch:
        found, key, node, size = pairs(*columns, bound)
        count = found.shape[1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((found[0], key)), mask=np.arange(count + len(key)) < count),
                pa.array(np.concatenate((found[0], node))),
                pa.array(np.concatenate((found[1], node))),
                pa.array(np.concatenate((np.zeros(count, dtype=np.int64), size))),
            ],
            names=["key", "a", "b", "size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        bound = True  # the first band of a task may have begun in another
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy().astype(np.int64) for n in ("key", "node", "size", "component")]
            columns.append(_signs(batch.column("sign")) if turn else np.zeros((batch.num_rows, 0), dtype=np.uint64))
            if held is not None:
                columns = [np.concatenate(both) for both in zip(held, columns)]
            same = np.concatenate(([False], (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])))
            columns = [c[~same] for c in columns]
            # The last band may go on in the next batch. A long one is worked off, and what later rows meet is kept.
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if len(columns[0]) - cut > HELD_ROWS:
                yield made(columns, True)
                held, bound = [c[cut : cut + 1] if turn == 0 else c[-reach:] for c in columns], True
            else:
                held = [c[cut:] for c in columns]
                if cut:
                    yield made([c[:cut] for c in columns], bound)
                    bound = False
        if held is not None:
            yield made(held, True)

    return run


_MET = "key long, a long, b long, size long"


def met(rows: DataFrame, turn: int, least_percent: int) -> DataFrame:
    """``key, a, b, size``: candidates of one round (no key), and the rows (a = b = node) of bands to look at again.

    ``rows`` has ``key, node, size, component``, and after the first round ``sign``. Rows are range-partitioned by band and a
    random order, so that a band of any size is spread over tasks.
    """
    # The first round has one order for all bands, so that a group's bands begin with the same node.
    order = (F.xxhash64("key", "node", F.lit(turn)) if turn else F.xxhash64("node")).alias("order")
    sign = ["sign"] if turn else []
    dealt = rows.select("key", order, "node", "size", "component", *sign).repartitionByRange("key", "order")
    return dealt.sortWithinPartitions("key", "order", "node").mapInArrow(_met(least_percent, turn), _MET)


def _whole_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, keys, bounds, new in _sets(shingle)(batches):
            parts = [keys[bounds[row] : bounds[row + 1]].tobytes() for row in new.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), pa.array(parts, pa.binary())], names=["node", "keys"])

    return run


def _compared(least_percent: int):
    """Rows sorted by ``a``, its own set (no ``b``) first -> the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keep = []
            for b, keys in zip(batch.column(1), batch.column(2)):
                keys = np.frombuffer(keys.as_buffer(), dtype=np.uint64)
                if not b.is_valid:
                    own = keys.copy()
                    keep.append(False)
                    continue
                place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                shared = int((own[place] == keys).sum())
                keep.append(100 * shared >= least_percent * (len(own) + len(keys) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_pairs(pairs: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """The candidates ``a, b`` whose whole sets are similar enough.

    A set travels once for each pair that it is ``b`` of, and as ``a`` once for every ``PARTNERS`` of its pairs.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).cast("int").alias("shares"))
    others = (
        pairs.join(shares, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
        .join(sets.select(F.col("node").alias("b"), "keys"), "b")
        .select("a", "share", "b", "keys")
    )
    own = (
        shares.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .join(sets.select(F.col("node").alias("a"), "keys"), "a")
        .select("a", "share", F.lit(None).cast("long").alias("b"), "keys")
    )
    ordered = others.unionByName(own).repartition("a", "share")
    ordered = ordered.sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).select("a", "b", "keys")
    return ordered.mapInArrow(_compared(least_percent), "a long, b long")


def similar_links(
    docs: DataFrame, text: str, shingle: int = SHINGLE, least_percent: int = LEAST_PERCENT
) -> DataFrame:
    """``a, b``: links that connect the groups of set hashes that pairs of at least this Jaccard similarity make.

    Every pair that signatures do not exclude is verified on the whole sets; links go to the smallest node of what pairs
    connect. In the first round nodes of a
    band meet its first node; then those of small bands that are not connected yet meet all others, and larger bands go on with
    random orders, only across components, until a round finds nothing more. Two nodes of a group are missed only if no band
    holds both (3 in 100,000 at the least similarity), or if in bands of more than sixteen nodes no chain of links was met.
    """
    with shuffles_removed(docs.sparkSession):
        return _linked(docs.select(F.col(quoted(text))), shingle, least_percent)


def open_bands(open_rows: DataFrame, components: DataFrame, signs: DataFrame) -> DataFrame:
    """``key, node, size, component, sign``: the rows of bands to look at again, each once, with what their nodes know now.

    Joins see one row per node, which holds its bands, however large the groups are.
    """
    nodes = open_rows.groupBy("node").agg(F.max("size").alias("size"), F.collect_set("key").alias("keys"))
    known = nodes.join(components, "node", "left").join(signs.select("node", "sign"), "node")
    return known.select(
        F.explode("keys").alias("key"), "node", "size", F.coalesce("component", "node").alias("component"), "sign"
    )


def _linked(texts: DataFrame, shingle: int, least_percent: int) -> DataFrame:
    banded = materialize(texts.mapInArrow(_banded(shingle), "key long, node long, size long"), "band-rows")
    rows = banded.withColumn("component", F.col("node"))
    components: DataFrame | None = None
    sets: DataFrame | None = None
    signs: DataFrame | None = None
    turn, before = 0, banded
    while True:
        seen = materialize(met(rows, turn, least_percent), "bands")
        release(before)
        before = seen
        pairs = materialize(seen.where(F.col("key").isNull()).select("a", "b").distinct(), "near-pairs")
        open_rows = seen.where(F.col("key").isNotNull()).select("key", F.col("a").alias("node"), "size")
        if sets is None:
            wanted = materialize(open_rows.select("node").distinct(), "near-nodes")
            sets = materialize(
                join_sized(texts.mapInArrow(_whole_sets(shingle), "node long, keys binary"), wanted, ["node"], "inner")
                .dropDuplicates(["node"]),
                "near-sets",
            )
            signs = materialize(sets.mapInArrow(_signed, "node long, size long, sign binary"), "near-signs")
            met_first, pairs = pairs, materialize(possible_pairs(pairs, signs, least_percent), "near-pairs")
            release(met_first)
        found = materialize(similar_pairs(pairs, sets, least_percent), "near-links")
        release(pairs)
        new = not found.isEmpty()
        known = found
        if components is not None:
            known = found.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b")))
        turn += 1
        if (turn >= LEAST_ROUNDS and not new) or open_rows.isEmpty():
            return known
        if new or components is None:
            components = materialize(connected_components(known), "near-components")
        rows = open_bands(open_rows, components, signs)
