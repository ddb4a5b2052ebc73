"""Packing of token sequences: large items are matched in pairs, small ones best-fit the gaps.

Only the number of pieces of each length decides the packing, at most ``capacity`` counts. They are solved on the
driver as groups of equal sequences; pieces then find their place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.byte_bpe import encoder, vocabulary_path
from sensorloom.llm.tables import quoted
from sensorloom.sources.scratch import materialize

CAPACITY = 1024
END_ID = 2


# Pieces


def _pieces_of(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids, texts = batch.columns
            rows, places, starts, lengths, sums = [], [], [], [], []
            for row, tokens in enumerate(encode(texts)):
                tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                cut = (len(tokens) - 1) % capacity + 1
                at = 0
                while at < len(tokens):
                    rows.append(row), places.append(len(places) and at and places[-1] + 1 or 0)
                    starts.append(at), lengths.append(cut - at)
                    sums.append(zlib.crc32(tokens[at:cut]))
                    at, cut = cut, cut + capacity
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows, pa.int64())),
                    pa.array(places, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids, an end id last.

    Documents of more than ``capacity`` ids are cut so that all pieces but the first have ``capacity`` ids. A
    null text is empty and one piece of the end id. ``vocabulary`` is a path without its extension, which
    every worker can read. Ids are computed batch by batch; texts are not shuffled.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    chosen = docs.select(F.col(quoted(doc_id)), F.coalesce(F.col(quoted(text)), F.lit("")).alias("kernel_text"))
    return chosen.mapInArrow(_pieces_of(vocabulary or vocabulary_path(), end_id, capacity), schema)


# The plan: groups of equal sequences


@dataclass
class PackingPlan:
    """``slots[length]``: rows (first rank, first sequence, offset); a slot holds ranks up to the next one's first."""

    capacity: int
    slots: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    sequences: int = 0


@dataclass
class _Gaps:
    """Groups of sequences with room left, by room: (first sequence, how many, offset of the room)."""

    groups: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    rooms: list[int] = field(default_factory=list)

    def add(self, room: int, first: int, count: int, offset: int) -> None:
        if room > 0 and count > 0:
            if room not in self.groups:
                self.groups[room] = []
                insort(self.rooms, room)
            self.groups[room].append((first, count, offset))

    def tightest(self, length: int) -> tuple[int, int, int, int] | None:
        """Takes the group with the least room of at least ``length``."""
        place = bisect_left(self.rooms, length)
        if place == len(self.rooms):
            return None
        room = self.rooms[place]
        first, count, offset = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room], self.rooms[place]
        return room, first, count, offset


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> PackingPlan:
    """Where the pieces of each length go, from the number of pieces of each length.

    Lengths above a third of the capacity are matched, longest first, each with the longest other such length
    that fits: two of them at most share a sequence. The other lengths go, longest first, to the tightest gap.
    """
    plan, gaps = PackingPlan(capacity), _Gaps()
    taken = dict.fromkeys(counts, 0)
    left = {length: n for length, n in counts.items() if n > 0}

    def place(length: int, sequence: int, offset: int, count: int) -> None:
        plan.slots.setdefault(length, []).append((taken[length], sequence, offset))
        taken[length] += count
        left[length] -= count

    def opened(count: int) -> int:
        plan.sequences += count
        return plan.sequences - count

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            fitting = bisect_left(large, capacity - length + 1)
            partner = next((m for m in reversed(large[:fitting]) if m <= length and left[m] > (m == length)), None)
            if partner is None:
                count = left[length]
                first = opened(count)
                place(length, first, 0, count)
                gaps.add(capacity - length, first, count, length)
                continue
            count = left[length] // 2 if partner == length else min(left[length], left[partner])
            first = opened(count)
            place(length, first, 0, count)
            place(partner, first, length, count)
            gaps.add(capacity - length - partner, first, count, length + partner)

    for length in sorted((m for m in left if 3 * m <= capacity), reverse=True):
        while left[length]:
            gap = gaps.tightest(length)
            if gap is None:
                new = -(-left[length] // (capacity // length))
                gap = (capacity, opened(new), new, 0)
            room, first, count, offset = gap
            each = room // length
            full = min(count, left[length] // each)
            for k in range(each if full else 0):
                place(length, first, offset + k * length, full)
            gaps.add(room - each * length, first, full, offset + each * length)
            if full < count:
                rest = left[length] if left[length] < each else 0
                for k in range(rest):
                    place(length, first + full, offset + k * length, 1)
                if rest:
                    gaps.add(room - rest * length, first + full, 1, offset + rest * length)
                used = full + (1 if rest else 0)
                gaps.add(room, first + used, count - used, offset)
    return plan


# Places


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset``: gapless sequences of at most ``capacity``.

    Columns ``doc_id``, ``piece`` and ``ids_crc32`` order pieces of one length. A length with many pieces is ranked in
    blocks, each of them a window of its own, so that a third of all rows with one length are many tasks.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    per_block = blocked.groupBy(length, "block").agg(F.count(F.lit(1)).alias("n"))
    per_block = materialize(
        per_block.select(
            length, "block", "n", (F.sum("n").over(W.partitionBy(length).orderBy("block")) - F.col("n")).alias("before")
        ),
        "piece-counts",
    )
    counts = {row[0]: row[1] for row in per_block.groupBy(length).agg(F.sum("n")).collect()}
    plan = plan_packing(counts, capacity)
    order = W.partitionBy(length, "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        blocked.withColumn("rank", F.row_number().over(order) - 1)
        .join(per_block.select(length, "block", "before"), [length, "block"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .select(*pieces.columns, "rank")
    )
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return ranked.mapInArrow(_placed(spark.sparkContext.broadcast(_arrays(plan)), length), schema)


def _arrays(plan: PackingPlan) -> tuple[np.ndarray, ...]:
    """Slots as sorted arrays: key of length and first rank, first rank, sequence, offset."""
    rows = [(size, *slot) for size, slots in plan.slots.items() for slot in slots]
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(table[:, i]) for i in range(4))


def _placed(plan, length: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, firsts, sequences, offsets = plan.value
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            slot = np.empty(len(size), dtype=np.int64)
            for value in np.unique(size).tolist():
                rows = size == value
                low, high = np.searchsorted(sizes, [value, value + 1])
                slot[rows] = low - 1 + np.searchsorted(firsts[low:high], rank[rows], side="right")
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(sequences[slot] + rank - firsts[slot], pa.int64()),
                    pa.array(offsets[slot], pa.int64()),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
) -> DataFrame:
    """``token_pieces`` packed into sequences: adds ``sequence_id`` (from 0) and ``offset``.

    Every row of ``docs`` is packed, also with a null id or text and also if it repeats; no documents give no rows.
    """
    return pack_pieces(token_pieces(docs, doc_id, text, vocabulary, end_id, capacity), capacity)
