"""Numeric tables packed as matrix blocks, for repeated passes over the same rows.

An iterative fit reads the same rows once per epoch. Each block row holds some thousand table rows
as one binary value, so a pass is one matrix product per block inside each task. The tasks' vectors are
added on the executors, in two levels where there are many, and one row returns to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.sources.scratch import materialize, release


BLOCK_ROWS = 10_000


def pack_blocks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One binary row per ``BLOCK_ROWS`` rows of a task: a row-major matrix of doubles (NULL as NaN).

    The blocks are written to the shared scratch folder and then cached, so a lost executor
    re-reads its blocks and nothing upstream runs again. Their size does not depend on that of Arrow batches.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block() -> pa.RecordBatch:
            matrix = np.concatenate(held).tobytes()
            return pa.RecordBatch.from_pydict({"block": pa.array([matrix], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
                held.append(np.column_stack(columns).astype(np.float64))
                rows += batch.num_rows
                if rows >= BLOCK_ROWS:
                    yield block()
                    held, rows = [], 0
        if rows:
            yield block()

    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    packed = materialize(doubles.mapInArrow(pack, "block binary"), "blocks")
    return packed.persist(StorageLevel.MEMORY_AND_DISK)


def release_blocks(blocks: DataFrame) -> None:
    blocks.unpersist()
    release(blocks)


# Vectors that one task adds without another level.
DIRECT_PARTS = 64
_VECTORS = "part long, total array<double>"


def _vector(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": pa.array([part], pa.int64()), "total": pa.array([total.tolist()], pa.list_(pa.float64()))}
    )


def block_sums(blocks: DataFrame, width: int, size: int, partial: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``part, total``: one row, the sum of ``partial(matrix)`` (a vector of ``size``) over all blocks.

    Each task adds its blocks; the tasks' vectors meet in about the square root of their number of tasks, and those in
    one. Vectors are added in the order of their partitions, so repeated runs agree to the last digit.
    """

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for block in batch.column(0):
                total += partial(np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(-1, width))
        yield _vector(TaskContext.get().partitionId(), total)

    def of_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(size), None
        for batch in batches:
            for part, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += vector.values.to_numpy()
                first = part if first is None else first
        if first is not None:
            yield _vector(first, total)

    def merged(rows: DataFrame, tasks: int, key: Column) -> DataFrame:
        dealt = rows.repartition(tasks, key).sortWithinPartitions("part")
        return dealt.mapInArrow(of_vectors, _VECTORS)

    sums = blocks.mapInArrow(of_blocks, _VECTORS)
    parts = blocks.rdd.getNumPartitions()
    if parts > DIRECT_PARTS:
        groups = math.isqrt(parts - 1) + 1
        sums = merged(sums, groups, F.col("part") % groups)
    return merged(sums, 1, F.lit(0)) if parts > 1 else sums


def sum_over_blocks(
    blocks: DataFrame, width: int, size: int, partial: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum of :func:`block_sums` on the driver; zeros without a block."""
    row = block_sums(blocks, width, size, partial).first()
    return np.array(row["total"]) if row is not None else np.zeros(size)
