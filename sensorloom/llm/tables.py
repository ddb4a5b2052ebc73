"""What the operators of this package share: row-wise Arrow columns, checked broadcasts, name clashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.sources.package import ship_package

BROADCAST_ROWS = 100_000
BATCH_ROWS = 1_000

Kernel = Callable[[pa.Array], Sequence[pa.Array]]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text_columns(
    df: DataFrame, text: str, fields: Sequence[T.StructField], kernel: Kernel
) -> DataFrame:
    """All columns of ``df`` and those that ``kernel`` makes from the array of texts (null text: empty).

    Rows keep their partition and need no key. ``fields`` must not clash with columns of ``df``.
    """
    at = [f.name for f in df.schema.fields].index(text)
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = kernel(filled(batch.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], names=[*batch.schema.names, *(f.name for f in fields)]
            )

    return df.mapInArrow(run, schema)


def filled(texts: pa.Array) -> pa.Array:
    """The texts with empty ones for nulls."""
    return texts.fill_null("") if texts.null_count else texts


def ready(spark: SparkSession) -> None:
    """Before the operators of this package run: workers can import it, and take texts in batches of a few MB.

    A batch of Spark's default of 10,000 rows can hold a GB of long texts.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of a written table go as soon as its job is over."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def join_sized(
    large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Equi-join with a stored table: broadcast up to ``limit`` counted rows, else shuffled.

    Both ways give the same rows; in the shuffled one adaptive execution splits hot keys.
    ``small`` should be a table that is cheap to count, such as one from ``materialize``.
    """
    if small.count() <= limit:
        small = F.broadcast(small)
    return large.join(small, list(on), how)
