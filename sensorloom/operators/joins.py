"""Joins of a large table with a per-entity table whose size is checked, never assumed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.sources.scratch import materialize

# Keys and a few numbers take about 100 bytes a row, so this is some 25 MB per executor.
BROADCAST_ROWS = 250_000
HOT_ROWS = 1_000_000


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, known_rows: DataFrame | None = None
) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the ``_salts`` to split each into parts of that size, as a written table.

    Counting is one pass over the key columns with partial aggregation; known counts save it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) if known_rows is None else known_rows
    salts = F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("long").alias("_salts")
    return materialize(counts.where(F.col("_rows") > hot_rows).select(*keys, salts), "hot-keys")


def sized_join(
    large: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    spread_by: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    known_rows: DataFrame | None = None,
) -> DataFrame:
    """Join on ``keys`` with a table of one row per key.

    A ``per_key`` of at most ``broadcast_rows`` rows (counted, of a few numbers each) is broadcast. Otherwise the keys of
    ``large`` are counted, unless ``known_rows`` (the keys and ``_rows``, at least as many as ``large`` has) says so
    already: without a hot key this is a plain shuffle join, and with some only those are salted. The rows of a hot key spread by a hash of ``spread_by`` over as many parts as its
    count asks for, and its one ``per_key`` row is copied to each, so a key with a third of all
    rows neither fills one task nor multiplies the other table.
    """
    keys = list(keys)
    if per_key.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return large.join(F.broadcast(per_key), keys, how)
    hot = hot_keys(large, keys, hot_rows, known_rows)
    hot_count = hot.count()
    if not hot_count:
        return large.join(per_key, keys, how)
    if hot_count <= broadcast_rows:
        hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_salts"), F.lit(1)))
    spread = large.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1).cast("long")) - 1)
    copied = per_key.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return spread.join(copied, [*keys, "_salt"], how).drop("_salt")
