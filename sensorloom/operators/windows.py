"""Session-anchored fixed windows over many streams.

``samples`` tables are long: session keys, ``stream``, ``time`` (seconds, double), ``value``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.joins import sized_join
from sensorloom.schema import SESSION_KEYS, STREAMS

# Fixed value: slack in seconds when an overlap is a whole number of windows.
WINDOW_TOLERANCE = 1e-6
# Rows that a window needs per stream.
MINIMUM_ROWS = {"eeg": 32, "bvp": 32, "eda": 4, "temperature": 4}


def time_slice(df: DataFrame, start: Column | float, stop: Column | float, time: str = "time") -> DataFrame:
    """Rows with ``start <= time < stop``."""
    return df.where((F.col(time) >= start) & (F.col(time) < stop))


def stream_extents(samples: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """First and last time and row count of every stream of every session."""
    return samples.groupBy(*keys, "stream").agg(
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.count(F.lit(1)).alias("stream_rows"),
    )


def session_overlap(
    extents: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    streams: Sequence[str] = STREAMS,
) -> DataFrame:
    """Interval in which all ``streams`` of a session have data, with per-stream row counts.

    A session that lacks a stream keeps its row; start, stop and overlap are NULL.
    """
    is_complete = F.count(F.lit(1)) == len(streams)
    bounds = (
        extents.where(F.col("stream").isin(*streams))
        .groupBy(*keys)
        .agg(
            F.when(is_complete, F.max("first_time")).alias("overlap_start"),
            F.when(is_complete, F.min("last_time")).alias("overlap_stop"),
            *(
                F.coalesce(
                    F.sum(F.when(F.col("stream") == stream, F.col("stream_rows"))), F.lit(0)
                ).alias(f"{stream}_rows")
                for stream in streams
            ),
        )
    )
    return bounds.withColumn("overlap_seconds", F.col("overlap_stop") - F.col("overlap_start"))


def window_grid(
    overlap: DataFrame,
    *,
    window_seconds: float = 30.0,
    warmup_seconds: float = 15.0,
    max_windows: int | None = 6,
) -> DataFrame:
    """Anchor and number of candidate windows per session; 0 where a stream is absent."""
    start = F.col("overlap_start") + F.lit(float(warmup_seconds))
    stop = F.col("overlap_stop")
    if max_windows is not None:
        stop = F.least(stop, start + F.lit(float(window_seconds) * max_windows))
    count = F.floor((stop - start + F.lit(WINDOW_TOLERANCE)) / F.lit(float(window_seconds)))
    return overlap.select(
        "*",
        start.alias("analysis_start"),
        F.coalesce(count, F.lit(0)).cast("long").alias("windows_candidate"),
    )


def window_bounds_of(
    time: Column, anchor: Column, window_seconds: float, windows: Column
) -> tuple[Column, Column]:
    """First and last index ``i`` with ``anchor + i*w <= time < anchor + i*w + w``; NULL if none.

    The division only guesses; the bounds themselves decide. Rounding can move the guess by one
    and can even let two neighbouring windows share an edge sample, so there may be two.
    """
    width = F.lit(float(window_seconds))
    guess = F.floor((time - anchor) / width).cast("long")

    def if_inside(index: Column) -> Column:
        start = anchor + index * width
        inside = (start <= time) & (time < start + width) & (index >= 0) & (index < windows)
        return F.when(inside, index)

    tried = [if_inside(guess - 1), if_inside(guess), if_inside(guess + 1)]
    return F.coalesce(*tried), F.coalesce(*reversed(tried))


def assign_windows(
    samples: DataFrame,
    grid: DataFrame,
    *,
    window_seconds: float = 30.0,
    keys: Sequence[str] = SESSION_KEYS,
    rows: Column | None = None,
    **join_options,
) -> DataFrame:
    """Give each sample its ``window_index`` and ``window_start_unix``; drop samples outside.

    The windows of a session follow each other, so the interval join becomes a computed key: one
    pass over the samples whatever the number of windows. ``rows`` is a column of ``grid`` that says how many samples a
    session has, so that they need not be counted again for the join.
    """
    placed = grid.where(F.col("windows_candidate") > 0)
    anchors = placed.select(*keys, "analysis_start", "windows_candidate")
    known = None if rows is None else placed.select(*keys, rows.alias("_rows"))
    joined = sized_join(samples, anchors, keys, spread_by=["time"], known_rows=known, **join_options)
    start, windows = F.col("analysis_start"), F.col("windows_candidate")
    first, last = window_bounds_of(F.col("time"), start, window_seconds, windows)
    return (
        joined.withColumn("_first", first)
        .where(F.col("_first").isNotNull())
        .withColumn("window_index", F.explode(F.sequence(F.col("_first"), last)))
        .withColumn("window_start_unix", start + F.col("window_index") * F.lit(float(window_seconds)))
        .drop("analysis_start", "windows_candidate", "_first")
    )


def enough_rows(minimum_rows: Mapping[str, int] = MINIMUM_ROWS) -> Column:
    """True where each ``<stream>_window_rows`` count reaches its minimum."""
    return reduce(
        Column.__and__,
        [F.col(f"{stream}_window_rows") >= F.lit(rows) for stream, rows in minimum_rows.items()],
    )


def window_row_counts(
    assigned: DataFrame, keys: Sequence[str] = SESSION_KEYS, streams: Sequence[str] = STREAMS
) -> DataFrame:
    """Rows per stream in each window; rows with a NULL value count too."""
    return assigned.groupBy(*keys, "window_index").agg(
        *(
            F.count(F.when(F.col("stream") == stream, 1)).alias(f"{stream}_window_rows")
            for stream in streams
        )
    )


def session_audit(
    grid: DataFrame,
    used: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    streams: Sequence[str] = STREAMS,
) -> DataFrame:
    """One row per session: rows, overlap, candidate windows and windows used after balancing.

    Sessions without a used window keep a NULL there.
    """
    counts = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows_used_after_balancing"))
    return grid.join(counts, list(keys), "left").select(
        *keys,
        *(f"{stream}_rows" for stream in streams),
        "overlap_seconds",
        "windows_candidate",
        "windows_used_after_balancing",
    )
