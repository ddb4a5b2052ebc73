"""Pulse features of a photoplethysmogram: peaks, beat intervals, rate and RMSSD.

Windows of ordinary length are handled many at a time, as one array. Windows with more
rows than one task should hold go through :mod:`sensorloom.operators.long_pulse`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions import is_finite
from sensorloom.operators.joins import sized_join
from sensorloom.operators.ordering import (
    BLOCK_ROWS,
    first_difference,
    grouped_median,
)
from sensorloom.schema import WINDOW_KEYS
from sensorloom.sources.scratch import materialize


@dataclass(frozen=True)
class PulseRules:
    """Fixed values of beat detection: seconds, seconds, and shares of the signal's spread."""

    refractory_seconds: float = 0.35
    shortest_interval: float = 0.33
    longest_interval: float = 1.50
    prominence_share: float = 0.25
    prominence_floor: float = 1e-6
    minimum_samples: int = 3


DEFAULT_RULES = PulseRules()


# --- kernel: the sorted samples of many windows as one array -----------------------------------


@dataclass(frozen=True)
class Segments:
    """Windows as consecutive runs of samples: where each begins, and the window of every sample."""

    starts: np.ndarray
    of: np.ndarray

    @classmethod
    def between(cls, changes: np.ndarray) -> Segments:
        """From marks of the samples that begin a window."""
        return cls(np.flatnonzero(changes), np.cumsum(changes) - 1)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.of)))

    @property
    def joined(self) -> np.ndarray:
        """Whether each sample but the first is in the window of the one before."""
        return self.of[1:] == self.of[:-1]


def maxima_of(values: np.ndarray, windows: Segments) -> np.ndarray:
    """Positions of strict local maxima; a plateau counts once at its middle, ends of a window never count."""
    begins = np.append(True, (values[1:] != values[:-1]) | ~windows.joined)[: len(values)]
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(values)) - 1
    rises = (values[first[1:]] > values[first[:-1]]) & (windows.of[first[1:]] == windows.of[first[:-1]])
    falls = (values[first[1:]] < values[first[:-1]]) & (windows.of[first[1:]] == windows.of[first[:-1]])
    top = np.append(False, rises) & np.append(falls, False) if len(first) else np.zeros(0, dtype=bool)
    return (first[top] + last[top]) // 2


def _range_maxima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The maximum of ``values[low:high]`` for each pair of bounds, from maxima of runs of powers of two."""
    power = np.frexp((high - low).astype(float))[1] - 1
    result = np.empty(len(low), dtype=values.dtype)
    level = values
    for k in range(int(power.max()) + 1 if len(power) else 0):
        if k:
            level = np.maximum(level[: -(1 << (k - 1))], level[1 << (k - 1) :])
        rows = power == k
        result[rows] = np.maximum(level[low[rows]], level[high[rows] - (1 << k)])
    return result


def spaced(positions: np.ndarray, heights: np.ndarray, window: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Mask of the peaks left when higher peaks suppress others of their window closer than its ``distance``.

    Of equal heights the later one wins. In a round every undecided peak that is the highest undecided one within
    its distance stays and removes the others there; rounds go on with those that are left.
    """
    keep = np.zeros(len(positions), dtype=bool)
    rank = np.empty(len(positions), dtype=np.int64)
    rank[np.lexsort((positions, heights))] = np.arange(len(positions))
    open_ = np.arange(len(positions))
    while len(open_):
        at, of = positions[open_], window[open_]
        reach = distance[of]
        low = np.maximum(np.searchsorted(at, at - reach, side="right"), np.searchsorted(of, of))
        high = np.minimum(np.searchsorted(at, at + reach), np.searchsorted(of, of, side="right"))
        low, high = np.minimum(low, np.arange(len(at))), np.maximum(high, np.arange(len(at)) + 1)
        wins = _range_maxima(rank[open_], low, high) == rank[open_]
        keep[open_[wins]] = True
        won = np.append(0, np.cumsum(wins))
        open_ = open_[won[high] == won[low]]
    return keep


def prominences(values: np.ndarray, peaks: np.ndarray, maxima: np.ndarray, windows: Segments) -> np.ndarray:
    """Height of each peak over the higher of the lowest values before a higher sample on either side.

    All peaks of all windows at once; ``maxima`` are all local maxima, of which ``peaks`` are some.
    """
    if not len(peaks):
        return np.zeros(0)
    # A search ends at a local maximum or at an end of its window.
    walls = np.unique(np.concatenate((windows.starts, maxima, windows.starts + windows.sizes - 1)))
    heights, of = values[walls], windows.of[walls]
    valleys = np.minimum.reduceat(values, walls)
    first, last = np.append(True, of[1:] != of[:-1]), np.append(of[1:] != of[:-1], True)
    left, _ = _base_levels(heights, np.where(first, np.inf, np.append(np.inf, valleys[:-1])), first)
    right, _ = _base_levels(heights[::-1], np.where(last, np.inf, valleys)[::-1], last[::-1])
    at = np.searchsorted(walls, peaks)
    return values[peaks] - np.maximum(left[at], right[::-1][at])


def beats(times: np.ndarray, values: np.ndarray, windows: Segments, rules: PulseRules) -> np.ndarray:
    """Positions of the beats of all windows; a window whose rate cannot be told has none.

    Neither peaks nor prominences depend on the level of a window, so nothing is subtracted.
    """
    count = len(windows.starts)
    sizes = windows.sizes
    steps, owner = np.diff(times)[windows.joined], windows.of[1:][windows.joined]
    steps = steps[np.lexsort((steps, owner))]
    ends = np.cumsum(sizes - 1)
    middle = ends - sizes + 1 + (sizes - 2) // 2, ends - sizes + 1 + (sizes - 1) // 2
    usable = sizes >= max(rules.minimum_samples, 2)
    typical = np.zeros(count)
    typical[usable] = (steps[middle[0][usable]] + steps[middle[1][usable]]) / 2
    usable &= typical != 0
    distance = np.ones(count)
    distance[usable] = np.maximum(1, np.rint(1.0 / typical[usable] * rules.refractory_seconds))
    mean = np.add.reduceat(values, windows.starts) / sizes
    spread = np.sqrt(np.add.reduceat((values - mean[windows.of]) ** 2, windows.starts) / sizes)
    floor = np.maximum(rules.prominence_floor, rules.prominence_share * spread)

    maxima = maxima_of(values, windows)
    peaks = maxima[usable[windows.of[maxima]]]
    peaks = peaks[spaced(peaks, values[peaks], windows.of[peaks], distance)]
    return peaks[prominences(values, peaks, maxima, windows) >= floor[windows.of[peaks]]]


def local_maxima(values: np.ndarray) -> np.ndarray:
    """``maxima_of`` for a single window."""
    return maxima_of(values, Segments.between(np.arange(len(values)) == 0))


def base_levels(
    values: np.ndarray, peaks: np.ndarray
) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(base, is walled) on the left and on the right of each peak.

    A base is the lowest value between the peak and the nearest higher sample on that side, or
    the end of the signal where no sample is higher; such a side is not walled.
    """
    if not len(peaks):
        empty = (np.empty(0), np.empty(0, dtype=bool))
        return empty, empty
    # The walls of a search are the local maxima and the two ends of the signal.
    walls = np.unique(np.r_[0, peaks, len(values) - 1, local_maxima(values)])
    heights = values[walls]
    valleys = np.minimum.reduceat(values, walls)[:-1]
    alone = np.arange(len(walls)) == 0
    left, left_walled = _base_levels(heights, np.r_[np.inf, valleys], alone)
    right, right_walled = _base_levels(heights[::-1], np.r_[np.inf, valleys[::-1]], alone)
    at = np.searchsorted(walls, peaks)
    return (left[at], left_walled[at]), (right[::-1][at], right_walled[::-1][at])


def _base_levels(
    heights: np.ndarray, valley_before: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Lowest value since the last higher wall, and whether there is one, wall by wall; ``first`` marks a window's first wall.

    Each wall looks at the one before it. Where that is not higher, it takes over what that one knows and looks where that
    one looks; as all do so at once, reaches double and the rounds grow with the logarithm of the walls passed.
    """
    bases = np.minimum(heights, valley_before)
    seen = np.where(first, -1, np.arange(len(heights)) - 1)
    open_ = np.arange(len(heights))
    while True:
        at = seen[open_]
        open_ = open_[(at >= 0) & (heights[at] <= heights[open_])]
        if not len(open_):
            return bases, seen >= 0
        at = seen[open_]
        bases[open_] = np.minimum(bases[open_], bases[at])
        seen[open_] = seen[at]


# --- DataFrame operators -----------------------------------------------------------------------


def finite_samples(df: DataFrame, value: str = "value", time: str = "time") -> DataFrame:
    """Rows whose value and time are both finite."""
    return df.where(is_finite(value) & is_finite(time))


def guarded_counts(df: DataFrame, keys: Sequence[str], rules: PulseRules = DEFAULT_RULES) -> DataFrame:
    """Finite samples per window and whether they suffice for pulse features."""
    usable = is_finite("value") & is_finite("time")
    return df.groupBy(*keys).agg(F.count(F.when(usable, 1)).alias("finite_samples")).withColumn(
        "is_usable", F.col("finite_samples") >= F.lit(rules.minimum_samples)
    )


def sample_rates(
    df: DataFrame, keys: Sequence[str], *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Samples per second: one over the median time step; NULL if that step is zero or absent.

    Windows above ``block_rows`` samples are cut into blocks of about that size.
    """
    finite = finite_samples(df).select(*keys, "time")
    steps = first_difference(finite, keys, "time", "time", "step", block_rows=block_rows)
    return grouped_median(steps, keys, ["step"], block_rows=block_rows).select(
        *keys,
        F.when(F.col("step_median") != 0, 1.0 / F.col("step_median")).alias("sample_rate"),
    )


def centered_pulse(
    df: DataFrame,
    keys: Sequence[str],
    rules: PulseRules = DEFAULT_RULES,
    *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per window: median to subtract, prominence floor and population spread."""
    finite = finite_samples(df)
    floor = F.greatest(
        F.stddev_pop("value") * F.lit(rules.prominence_share), F.lit(rules.prominence_floor)
    )
    stats = finite.groupBy(*keys).agg(
        F.stddev_pop("value").alias("bvp_variability"), floor.alias("prominence_floor")
    )
    return grouped_median(finite, keys, ["value"], block_rows=block_rows).join(stats, list(keys))


def bvp_variability(df: DataFrame, keys: Sequence[str], rules: PulseRules = DEFAULT_RULES) -> DataFrame:
    """Population standard deviation of the finite values; NULL below the minimum sample count."""
    return finite_samples(df).groupBy(*keys).agg(
        F.when(
            F.count(F.lit(1)) >= rules.minimum_samples, F.stddev_pop("value")
        ).alias("wearable_bvp_variability")
    )


def _split_long(
    df: DataFrame, keys: Sequence[str], block_rows: int, largest: int | None
) -> tuple[DataFrame, DataFrame | None]:
    """Windows that one task can hold, and those that it should not (None if there are none).

    ``largest`` is a known bound of the rows of a window; within ``block_rows`` it saves the count.
    """
    if largest is not None and largest <= block_rows:
        return df, None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long = sizes.where(F.col("_n") > block_rows).select(*keys)
    if long.isEmpty():
        return df, None
    # At most rows / block_rows windows can be this long, so their list stays small.
    long = materialize(long, "long-windows")
    return (
        sized_join(df, long, keys, "left_anti", spread_by=["time"]),
        sized_join(df, long, keys, "left_semi", spread_by=["time"]),
    )


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[key] for key in keys]


def _key_changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Marks of the rows that begin a window of a table sorted by its keys."""
    changes = np.arange(table.num_rows) == 0
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.indices.to_numpy() if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks().indices.to_numpy()
        changes[1:] |= codes[1:] != codes[:-1]
    return changes


def pulse_peaks(
    df: DataFrame,
    keys: Sequence[str] = WINDOW_KEYS,
    *,
    rules: PulseRules = DEFAULT_RULES,
    block_rows: int = BLOCK_ROWS,
    largest_window: int | None = None,
) -> DataFrame:
    """Detected beats: keys, ``position`` (sample number in its window), ``time``, ``height``.

    Local maxima, thinned to the refractory distance with the highest kept first, then required
    to stand out by the prominence floor.
    """
    keys = list(keys)
    finite = finite_samples(df).select(*keys, "time", "value")
    ordinary, long = _split_long(finite, keys, block_rows, largest_window)
    schema = T.StructType(
        [
            *_key_fields(df, keys),
            T.StructField("position", T.LongType()),
            T.StructField("time", T.DoubleType()),
            T.StructField("height", T.DoubleType()),
        ]
    )

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last window, which may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            changes = _key_changes(table, keys)
            last = int(np.flatnonzero(changes)[-1]) if table.num_rows else 0
            held = table.slice(last)
            if last:
                yield from found_in(table.slice(0, last), changes[:last])
        if held is not None and held.num_rows:
            yield from found_in(held, _key_changes(held, keys))

    def found_in(table: pa.Table, changes: np.ndarray) -> Iterator[pa.RecordBatch]:
        windows = Segments.between(changes)
        times, values = table.column("time").to_numpy(), table.column("value").to_numpy()
        found = beats(times, values, windows, rules)
        made = table.select(keys).take(pa.array(found))
        made = made.append_column("position", pa.array(found - windows.starts[windows.of[found]]))
        made = made.append_column("time", pa.array(times[found])).append_column("height", pa.array(values[found]))
        yield from made.combine_chunks().to_batches()

    by_window = ordinary.repartition(*keys).sortWithinPartitions(*keys, "time", "value")
    peaks = by_window.mapInArrow(detect, schema)
    if long is None:
        return peaks
    from sensorloom.operators.long_pulse import long_window_peaks  # it builds on this module

    return peaks.unionByName(long_window_peaks(long, keys, rules=rules, block_rows=block_rows))


def beat_intervals(
    peaks: DataFrame,
    keys: Sequence[str] = WINDOW_KEYS,
    *,
    rules: PulseRules = DEFAULT_RULES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Plausible intervals between successive beats and the change from the kept one before.

    The change is taken over kept intervals, so it can bridge one that was dropped.
    Peaks are handled in blocks of ``block_rows`` sample positions, so a long window takes many
    tasks.
    """
    block = F.floor(F.col("position") / block_rows)
    gaps = first_difference(peaks, keys, "time", "time", "interval", block=block)
    kept = gaps.where(F.col("interval").between(rules.shortest_interval, rules.longest_interval))
    return first_difference(
        kept, keys, "time", "interval", "interval_change", block=block
    )


def interval_summary(intervals: DataFrame, keys: Sequence[str] = WINDOW_KEYS) -> DataFrame:
    """Pulse rate per minute and RMSSD in milliseconds from kept intervals."""
    return intervals.groupBy(*keys).agg(
        (60.0 / F.avg("interval")).alias("wearable_pulse_rate_bpm"),
        (F.sqrt(F.avg(F.col("interval_change") * F.col("interval_change"))) * 1000.0).alias(
            "wearable_pulse_interval_rmssd_ms"
        ),
    )


def pulse_features(
    df: DataFrame,
    keys: Sequence[str] = WINDOW_KEYS,
    *,
    rules: PulseRules = DEFAULT_RULES,
    block_rows: int = BLOCK_ROWS,
    largest_window: int | None = None,
) -> DataFrame:
    """One row per window with ``bvp_window_rows`` and the three pulse features."""
    keys = list(keys)
    samples = df.select(*keys, "time", "value")
    peaks = pulse_peaks(samples, keys, rules=rules, block_rows=block_rows, largest_window=largest_window)
    intervals = beat_intervals(materialize(peaks, "beats"), keys, rules=rules, block_rows=block_rows)
    rows = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("bvp_window_rows"))
    return (
        rows.join(interval_summary(intervals, keys), keys, "left")
        .join(bvp_variability(samples, keys, rules), keys, "left")
        .select(
            *keys,
            "bvp_window_rows",
            "wearable_pulse_rate_bpm",
            "wearable_pulse_interval_rmssd_ms",
            "wearable_bvp_variability",
        )
    )


__all__ = [
    "DEFAULT_RULES",
    "PulseRules",
    "beat_intervals",
    "bvp_variability",
    "centered_pulse",
    "finite_samples",
    "guarded_counts",
    "interval_summary",
    "pulse_features",
    "pulse_peaks",
    "sample_rates",
]
