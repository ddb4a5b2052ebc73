"""Per-window level, spread, trend and pooled-channel features, all as partial aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import is_finite
from sensorloom.schema import BAND_CHANNELS, WINDOW_KEYS


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def level(value: str | Column) -> Column:
    return F.avg(_col(value))


def spread(value: str | Column) -> Column:
    """Population standard deviation."""
    return F.stddev_pop(_col(value))


def trend(value: str | Column, time: str | Column) -> Column:
    """Least-squares slope over finite pairs; NULL below two pairs or without a time range."""
    value, time = _col(value), _col(time)
    usable = is_finite(value) & is_finite(time)
    return F.regr_slope(F.when(usable, value), F.when(usable, time))


def pooled_channels(
    df: DataFrame,
    keys: Sequence[str],
    groups: Mapping[str, Sequence[str]],
) -> DataFrame:
    """``<group>_mean`` and ``<group>_variability`` over all values of a group's channels.

    Each row becomes one row per channel position, with one column per group, and the pooled
    moments are plain aggregates of those columns. Five bands of four electrodes thus give four
    narrow rows and ten accumulators, combined before the shuffle; one row per channel would
    give twenty rows, and one accumulator set per channel sixty accumulators. Non-finite text has
    become NULL at the scan, so NULLs are skipped and channels may differ in their counts.
    """
    positions = range(max(len(members) for members in groups.values()))
    missing = F.lit(None).cast("double")
    per_position = F.array(
        *(
            F.struct(
                F.lit(i == 0).alias("is_first"),
                *(
                    (F.col(members[i]).cast("double") if i < len(members) else missing).alias(group)
                    for group, members in groups.items()
                ),
            )
            for i in positions
        )
    )
    return (
        df.select(*keys, F.explode(per_position).alias("_channel"))
        .select(*keys, "_channel.*")
        .groupBy(*keys)
        .agg(
            F.count(F.when(F.col("is_first"), 1)).alias("channel_rows"),
            *(F.avg(group).alias(f"{group}_mean") for group in groups),
            *(F.stddev_pop(group).alias(f"{group}_variability") for group in groups),
        )
    )


def log_ratios(df: DataFrame, prefix: str = "eeg_") -> DataFrame:
    """Band ratios; the band powers are logarithms, so ratios are differences."""
    alpha = F.col(f"{prefix}alpha_mean")
    return df.select(
        "*",
        (F.col(f"{prefix}theta_mean") - alpha).alias(f"{prefix}theta_alpha_ratio"),
        (F.col(f"{prefix}beta_mean") - alpha).alias(f"{prefix}beta_alpha_ratio"),
    )


def eeg_window_features(assigned_eeg: DataFrame, keys: Sequence[str] = WINDOW_KEYS) -> DataFrame:
    """Twelve band features per window, with ``eeg_window_rows``."""
    groups = {f"eeg_{band}": channels for band, channels in BAND_CHANNELS.items()}
    pooled = pooled_channels(assigned_eeg, keys, groups)
    return log_ratios(pooled).withColumnRenamed("channel_rows", "eeg_window_rows")


def slow_stream_features(
    assigned: DataFrame,
    streams: Sequence[str] = ("eda", "temperature"),
    keys: Sequence[str] = WINDOW_KEYS,
) -> DataFrame:
    """Mean, variability and slope of each slow stream, all streams in one aggregate."""
    elapsed = F.col("time") - F.col("window_start_unix")
    aggregates = []
    for stream in streams:
        here = F.col("stream") == stream
        value = F.when(here, F.col("value"))
        aggregates += [
            F.count(F.when(here, 1)).alias(f"{stream}_window_rows"),
            level(value).alias(f"wearable_{stream}_mean"),
            spread(value).alias(f"wearable_{stream}_variability"),
            trend(value, elapsed).alias(f"wearable_{stream}_slope"),
        ]
    return assigned.groupBy(*keys).agg(*aggregates)
