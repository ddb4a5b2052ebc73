"""The paired feature table: time-aligned, quality-checked, balanced windows of all sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.balance import balance_conditions
from sensorloom.operators.features import eeg_window_features, slow_stream_features
from sensorloom.operators.ordering import BLOCK_ROWS
from sensorloom.operators.pulse import DEFAULT_RULES, PulseRules, pulse_features
from sensorloom.operators.windows import (
    MINIMUM_ROWS,
    assign_windows,
    enough_rows,
    session_audit,
    session_overlap,
    stream_extents,
    window_grid,
)
from sensorloom.schema import EEG_FEATURES, SESSION_KEYS, STREAMS, TARGET, WEARABLE_FEATURES, WINDOW_KEYS
from sensorloom.sources.numeric import eeg_marks
from sensorloom.sources.scratch import materialize, scratch_scope
from sensorloom.sources.tables import cached_table


@dataclass(frozen=True)
class WindowSettings:
    window_seconds: float = 30.0
    warmup_seconds: float = 15.0
    max_windows: int | None = 6
    minimum_rows: Mapping[str, int] = field(default_factory=lambda: dict(MINIMUM_ROWS))
    pulse: PulseRules = DEFAULT_RULES
    block_rows: int = BLOCK_ROWS


def session_windows(
    eeg: DataFrame, samples: DataFrame, settings: WindowSettings, cohort: DataFrame | None = None
) -> DataFrame:
    """Per session (of ``cohort``, if given): row counts, overlap, anchor and candidate windows, as a written table.

    One pass over the times of all streams. Three feature branches and the audit read the result.
    """
    marks = samples.select(*SESSION_KEYS, "stream", "time", "value").unionByName(eeg_marks(eeg))
    grid = window_grid(
        session_overlap(stream_extents(marks), streams=STREAMS),
        window_seconds=settings.window_seconds,
        warmup_seconds=settings.warmup_seconds,
        max_windows=settings.max_windows,
    )
    if cohort is not None:
        grid = grid.join(cohort.select(*SESSION_KEYS), list(SESSION_KEYS), "left_semi")
    return materialize(grid, "session-windows")


def in_any_window(df: DataFrame, grid: DataFrame, settings: WindowSettings) -> DataFrame:
    """Rows between the first and the last instant of all windows: a range that scans of stored samples can skip by."""
    stop = F.col("analysis_start") + F.col("windows_candidate") * F.lit(settings.window_seconds)
    placed = grid.where(F.col("windows_candidate") > 0)
    low, high = placed.agg(F.min("analysis_start"), F.max(stop)).first()
    return df.where(F.col("time").between(low, high)) if low is not None else df


def window_features(
    eeg: DataFrame, samples: DataFrame, grid: DataFrame, settings: WindowSettings
) -> DataFrame:
    """All features of the windows that have enough rows in every stream.

    Each stream is reduced to one row per window before the inner joins; all three sides are
    partitioned by the window keys already, so the joins add no shuffle. The grid knows how many rows each session
    has, so each branch is one scan of its stream.
    """
    width = settings.window_seconds
    eeg, samples = (in_any_window(df, grid, settings) for df in (eeg, samples))
    slow = samples.where(F.col("stream").isin("eda", "temperature"))
    bvp = samples.where(F.col("stream") == "bvp").drop("stream")
    slow_rows = F.col("eda_rows") + F.col("temperature_rows")
    brain = eeg_window_features(assign_windows(eeg, grid, window_seconds=width, rows=F.col("eeg_rows")))
    skin = slow_stream_features(assign_windows(slow, grid, window_seconds=width, rows=slow_rows))
    pulse = pulse_features(
        assign_windows(bvp, grid, window_seconds=width, rows=F.col("bvp_rows")),
        rules=settings.pulse,
        block_rows=settings.block_rows,
        largest_window=grid.agg(F.max("bvp_rows")).first()[0],
    )
    keys = list(WINDOW_KEYS)
    return brain.join(skin, keys).join(pulse, keys).where(enough_rows(settings.minimum_rows))


def paired_feature_table(
    eeg: DataFrame,
    samples: DataFrame,
    labels: DataFrame,
    settings: WindowSettings = WindowSettings(),
) -> tuple[DataFrame, DataFrame]:
    """(features, audit): balanced windows with keys, label, flags and 21 features; session audit.

    ``labels`` is the cohort: it gives each session key its class label, and sessions it does not list
    have no windows. ``samples`` may hold an ``eeg`` stream, which only ``eeg`` itself stands for.
    """
    cohort = labels.select(*SESSION_KEYS, TARGET).distinct()
    samples = samples.where(F.col("stream") != "eeg")
    grid = session_windows(eeg, samples, settings, cohort)
    complete = materialize(window_features(eeg, samples, grid, settings), "windows")
    balanced = balance_conditions(complete)
    start = F.col("analysis_start") + F.col("window_index") * F.lit(float(settings.window_seconds))
    sessions = grid.join(cohort, list(SESSION_KEYS)).select(*SESSION_KEYS, "analysis_start", TARGET)
    features = balanced.join(sessions, list(SESSION_KEYS)).select(
        *SESSION_KEYS,
        "window_index",
        start.alias("window_start_unix"),
        TARGET,
        F.lit(1).alias("eeg_available"),
        F.lit(1).alias("wearable_available"),
        *EEG_FEATURES,
        *WEARABLE_FEATURES,
    )
    return features, session_audit(grid, balanced)


def cached_paired_table(
    root: str,
    eeg: DataFrame,
    samples: DataFrame,
    labels: DataFrame,
    settings: WindowSettings = WindowSettings(),
    *,
    inputs: Sequence[str],
    rebuild: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(features, audit) of :func:`paired_feature_table`, stored below ``root`` side by side.

    They are built once for these settings and this state of the files ``inputs`` that the streams come from. What the build
    wrote on its way is deleted.
    """
    spark, made = eeg.sparkSession, {}

    def build(part: str) -> DataFrame:
        if not made:
            made["features"], made["audit"] = paired_feature_table(eeg, samples, labels, settings)
        return made[part]

    with scratch_scope():
        features, audit = (
            cached_table(
                spark, root, f"paired-{part}", asdict(settings), lambda: build(part), inputs=inputs, rebuild=rebuild
            )
            for part in ("features", "audit")
        )
    return features, audit


def require_windows(features: DataFrame) -> None:
    if features.isEmpty():
        raise ValueError("No window of a subject with both conditions passed the quality checks.")
