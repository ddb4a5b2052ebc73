"""Overlap, window grid, assignment, quality, per-window features, balancing, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import epoch_seconds
from sensorloom.operators.balance import balance_conditions, condition_counts, used_window_counts
from sensorloom.operators.features import (
    eeg_window_features,
    level,
    log_ratios,
    pooled_channels,
    slow_stream_features,
    spread,
    trend,
)
from sensorloom.operators.ordering import first_difference, with_position
from sensorloom.operators.pulse import finite_samples
from sensorloom.operators.windows import (
    assign_windows,
    enough_rows,
    session_audit,
    session_overlap,
    stream_extents,
    time_slice,
    window_grid,
    window_row_counts,
)
from sensorloom.plans.fixtures import (
    DAY,
    EEG_SQL,
    EVENT_STREAMS,
    SAMPLES_SQL,
    assigned_sql,
    event_samples,
    grid_sql,
    overlap_sql,
    table,
    wide_eeg,
)
from sensorloom.plans.queries.common import r, rounded
from sensorloom.schema import BANDS, EEG_FEATURES, SESSION_KEYS, STREAMS
from sensorloom.sources.scratch import materialize

WIDTH, WARMUP, CAP = 3 * DAY, DAY, 6
ONE_ROW = dict.fromkeys(STREAMS, 1)


def _overlap(samples: DataFrame) -> DataFrame:
    return session_overlap(stream_extents(samples))


def _grid(samples: DataFrame) -> DataFrame:
    grid = window_grid(
        _overlap(samples), window_seconds=WIDTH, warmup_seconds=WARMUP, max_windows=CAP
    )
    return materialize(grid, "session-windows")


def _assigned(samples: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    return assign_windows(samples, _grid(samples) if grid is None else grid, window_seconds=WIDTH)


GRID_CTES = f"{SAMPLES_SQL},\n{overlap_sql()},\n{grid_sql(WIDTH, WARMUP, CAP)}"
ASSIGNED_CTES = f"{GRID_CTES},\n{assigned_sql(WIDTH)}"
COUNT_COLUMNS = ", ".join(f"count(CASE WHEN stream = '{s}' THEN 1 END) AS {s}_window_rows" for s in STREAMS)
QUALITY = " AND ".join(f"{s}_window_rows >= 1" for s in STREAMS)
WINDOWS_CTES = f"""{ASSIGNED_CTES},
window_rows AS (SELECT patient_id, condition, window_index, {COUNT_COLUMNS} FROM assigned GROUP BY ALL),
kept AS (SELECT * FROM window_rows WHERE {QUALITY})"""
BALANCED_CTES = f"""{WINDOWS_CTES},
condition_sizes AS (SELECT patient_id, condition, count(*) AS windows FROM kept GROUP BY ALL),
limits AS (SELECT patient_id, count(*) AS conditions, min(windows) AS windows_per_condition
           FROM condition_sizes GROUP BY ALL),
balanced AS (
  SELECT * EXCLUDE (n, conditions, windows_per_condition) FROM (
    SELECT kept.*, limits.conditions, limits.windows_per_condition,
           row_number() OVER (PARTITION BY patient_id, condition ORDER BY window_index) AS n
    FROM kept JOIN limits USING (patient_id)) WHERE conditions = 2 AND n <= windows_per_condition)"""


def sliced_events(spark: SparkSession, folder: str) -> DataFrame:
    samples = event_samples(spark, folder).select("event_id", "stream", "time", "value")
    return rounded(time_slice(samples, F.lit(1704499200.0), F.lit(1705104000.0)))


SLICED_EVENTS = f"""
WITH {SAMPLES_SQL} SELECT event_id, stream, {r('"time"')} AS "time", {r('value')} AS value
FROM samples WHERE "time" >= 1704499200.0 AND "time" < 1705104000.0"""


def finite_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Values spoiled by stream and by size."""
    spoiled = event_samples(spark, folder).select(
        "event_id",
        "time",
        F.when(F.col("stream") == "eeg", float("nan"))
        .when(F.col("value") > 100, float("inf"))
        .when(F.col("value") < 1, float("-inf"))
        .when(F.col("stream") == "bvp", F.lit(None))
        .otherwise(F.col("value"))
        .alias("value"),
    )
    return rounded(finite_samples(spoiled))


FINITE_MASK = f"""
WITH {SAMPLES_SQL} SELECT event_id, {r('"time"')} AS "time", {r('value')} AS value
FROM samples WHERE stream NOT IN ('eeg', 'bvp') AND value BETWEEN 1 AND 100"""


def stream_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_overlap(event_samples(spark, folder)))


STREAM_OVERLAP = f"""
WITH {SAMPLES_SQL}, {overlap_sql()}
SELECT * EXCLUDE (overlap_start, overlap_stop), {r('overlap_start')} AS overlap_start,
       {r('overlap_stop')} AS overlap_stop, {r('overlap_stop - overlap_start')} AS overlap_seconds
FROM overlap"""


def window_grid_rows(spark: SparkSession, folder: str) -> DataFrame:
    grid = _grid(event_samples(spark, folder))
    return rounded(grid.select(*SESSION_KEYS, "analysis_start", "windows_candidate"))


WINDOW_GRID_ROWS = f"""
WITH {GRID_CTES} SELECT patient_id, condition, {r('analysis_start')} AS analysis_start, windows_candidate
FROM grid"""


def window_assignment(spark: SparkSession, folder: str) -> DataFrame:
    assigned = _assigned(event_samples(spark, folder))
    return rounded(assigned.select("event_id", "stream", "window_index", "window_start_unix"))


WINDOW_ASSIGNMENT = f"""
WITH {ASSIGNED_CTES}
SELECT event_id, stream, window_index, {r('window_start_unix')} AS window_start_unix FROM assigned"""


def salted_window_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """The same assignment with the salted join that large session tables get."""
    samples = event_samples(spark, folder)
    assigned = assign_windows(
        samples, _grid(samples), window_seconds=WIDTH, broadcast_rows=0, hot_rows=50
    )
    return rounded(assigned.select("event_id", "stream", "window_index", "window_start_unix"))


def window_quality(spark: SparkSession, folder: str) -> DataFrame:
    return window_row_counts(_assigned(event_samples(spark, folder))).where(enough_rows(ONE_ROW))


WINDOW_QUALITY = f"WITH {WINDOWS_CTES} SELECT * FROM kept"


def level_and_spread(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        table(spark, folder, "events")
        .groupBy("user_id", "event_type")
        .agg(level("value").alias("mean"), spread("value").alias("variability"))
    )


LEVEL_AND_SPREAD = f"""
SELECT user_id, event_type, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS variability
FROM events GROUP BY ALL"""


def linear_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Value change per day of every user and event type."""
    days = (epoch_seconds("ts") - F.lit(1704067200.0)) / F.lit(DAY)
    return rounded(
        table(spark, folder, "events")
        .groupBy("user_id", "event_type")
        .agg(trend(F.col("value"), days).alias("slope"))
    )


LINEAR_TREND = f"""
SELECT user_id, event_type,
       {r("nullif(regr_slope(value, (epoch_us(ts) / 1e6 - 1704067200.0) / 86400.0), CAST('nan' AS DOUBLE))")} AS slope
FROM events GROUP BY ALL"""


def pooled_embedding_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding entries pooled in four groups of sixteen, per label."""
    embeddings = table(spark, folder, "embeddings").select(
        "label", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64))
    )
    groups = {f"part{g}": [f"e{i}" for i in range(16 * g, 16 * g + 16)] for g in range(4)}
    return rounded(pooled_channels(embeddings, ["label"], groups))


POOLED_EMBEDDING_CHANNELS = f"""
WITH entries AS (
  SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS e, unnest(range(64)) // 16 AS part FROM embeddings)
SELECT label, count(DISTINCT vec_id) AS channel_rows,
       {", ".join(f"{r(f'avg(e) FILTER (part = {g})')} AS part{g}_mean" for g in range(4))},
       {", ".join(f"{r(f'stddev_pop(e) FILTER (part = {g})')} AS part{g}_variability" for g in range(4))}
FROM entries GROUP BY label"""


def eeg_features(spark: SparkSession, folder: str) -> DataFrame:
    samples = event_samples(spark, folder)
    assigned = _assigned(wide_eeg(samples), _grid(samples))
    columns = ["patient_id", "condition", "window_index", "eeg_window_rows", *EEG_FEATURES]
    return rounded(eeg_window_features(assigned).select(columns))


def _pooled_sql(band: str) -> str:
    name = band.capitalize()
    return ", ".join(f"{name}_{electrode}" for electrode in ("TP9", "AF7", "AF8", "TP10"))


EEG_FEATURES_CTES = f"""{ASSIGNED_CTES}, {EEG_SQL},
{assigned_sql(WIDTH, 'eeg', 'eeg_assigned')},
eeg_long AS (
  SELECT patient_id, condition, window_index, unnest([1, 2, 3, 4]) AS electrode,
         {", ".join(f"unnest([{_pooled_sql(b)}]) AS {b}" for b in BANDS)}
  FROM eeg_assigned),
eeg_pooled AS (
  SELECT patient_id, condition, window_index, count(*) FILTER (electrode = 1) AS eeg_window_rows,
         {", ".join(f"avg({b}) AS eeg_{b}_mean, stddev_pop({b}) AS eeg_{b}_variability" for b in BANDS)}
  FROM eeg_long GROUP BY ALL),
eeg_features AS (
  SELECT *, eeg_theta_mean - eeg_alpha_mean AS eeg_theta_alpha_ratio,
         eeg_beta_mean - eeg_alpha_mean AS eeg_beta_alpha_ratio FROM eeg_pooled)"""
EEG_FEATURES_SQL = f"""
WITH {EEG_FEATURES_CTES}
SELECT patient_id, condition, window_index, eeg_window_rows,
       {", ".join(f"{r(f)} AS {f}" for f in EEG_FEATURES)} FROM eeg_features"""


def log_band_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios of log-power means: here the means of three event types per user."""
    means = (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(
            F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("eeg_theta_mean"),
            F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("eeg_alpha_mean"),
            F.avg(F.when(F.col("event_type") == "error", F.col("value"))).alias("eeg_beta_mean"),
        )
    )
    return rounded(log_ratios(means).select("user_id", "eeg_theta_alpha_ratio", "eeg_beta_alpha_ratio"))


LOG_BAND_RATIOS = f"""
WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS t,
                  avg(value) FILTER (event_type = 'view') AS a,
                  avg(value) FILTER (event_type = 'error') AS b FROM events GROUP BY ALL)
SELECT user_id, {r('t - a')} AS eeg_theta_alpha_ratio, {r('b - a')} AS eeg_beta_alpha_ratio FROM m"""


def slow_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slow_stream_features(_assigned(event_samples(spark, folder))))


SLOW_FEATURES_CTE = """slow_features AS (
  SELECT patient_id, condition, window_index, """ + ",\n         ".join(
    f"""count(*) FILTER (stream = '{s}') AS {s}_window_rows,
         avg(value) FILTER (stream = '{s}') AS wearable_{s}_mean,
         stddev_pop(value) FILTER (stream = '{s}') AS wearable_{s}_variability,
         nullif(regr_slope(value, "time" - window_start_unix) FILTER (stream = '{s}'), CAST('nan' AS DOUBLE))
           AS wearable_{s}_slope"""
    for s in ("eda", "temperature")
) + """
  FROM assigned GROUP BY ALL)"""
SLOW_FEATURES_SQL = f"""
WITH {ASSIGNED_CTES}, {SLOW_FEATURES_CTE}
SELECT patient_id, condition, window_index, """ + ", ".join(
    f"{s}_window_rows, " + ", ".join(
        f"{r(f'wearable_{s}_{p}')} AS wearable_{s}_{p}" for p in ("mean", "variability", "slope")
    )
    for s in ("eda", "temperature")
) + " FROM slow_features"


def _aligned(samples: DataFrame) -> DataFrame:
    """One aggregate per stream, then inner joins on the window keys."""
    assigned = _assigned(samples)
    keys = [*SESSION_KEYS, "window_index"]
    result = None
    for stream in STREAMS:
        part = assigned.where(F.col("stream") == stream).groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{stream}_window_rows"), F.avg("value").alias(f"{stream}_mean")
        )
        result = part if result is None else result.join(part, keys)
    return result


def aligned_windows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_aligned(event_samples(spark, folder)))


ALIGNED_WINDOWS = f"""
WITH {ASSIGNED_CTES}
SELECT patient_id, condition, window_index, {COUNT_COLUMNS},
       {", ".join(f"{r(f'''avg(CASE WHEN stream = '{s}' THEN value END)''')} AS {s}_mean" for s in STREAMS)}
FROM assigned GROUP BY ALL HAVING {QUALITY}"""


def _kept(samples: DataFrame) -> DataFrame:
    return window_row_counts(_assigned(samples)).where(enough_rows(ONE_ROW))


def balanced_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = condition_counts(_kept(event_samples(spark, folder)))
    return counts.where(F.col("conditions") == 2).select("patient_id", "windows_per_condition")


BALANCED_COUNTS = f"""
WITH {BALANCED_CTES} SELECT patient_id, windows_per_condition FROM limits WHERE conditions = 2"""


def balanced_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship slice: overlap, grid, assignment, quality, alignment and balancing."""
    kept = materialize(_kept(event_samples(spark, folder)), "windows")
    balanced = balance_conditions(kept)
    return balanced.select(*SESSION_KEYS, "window_index", *(f"{s}_window_rows" for s in STREAMS))


BALANCED_WINDOWS = f"WITH {BALANCED_CTES} SELECT * FROM balanced"


def used_windows(spark: SparkSession, folder: str) -> DataFrame:
    kept = materialize(_kept(event_samples(spark, folder)), "windows")
    return used_window_counts(balance_conditions(kept))


USED_WINDOWS = f"""
WITH {BALANCED_CTES}
SELECT patient_id, condition, count(*) AS windows_used_after_balancing FROM balanced GROUP BY ALL"""


def audit(spark: SparkSession, folder: str) -> DataFrame:
    samples = event_samples(spark, folder)
    grid = _grid(samples)
    kept = window_row_counts(_assigned(samples, grid)).where(enough_rows(ONE_ROW))
    return rounded(session_audit(grid, balance_conditions(materialize(kept, "windows"))))


AUDIT = f"""
WITH {BALANCED_CTES},
used AS (SELECT patient_id, condition, count(*) AS windows_used_after_balancing FROM balanced GROUP BY ALL)
SELECT g.patient_id, g.condition, {", ".join(f"{s}_rows" for s in STREAMS)},
       {r('overlap_seconds')} AS overlap_seconds, windows_candidate, windows_used_after_balancing
FROM grid g LEFT JOIN used USING (patient_id, condition)"""


def availability_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(event_samples(spark, folder)).select(
        *SESSION_KEYS,
        "window_index",
        F.lit(1).alias("eeg_available"),
        F.lit(1).alias("wearable_available"),
    )


AVAILABILITY_FLAGS = f"""
WITH {WINDOWS_CTES}
SELECT patient_id, condition, window_index, 1 AS eeg_available, 1 AS wearable_available FROM kept"""


def value_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Step of each event's value per event type.

    There are only five event types, each with a large share of all rows, so they are cut into
    blocks (here of a thousand rows).
    """
    events = table(spark, folder, "events").select(
        "event_id", "event_type", epoch_seconds("ts").alias("time"), "value"
    )
    steps = first_difference(
        events, ["event_type"], "time", "value", "step", tie=["event_id"], block_rows=1_000
    )
    return rounded(steps.select("event_id", "event_type", "step"))


VALUE_DIFFERENCES = f"""
SELECT event_id, event_type,
       {r('value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)')} AS step
FROM events"""


def sorted_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical order of the feature table as a column."""
    kept = _kept(event_samples(spark, folder)).select(*SESSION_KEYS, "window_index")
    return with_position(kept, [*SESSION_KEYS, "window_index"])


SORTED_WINDOWS = f"""
WITH {WINDOWS_CTES} SELECT patient_id, condition, window_index,
       row_number() OVER (ORDER BY patient_id, condition, window_index) AS position FROM kept"""


def first_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Head of the window table in canonical order."""
    kept = _kept(event_samples(spark, folder))
    return kept.orderBy(*SESSION_KEYS, "window_index").limit(5).select(*SESSION_KEYS, "window_index")


FIRST_WINDOWS = f"""
WITH {WINDOWS_CTES} SELECT patient_id, condition, window_index FROM kept
ORDER BY patient_id, condition, window_index LIMIT 5"""


def united_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Bag union of the streams, one part each."""
    samples = event_samples(spark, folder).select("event_id", "stream", "value")
    parts = [samples.where(F.col("stream") == s) for s in EVENT_STREAMS]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return rounded(united)


UNITED_PARTS = f"WITH {SAMPLES_SQL} SELECT event_id, stream, {r('value')} AS value FROM samples"

QUERIES = {
    "sliced_events": (sliced_events, SLICED_EVENTS),
    "finite_mask": (finite_mask, FINITE_MASK),
    "stream_overlap": (stream_overlap, STREAM_OVERLAP),
    "window_grid": (window_grid_rows, WINDOW_GRID_ROWS),
    "window_assignment": (window_assignment, WINDOW_ASSIGNMENT),
    "salted_window_assignment": (salted_window_assignment, WINDOW_ASSIGNMENT),
    "window_quality": (window_quality, WINDOW_QUALITY),
    "level_and_spread": (level_and_spread, LEVEL_AND_SPREAD),
    "linear_trend": (linear_trend, LINEAR_TREND),
    "pooled_embedding_channels": (pooled_embedding_channels, POOLED_EMBEDDING_CHANNELS),
    "eeg_window_features": (eeg_features, EEG_FEATURES_SQL),
    "log_band_ratios": (log_band_ratios, LOG_BAND_RATIOS),
    "slow_stream_features": (slow_features, SLOW_FEATURES_SQL),
    "aligned_windows": (aligned_windows, ALIGNED_WINDOWS),
    "balanced_counts": (balanced_counts, BALANCED_COUNTS),
    "balanced_windows": (balanced_windows, BALANCED_WINDOWS),
    "used_window_counts": (used_windows, USED_WINDOWS),
    "session_audit": (audit, AUDIT),
    "availability_flags": (availability_flags, AVAILABILITY_FLAGS),
    "value_differences": (value_differences, VALUE_DIFFERENCES),
    "sorted_windows": (sorted_windows, SORTED_WINDOWS),
    "first_windows": (first_windows, FIRST_WINDOWS),
    "united_parts": (united_parts, UNITED_PARTS),
}
