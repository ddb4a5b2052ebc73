"""Beat detection and the feature tables that use it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.pulse import (
    PulseRules,
    beat_intervals,
    bvp_variability,
    centered_pulse,
    guarded_counts,
    interval_summary,
    pulse_features,
    pulse_peaks,
    sample_rates,
)
from sensorloom.operators.features import slow_stream_features
from sensorloom.operators.windows import assign_windows
from sensorloom.plans.fixtures import (
    DAY,
    SAMPLES_SQL,
    event_labels,
    event_samples,
    wide_eeg,
)
from sensorloom.plans.paired import WindowSettings, paired_feature_table, session_windows
from sensorloom.plans.queries.common import r, rounded
from sensorloom.plans.queries.windows import (
    AUDIT,
    ASSIGNED_CTES,
    CAP,
    EEG_FEATURES_CTES,
    ONE_ROW,
    SLOW_FEATURES_CTE,
    WARMUP,
    WIDTH,
)
from sensorloom.schema import EEG_FEATURES, SESSION_KEYS, TARGET, WEARABLE_FEATURES, WINDOW_KEYS

# Times in days: the events of a user come a few hours apart.
RULES = PulseRules(refractory_seconds=1.0, shortest_interval=0.5, longest_interval=6.0)
SETTINGS = WindowSettings(
    window_seconds=WIDTH,
    warmup_seconds=WARMUP,
    max_windows=CAP,
    minimum_rows=ONE_ROW,
    pulse=PulseRules(refractory_seconds=DAY, shortest_interval=0.1 * DAY, longest_interval=3 * DAY),
)


def user_signal(spark: SparkSession, folder: str) -> DataFrame:
    """All stream events of a user as one signal over its whole range."""
    return event_samples(spark, folder).select(
        *SESSION_KEYS, (F.col("time") / F.lit(DAY)).alias("time"), "value", "k", "event_id"
    )


SIGNAL_CTES = f"""{SAMPLES_SQL},
signal AS (SELECT patient_id, condition, "time" / 86400.0 AS "time", value, k, event_id FROM samples)"""


def pulse_sql(source: str, keys: Sequence[str], rules: PulseRules) -> str:
    """CTEs ``peaks``, ``intervals`` and ``pulse`` over finite samples of ``source``."""
    k = ", ".join(keys)
    over = f"OVER (PARTITION BY {k} ORDER BY"
    return f"""numbered AS (
  SELECT {k}, "time", value, row_number() {over} "time", value) - 1 AS position,
         "time" - lag("time") {over} "time", value) AS step
  FROM {source}),
signal_stats AS (
  SELECT {k}, count(*) AS n, median(step) AS step, stddev_pop(value) AS deviation
  FROM numbered GROUP BY ALL),
limits_of_beats AS (
  SELECT *, greatest(1, CAST(round_even((1.0 / step) * {rules.refractory_seconds}, 0) AS BIGINT)) AS distance,
         greatest(deviation * {rules.prominence_share}, {rules.prominence_floor}) AS prominence
  FROM signal_stats WHERE n >= {rules.minimum_samples} AND step <> 0),
changes AS (
  SELECT *, CASE WHEN value = lag(value) {over} position) THEN 0 ELSE 1 END AS change FROM numbered),
plateaus AS (
  SELECT {k}, run, min(position) AS first_position, max(position) AS last_position, min(value) AS height
  FROM (SELECT *, sum(change) {over} position) AS run FROM changes) GROUP BY ALL),
maxima AS (
  SELECT {k}, (first_position + last_position) // 2 AS position, height
  FROM (SELECT *, lag(height) {over} run) AS before, lead(height) {over} run) AS after FROM plateaus)
  WHERE height > before AND height > after),
by_height AS (
  SELECT m.*, distance, row_number() {over} height DESC, position DESC) AS place,
         count(*) OVER (PARTITION BY {k}) AS places
  FROM maxima m JOIN limits_of_beats USING ({k})),
thinned AS (
  SELECT {k}, places, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS kept FROM by_height WHERE place = 1
  UNION ALL
  SELECT {", ".join(f"t.{key}" for key in keys)}, t.places, t.place + 1,
         CASE WHEN len(list_filter(t.kept, lambda q: abs(q - b.position) < b.distance)) > 0
              THEN t.kept ELSE list_append(t.kept, b.position) END
  FROM thinned t JOIN by_height b
    ON {" AND ".join(f"t.{key} = b.{key}" for key in keys)} AND b.place = t.place + 1),
spaced AS (
  SELECT {k}, position, "time", value AS height, prominence
  FROM (SELECT {k}, unnest(kept) AS position FROM thinned WHERE place = places)
  JOIN numbered USING ({k}, position) JOIN limits_of_beats USING ({k})),
walled AS (
  SELECT {k}, c.position, c.height, c.prominence, c."time",
         coalesce(max(CASE WHEN n.position < c.position AND n.value > c.height THEN n.position END), -1) AS lw,
         coalesce(min(CASE WHEN n.position > c.position AND n.value > c.height THEN n.position END),
                  9223372036854775807) AS rw
  FROM spaced c JOIN numbered n USING ({k}) GROUP BY ALL),
based AS (
  SELECT {k}, w.position, w.height, w.prominence, w."time",
         min(CASE WHEN n.position <= w.position AND n.position > lw THEN n.value END) AS lb,
         min(CASE WHEN n.position >= w.position AND n.position < rw THEN n.value END) AS rb
  FROM walled w JOIN numbered n USING ({k}) GROUP BY ALL),
peaks AS (
  SELECT {k}, position, "time", height FROM based WHERE height - greatest(lb, rb) >= prominence),
intervals AS (
  SELECT *, interval - lag(interval) {over} "time") AS interval_change
  FROM (SELECT *, "time" - lag("time") {over} "time") AS interval FROM peaks)
  WHERE interval BETWEEN {rules.shortest_interval} AND {rules.longest_interval}),
rates AS (
  SELECT {k}, 60.0 / avg(interval) AS wearable_pulse_rate_bpm,
         sqrt(avg(interval_change * interval_change)) * 1000.0 AS wearable_pulse_interval_rmssd_ms
  FROM intervals GROUP BY ALL),
pulse AS (
  SELECT {k}, s.n AS bvp_window_rows, wearable_pulse_rate_bpm, wearable_pulse_interval_rmssd_ms,
         CASE WHEN n >= {rules.minimum_samples} THEN deviation END AS wearable_bvp_variability
  FROM signal_stats s LEFT JOIN rates USING ({k}))"""


_SIGNAL_PULSE = f"WITH RECURSIVE {SIGNAL_CTES},\n{pulse_sql('signal', SESSION_KEYS, RULES)}"


def pulse_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Large values spoiled as infinite, small ones as not a number."""
    value = F.col("value")
    spoiled = user_signal(spark, folder).withColumn(
        "value", F.when(value > 100, float("inf")).when(value < 60, float("nan")).otherwise(value)
    )
    return guarded_counts(spoiled, SESSION_KEYS)


PULSE_GUARD = f"""
WITH {SIGNAL_CTES}
SELECT patient_id, condition, count(CASE WHEN value BETWEEN 60 AND 100 THEN 1 END) AS finite_samples,
       count(CASE WHEN value BETWEEN 60 AND 100 THEN 1 END) >= 3 AS is_usable FROM signal GROUP BY ALL"""


def sample_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sample_rates(user_signal(spark, folder), SESSION_KEYS))


def blocked_sample_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The same rates where signals above forty samples are cut into blocks."""
    return rounded(sample_rates(user_signal(spark, folder), SESSION_KEYS, block_rows=40))


SAMPLE_RATE = f"""
WITH {SIGNAL_CTES},
steps AS (SELECT patient_id, condition,
                 "time" - lag("time") OVER (PARTITION BY patient_id, condition ORDER BY "time") AS step
          FROM signal)
SELECT patient_id, condition, {r('CASE WHEN median(step) <> 0 THEN 1.0 / median(step) END')} AS sample_rate
FROM steps GROUP BY ALL"""


def pulse_center(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(centered_pulse(user_signal(spark, folder), SESSION_KEYS))


PULSE_CENTER = f"""
WITH {SIGNAL_CTES}
SELECT patient_id, condition, {r('median(value)')} AS value_median,
       {r('stddev_pop(value)')} AS bvp_variability,
       {r('greatest(stddev_pop(value) * 0.25, 1e-6)')} AS prominence_floor
FROM signal GROUP BY ALL"""


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pulse_peaks(user_signal(spark, folder), SESSION_KEYS, rules=RULES))


def long_signal_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """The same peaks where signals above forty samples are too long for one task."""
    signal = user_signal(spark, folder)
    return rounded(pulse_peaks(signal, SESSION_KEYS, rules=RULES, block_rows=40))


PEAKS = f"""{_SIGNAL_PULSE}
SELECT patient_id, condition, position, {r('"time"')} AS "time", {r('height')} AS height FROM peaks"""


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    found = pulse_peaks(user_signal(spark, folder), SESSION_KEYS, rules=RULES)
    kept = beat_intervals(found, SESSION_KEYS, rules=RULES)
    return rounded(kept.select(*SESSION_KEYS, "position", "interval", "interval_change"))


INTERVALS = f"""{_SIGNAL_PULSE}
SELECT patient_id, condition, position, {r('interval')} AS interval,
       {r('interval_change')} AS interval_change FROM intervals"""


def rates(spark: SparkSession, folder: str) -> DataFrame:
    found = pulse_peaks(user_signal(spark, folder), SESSION_KEYS, rules=RULES)
    return rounded(interval_summary(beat_intervals(found, SESSION_KEYS, rules=RULES), SESSION_KEYS))


RATES = f"""{_SIGNAL_PULSE}
SELECT patient_id, condition, {r('wearable_pulse_rate_bpm')} AS wearable_pulse_rate_bpm,
       {r('wearable_pulse_interval_rmssd_ms')} AS wearable_pulse_interval_rmssd_ms FROM rates"""


def variability(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bvp_variability(user_signal(spark, folder), SESSION_KEYS))


VARIABILITY = f"""
WITH {SIGNAL_CTES}
SELECT patient_id, condition,
       {r('CASE WHEN count(*) >= 3 THEN stddev_pop(value) END')} AS wearable_bvp_variability
FROM signal GROUP BY ALL"""


def signal_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pulse_features(user_signal(spark, folder), SESSION_KEYS, rules=RULES))


def long_signal_features(spark: SparkSession, folder: str) -> DataFrame:
    """The same features where signals above forty samples are too long for one task."""
    signal = user_signal(spark, folder)
    return rounded(pulse_features(signal, SESSION_KEYS, rules=RULES, block_rows=40))


SIGNAL_FEATURES = f"""{_SIGNAL_PULSE}
SELECT patient_id, condition, bvp_window_rows,
       {", ".join(f"{r(f)} AS {f}" for f in WEARABLE_FEATURES[:3])} FROM pulse"""


def wearable_features(spark: SparkSession, folder: str) -> DataFrame:
    samples = event_samples(spark, folder)
    grid = session_windows(wide_eeg(samples), samples, SETTINGS)
    slow = slow_stream_features(assign_windows(samples, grid, window_seconds=WIDTH))
    bvp = samples.where(F.col("stream") == "bvp")
    pulse = pulse_features(assign_windows(bvp, grid, window_seconds=WIDTH), rules=SETTINGS.pulse)
    return rounded(
        pulse.join(slow, list(WINDOW_KEYS)).select(*WINDOW_KEYS, *WEARABLE_FEATURES)
    )


_WEARABLE_CTES = f"""bvp AS (
  SELECT patient_id, condition, window_index, "time", value FROM assigned WHERE stream = 'bvp'),
{pulse_sql('bvp', WINDOW_KEYS, SETTINGS.pulse)},
{SLOW_FEATURES_CTE}"""
_WEARABLE_COLUMNS = ", ".join(f"{r(f)} AS {f}" for f in WEARABLE_FEATURES)
WEARABLE_FEATURES_SQL = f"""
WITH RECURSIVE {ASSIGNED_CTES}, {_WEARABLE_CTES}
SELECT patient_id, condition, window_index, {_WEARABLE_COLUMNS}
FROM pulse JOIN slow_features USING (patient_id, condition, window_index)"""


def paired_features(spark: SparkSession, folder: str) -> DataFrame:
    """The whole paired table: twelve EEG and nine wearable features of balanced windows."""
    samples = event_samples(spark, folder)
    features, _ = paired_feature_table(
        wide_eeg(samples),
        samples.select(*SESSION_KEYS, "stream", "time", "value"),
        event_labels(samples),
        SETTINGS,
    )
    return rounded(features)


def cohort_paired_features(spark: SparkSession, folder: str) -> DataFrame:
    """The paired table where half of all sessions come again under a condition that the cohort does not list."""
    samples = event_samples(spark, folder)
    foreign = samples.where(F.col("condition") == "baseline").withColumn("condition", F.lit("recovery"))
    every = samples.unionByName(foreign)
    features, _ = paired_feature_table(
        wide_eeg(every),
        every.select(*SESSION_KEYS, "stream", "time", "value"),
        event_labels(samples),
        SETTINGS,
    )
    return rounded(features)


def paired_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The session audit that the paired table's own plan gives."""
    samples = event_samples(spark, folder)
    _, audit = paired_feature_table(
        wide_eeg(samples),
        samples.select(*SESSION_KEYS, "stream", "time", "value"),
        event_labels(samples),
        SETTINGS,
    )
    return rounded(audit)


PAIRED_CTES = f"""{EEG_FEATURES_CTES}, {_WEARABLE_CTES},
complete AS (
  SELECT * FROM eeg_features JOIN slow_features USING (patient_id, condition, window_index)
    JOIN pulse USING (patient_id, condition, window_index)
  WHERE eeg_window_rows >= 1 AND bvp_window_rows >= 1 AND eda_window_rows >= 1
    AND temperature_window_rows >= 1),
sizes AS (SELECT patient_id, condition, count(*) AS windows FROM complete GROUP BY ALL),
smaller AS (SELECT patient_id, min(windows) AS m FROM sizes GROUP BY ALL HAVING count(*) = 2),
ranked AS (
  SELECT complete.*, m, row_number() OVER (PARTITION BY patient_id, condition ORDER BY window_index) AS n
  FROM complete JOIN smaller USING (patient_id)),
paired AS MATERIALIZED (
  SELECT patient_id, condition, window_index, analysis_start + window_index * {WIDTH} AS window_start_unix,
         CASE WHEN condition = 'baseline' THEN 0 ELSE 1 END AS {TARGET},
         {", ".join((*EEG_FEATURES, *WEARABLE_FEATURES))}
  FROM ranked JOIN grid USING (patient_id, condition) WHERE n <= m)"""
PAIRED_FEATURES = f"""
WITH RECURSIVE {PAIRED_CTES}
SELECT patient_id, condition, window_index, {r('window_start_unix')} AS window_start_unix, {TARGET},
       1 AS eeg_available, 1 AS wearable_available,
       {", ".join(f"{r(f)} AS {f}" for f in EEG_FEATURES)}, {_WEARABLE_COLUMNS}
FROM paired"""

QUERIES = {
    "pulse_guard": (pulse_guard, PULSE_GUARD),
    "sample_rate": (sample_rate, SAMPLE_RATE),
    "blocked_sample_rate": (blocked_sample_rate, SAMPLE_RATE),
    "pulse_center": (pulse_center, PULSE_CENTER),
    "pulse_peaks": (peaks, PEAKS),
    "long_signal_peaks": (long_signal_peaks, PEAKS),
    "beat_intervals": (intervals, INTERVALS),
    "pulse_rate_and_rmssd": (rates, RATES),
    "bvp_variability": (variability, VARIABILITY),
    "signal_pulse_features": (signal_features, SIGNAL_FEATURES),
    "long_signal_pulse_features": (long_signal_features, SIGNAL_FEATURES),
    "wearable_features": (wearable_features, WEARABLE_FEATURES_SQL),
    "paired_feature_table": (paired_features, PAIRED_FEATURES),
    "cohort_paired_table": (cohort_paired_features, PAIRED_FEATURES),
    "paired_audit": (paired_audit, AUDIT),
}
