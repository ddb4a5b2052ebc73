"""The whole study over the events: cached features, split, heads, fusion, scenarios, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.plans.fixtures import event_labels, event_samples, wide_eeg
from sensorloom.plans.paired import cached_paired_table
from sensorloom.plans.queries.common import r, rounded
from sensorloom.plans.queries.evaluation import METRIC_COLUMNS, metrics_sql
from sensorloom.plans.queries.fusion import mix_ctes
from sensorloom.plans.queries.heads import head_ctes, head_terms, sigmoid_sql, standard_ctes
from sensorloom.plans.queries.pulse import PAIRED_CTES, SETTINGS
from sensorloom.plans.queries.subjects import split_cte
from sensorloom.plans.study import MODELS, StudyResult, StudySettings, run_study
from sensorloom.schema import EEG_FEATURES, SESSION_KEYS, TARGET, WEARABLE_FEATURES
from sensorloom.sources.files import source_fingerprint
from sensorloom.sources.scratch import session_path

# Enough epochs for a curve that shows every second and the last.
STUDY = StudySettings(head_epochs=25, head_learning_rate=0.2, fusion_epochs=25, fusion_learning_rate=0.5)
HEADS = {"eeg": EEG_FEATURES, "wearable": WEARABLE_FEATURES}
SCORES = {"eeg": "alpha_eeg", "wearable": "beta_wearable"}


_DONE: dict[tuple[str, str, str], StudyResult] = {}


def study(spark: SparkSession, folder: str) -> StudyResult:
    """The study of one state of the events, fitted once in an application."""
    inputs = [f"{folder}/events.parquet"]
    key = (spark.sparkContext.applicationId, folder, source_fingerprint(spark, inputs))
    if key not in _DONE:
        _DONE[key] = _fitted(spark, folder, inputs)
    return _DONE[key]


def _fitted(spark: SparkSession, folder: str, inputs: list[str]) -> StudyResult:
    """All steps from the events on. The feature table and its audit are built once for a state of the input files."""
    samples = event_samples(spark, folder)
    features, _ = cached_paired_table(
        session_path(spark, "study"),
        wide_eeg(samples),
        samples.select(*SESSION_KEYS, "stream", "time", "value"),
        event_labels(samples),
        SETTINGS,
        inputs=inputs,
    )
    return run_study(features, STUDY)


_FUSED = "(weight_eeg * alpha_eeg + weight_wearable * beta_wearable) / (weight_eeg + weight_wearable)"
STUDY_CTES = f"""{PAIRED_CTES},
{split_cte('paired', 'patient_id')},
study_rows AS MATERIALIZED (SELECT paired.*, split FROM paired JOIN membership USING (patient_id)),
{standard_ctes('study_rows', (*EEG_FEATURES, *WEARABLE_FEATURES))},
{", ".join(head_ctes(n, fs, STUDY.head_learning_rate, STUDY.head_epochs, STUDY.head_l2) for n, fs in HEADS.items())},
study_scored AS MATERIALIZED (
  SELECT patient_id, condition, window_index, {TARGET}, split,
         {", ".join(f"{sigmoid_sql(f'{n}_best.b + {head_terms(n, fs)}')} AS {SCORES[n]}" for n, fs in HEADS.items())}
  FROM standard, {", ".join(f"{n}_best" for n in HEADS)}),
{mix_ctes("(SELECT * FROM study_scored WHERE split = 'validation')", *SCORES.values(), STUDY.fusion_learning_rate, STUDY.fusion_epochs)},
fallback AS (SELECT avg({TARGET}) AS base_rate FROM study_rows WHERE split = 'train'),
tested AS MATERIALIZED (
  SELECT *, {_FUSED} AS combined_probability
  FROM (SELECT study_scored.*, w1 AS weight_eeg, 1 - w1 AS weight_wearable, base_rate
        FROM study_scored, mixed_best, fallback WHERE split = 'test')),
tested_scenarios AS (
  SELECT patient_id, condition, window_index, {TARGET}, scenario,
         CASE scenario WHEN 'both_available' THEN combined_probability WHEN 'eeg_missing' THEN beta_wearable
                       WHEN 'wearable_missing' THEN alpha_eeg ELSE base_rate END AS combined_probability
  FROM tested, (VALUES ('both_available'), ('eeg_missing'), ('wearable_missing'), ('both_missing')) AS s(scenario))"""


def study_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The scored windows of the test subjects."""
    columns = [*SESSION_KEYS, "window_index", TARGET, *SCORES.values(), "combined_probability"]
    return rounded(study(spark, folder).test.select(*columns))


STUDY_PREDICTIONS = f"""
WITH RECURSIVE {STUDY_CTES}
SELECT patient_id, condition, window_index, {TARGET}, {r('alpha_eeg')} AS alpha_eeg,
       {r('beta_wearable')} AS beta_wearable, {r('combined_probability')} AS combined_probability FROM tested"""


def study_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(study(spark, folder).scenarios)


STUDY_SCENARIOS = f"""
WITH RECURSIVE {STUDY_CTES}
SELECT patient_id, condition, window_index, {TARGET}, scenario, {r('combined_probability')} AS combined_probability
FROM tested_scenarios"""


def study_ablation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(study(spark, folder).ablation)


STUDY_ABLATION = f"""
WITH RECURSIVE {STUDY_CTES},
parts AS (
  {" UNION ALL ".join(
    f"SELECT '{m}' AS model_or_scenario, patient_id, condition, {TARGET}, {c} AS probability FROM tested"
    for m, c in MODELS.items())}
  UNION ALL
  SELECT 'missingness: ' || scenario, patient_id, condition, {TARGET}, combined_probability FROM tested_scenarios),
sessions AS (
  SELECT model_or_scenario, patient_id, condition, {TARGET}, avg(probability) AS probability FROM parts GROUP BY ALL),
{metrics_sql('sessions', 'model_or_scenario')}
SELECT model_or_scenario, {METRIC_COLUMNS} FROM metrics"""


def study_curves(spark: SparkSession, folder: str) -> DataFrame:
    """The training curves of both heads: every second of twenty-five epochs and the last."""
    heads = study(spark, folder).heads
    return rounded(
        reduce(DataFrame.unionByName, [heads.curve(spark, n).withColumn("head", F.lit(n)) for n in HEADS])
    )


_STRIDE = max(1, STUDY.head_epochs // 10)
STUDY_CURVES = f"WITH RECURSIVE {STUDY_CTES}\n" + "\nUNION ALL ".join(
    f"SELECT CAST(epoch AS INTEGER) AS epoch, {r('train_loss')} AS train_loss, {r('validation_loss')} AS validation_loss, "
    f"'{n}' AS head FROM {n}_losses WHERE epoch % {_STRIDE} = 0 OR epoch = {STUDY.head_epochs}"
    for n in HEADS
)

QUERIES = {
    "study_predictions": (study_predictions, STUDY_PREDICTIONS),
    "study_scenarios": (study_scenarios, STUDY_SCENARIOS),
    "study_ablation": (study_ablation, STUDY_ABLATION),
    "study_curves": (study_curves, STUDY_CURVES),
}
