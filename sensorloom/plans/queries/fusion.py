"""Softmax weights, fusion fit, fused probabilities, missing-modality scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.fusion import (
    SCENARIOS,
    FittedFusion,
    LateFusion,
    fit_fusion,
    missing_modality_scenarios,
    softmax_columns,
)
from sensorloom.plans.fixtures import table
from sensorloom.plans.queries.common import r, rounded
from sensorloom.plans.queries.heads import entropy_sql
from sensorloom.schema import TARGET

KEYS = ("l_orderkey", "l_linenumber", "l_partkey")
WEIGHTED = LateFusion(("eeg", "wearable"), (0.3, 0.7), 0.5)
RATE, EPOCHS = 2.0, 5


def two_modalities(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with two probabilities; neither is ever missing."""
    return table(spark, folder, "lineitem").select(
        *KEYS,
        (F.col("l_quantity") / 51.0).alias("alpha_eeg"),
        (F.col("l_discount") * 5.0 + 0.2).alias("beta_wearable"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias(TARGET),
    )


MODALITIES_CTE = f"""rows AS (
  SELECT {", ".join(KEYS)}, l_quantity / 51.0 AS alpha_eeg, l_discount * 5.0 + 0.2 AS beta_wearable,
         nullif(l_tax, 0) AS tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS {TARGET}
  FROM lineitem)"""


def softmax_weights(spark: SparkSession, folder: str) -> DataFrame:
    first, second = softmax_columns(["l_quantity", "l_discount"])
    return rounded(
        table(spark, folder, "lineitem").select(*KEYS, first.alias("first"), second.alias("second"))
    )


SOFTMAX_WEIGHTS = f"""
SELECT {", ".join(KEYS)},
       {r('1.0 / (1.0 + exp(l_discount - l_quantity))')} AS first,
       {r('exp(l_discount - l_quantity) / (1.0 + exp(l_discount - l_quantity))')} AS second
FROM lineitem"""


def _fitted(spark: SparkSession, folder: str) -> FittedFusion:
    return fit_fusion(
        two_modalities(spark, folder),
        ["alpha_eeg", "beta_wearable"],
        learning_rate=RATE,
        epochs=EPOCHS,
    )


def fitted_fusion(spark: SparkSession, folder: str) -> DataFrame:
    fusion = _fitted(spark, folder).fusion
    return rounded(
        spark.createDataFrame(list(zip(fusion.modalities, fusion.weights, strict=True)), "modality string, weight double")
    )


def fusion_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_fitted(spark, folder).curve(spark))


_W1 = "exp(s.z1 - greatest(s.z1, s.z2)) / (exp(s.z1 - greatest(s.z1, s.z2)) + exp(s.z2 - greatest(s.z1, s.z2)))"
_FUSION_CTES = f"""{MODALITIES_CTE},
fit AS (
  SELECT CAST(0 AS BIGINT) AS epoch, CAST(0 AS DOUBLE) AS z1, CAST(0 AS DOUBLE) AS z2
  UNION ALL
  SELECT epoch + 1, z1 - {RATE} * sum(slope * w1 * (alpha_eeg - fused)) / count(*),
         z2 - {RATE} * sum(slope * (1 - w1) * (beta_wearable - fused)) / count(*)
  FROM (SELECT *, (q - {TARGET}) / (q * (1.0 - q)) AS slope
        FROM (SELECT *, least(greatest(fused, 1e-7), 1.0 - 1e-7) AS q
              FROM (SELECT *, w1 * alpha_eeg + (1 - w1) * beta_wearable AS fused
                    FROM (SELECT s.*, {_W1} AS w1, rows.* FROM fit s, rows WHERE s.epoch < {EPOCHS}))))
  GROUP BY epoch, z1, z2),
losses AS (
  SELECT epoch, w1, avg({entropy_sql(TARGET, 'w1 * alpha_eeg + (1 - w1) * beta_wearable')}) AS loss
  FROM (SELECT s.epoch, {_W1} AS w1, rows.* FROM fit s, rows) GROUP BY epoch, w1),
best AS (SELECT * FROM losses ORDER BY loss, epoch LIMIT 1)"""
FITTED_FUSION = f"""
WITH RECURSIVE {_FUSION_CTES}
SELECT 'eeg' AS modality, {r('w1')} AS weight FROM best
UNION ALL SELECT 'wearable', {r('1 - w1')} FROM best"""
FUSION_CURVE = f"""
WITH RECURSIVE {_FUSION_CTES}
SELECT CAST(epoch AS INTEGER) AS epoch, {r('loss')} AS validation_loss, {r('w1')} AS weight_eeg,
       {r('1 - w1')} AS weight_wearable FROM losses"""


def mix_ctes(source: str, a: str, b: str, rate: float, epochs: int) -> str:
    """CTEs ``mix`` (every epoch), ``mixed`` (epoch, first weight, loss) and ``mixed_best`` over two columns of ``source``."""
    return f"""held AS MATERIALIZED (SELECT {a} AS a, {b} AS b, {TARGET} FROM {source}),
mix AS (
  SELECT CAST(0 AS BIGINT) AS epoch, CAST(0 AS DOUBLE) AS z1, CAST(0 AS DOUBLE) AS z2
  UNION ALL
  SELECT epoch + 1, z1 - {rate} * sum(slope * w1 * (a - fused)) / count(*),
         z2 - {rate} * sum(slope * (1 - w1) * (b - fused)) / count(*)
  FROM (SELECT *, (q - {TARGET}) / (q * (1.0 - q)) AS slope
        FROM (SELECT *, least(greatest(fused, 1e-7), 1.0 - 1e-7) AS q
              FROM (SELECT *, w1 * a + (1 - w1) * b AS fused
                    FROM (SELECT s.*, {_W1} AS w1, held.* FROM mix s, held WHERE s.epoch < {epochs}))))
  GROUP BY epoch, z1, z2),
mixed AS (
  SELECT epoch, w1, avg({entropy_sql(TARGET, 'w1 * a + (1 - w1) * b')}) AS loss
  FROM (SELECT s.epoch, {_W1} AS w1, held.* FROM mix s, held) GROUP BY epoch, w1),
mixed_best AS (SELECT * FROM mixed ORDER BY loss, epoch LIMIT 1)"""


def fused_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Availability follows from the values: the discount head lacks lines without tax."""
    rows = two_modalities(spark, folder).withColumn(
        "beta_wearable", F.when(F.col("tax").isNotNull(), F.col("beta_wearable"))
    )
    return rounded(
        rows.select(*KEYS, WEIGHTED.fuse(["alpha_eeg", "beta_wearable"]).alias("combined_probability"))
    )


FUSED_ROWS = f"""
WITH {MODALITIES_CTE}
SELECT {", ".join(KEYS)}, {r('CASE WHEN tax IS NULL THEN alpha_eeg ELSE 0.3 * alpha_eeg + 0.7 * beta_wearable END')}
         AS combined_probability
FROM rows"""


def fused_with_mask(spark: SparkSession, folder: str) -> DataFrame:
    """An explicit mask: what is declared available but unknown makes the result unknown."""
    rows = two_modalities(spark, folder)
    available = [F.col("alpha_eeg") > 0.5, F.col("beta_wearable") > 0.3]
    fused = WEIGHTED.fuse(["alpha_eeg", "tax"], available)
    return rounded(rows.select(*KEYS, fused.alias("combined_probability")))


FUSED_WITH_MASK = f"""
WITH {MODALITIES_CTE}
SELECT {", ".join(KEYS)}, {r('''CASE
         WHEN alpha_eeg > 0.5 AND beta_wearable > 0.3 THEN 0.3 * alpha_eeg + 0.7 * tax
         WHEN alpha_eeg > 0.5 THEN alpha_eeg WHEN beta_wearable > 0.3 THEN tax ELSE 0.5 END''')}
         AS combined_probability
FROM rows"""


def missing_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(missing_modality_scenarios(two_modalities(spark, folder), WEIGHTED, keep=[*KEYS, TARGET]))


MISSING_SCENARIOS = f"""
WITH {MODALITIES_CTE},
scenarios(scenario) AS (VALUES {", ".join(f"('{name}')" for name in SCENARIOS)})
SELECT {", ".join(KEYS)}, {TARGET}, scenario, {r('''CASE scenario
         WHEN 'both_available' THEN 0.3 * alpha_eeg + 0.7 * beta_wearable
         WHEN 'eeg_missing' THEN beta_wearable WHEN 'wearable_missing' THEN alpha_eeg ELSE 0.5 END''')}
         AS combined_probability
FROM rows, scenarios"""

QUERIES = {
    "softmax_weights": (softmax_weights, SOFTMAX_WEIGHTS),
    "fitted_fusion": (fitted_fusion, FITTED_FUSION),
    "fusion_curve": (fusion_curve, FUSION_CURVE),
    "fused_rows": (fused_rows, FUSED_ROWS),
    "fused_with_mask": (fused_with_mask, FUSED_WITH_MASK),
    "missing_modality_scenarios": (missing_scenarios, MISSING_SCENARIOS),
}
