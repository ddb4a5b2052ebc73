"""The whole study: features, split, heads, fusion, evaluation, explanations, saved tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.evaluate import METRICS, ablation, base_rate, two_level_metrics
from sensorloom.operators.explain import LIMITATIONS, explanations, with_sentence
from sensorloom.operators.fusion import FittedFusion, fit_fusion, missing_modality_scenarios
from sensorloom.operators.heads import FittedHeads, fit_heads, score_heads
from sensorloom.operators.split import attach_split, require_subjects, split_subjects
from sensorloom.plans.paired import require_windows
from sensorloom.schema import EEG_FEATURES, WEARABLE_FEATURES
from sensorloom.sources.scratch import materialize
from sensorloom.sources.tables import write_csv, write_json

# Names of the models in the ablation, in report order.
MODELS = {
    "EEG only (alpha)": "alpha_eeg",
    "wearable only (beta)": "beta_wearable",
    "learned late fusion": "combined_probability",
}
# End of fixed values.


@dataclass(frozen=True)
class StudySettings:
    seed: int = 42
    train_fraction: float = 0.64
    validation_fraction: float = 0.18
    head_learning_rate: float = 0.05
    head_epochs: int = 2000
    head_l2: float = 0.01
    fusion_learning_rate: float = 0.10
    fusion_epochs: int = 1000
    eeg_features: Sequence[str] = EEG_FEATURES
    wearable_features: Sequence[str] = WEARABLE_FEATURES
    scope_warning: str = "Predicts the recorded condition, not clinical disease."
    limitations: Sequence[str] = field(default=LIMITATIONS)


@dataclass(frozen=True)
class StudyResult:
    membership: DataFrame
    heads: FittedHeads
    fusion: FittedFusion
    test: DataFrame
    scenarios: DataFrame
    ablation: DataFrame
    metrics: DataFrame
    explanations: DataFrame
    settings: StudySettings


def run_study(
    paired: DataFrame, settings: StudySettings = StudySettings(), membership: DataFrame | None = None
) -> StudyResult:
    """Fit and evaluate on a paired feature table.

    ``membership`` may give an explicit subject split; otherwise the seeded one is used. Fusion
    weights come from validation rows only and the fallback is the training base rate.
    """
    require_windows(paired)
    given = membership is not None
    if not given:
        require_subjects(paired)
        membership = materialize(
            split_subjects(
                paired,
                seed=settings.seed,
                train_fraction=settings.train_fraction,
                validation_fraction=settings.validation_fraction,
            ),
            "membership",
        )
    rows = materialize(attach_split(paired, membership, strict=given), "split-rows")
    heads = fit_heads(
        rows,
        {"eeg": settings.eeg_features, "wearable": settings.wearable_features},
        learning_rate=settings.head_learning_rate,
        epochs=settings.head_epochs,
        l2=settings.head_l2,
    )
    scored = score_heads(
        rows, {"alpha_eeg": heads.heads["eeg"], "beta_wearable": heads.heads["wearable"]}
    )
    fallback = base_rate(rows.where(F.col("split") == "train")).first()["base_rate"]
    fusion = fit_fusion(
        scored.where(F.col("split") == "validation"),
        ["alpha_eeg", "beta_wearable"],
        learning_rate=settings.fusion_learning_rate,
        epochs=settings.fusion_epochs,
        fallback=fallback,
    )
    test = scored.where(F.col("split") == "test").withColumn(
        "combined_probability", fusion.fusion.fuse(["alpha_eeg", "beta_wearable"])
    )
    scenarios = missing_modality_scenarios(test, fusion.fusion)
    return StudyResult(
        membership,
        heads,
        fusion,
        test,
        scenarios,
        ablation(test, scenarios, MODELS),
        two_level_metrics(
            test,
            {"eeg": "alpha_eeg", "wearable": "beta_wearable", "late_fusion": "combined_probability"},
        ),
        with_sentence(
            explanations(
                test,
                heads.heads["eeg"],
                heads.heads["wearable"],
                fusion.fusion,
                limitations=settings.limitations,
            )
        ),
        settings,
    )


def metrics_document(
    metrics: DataFrame,
    membership: DataFrame,
    heads: FittedHeads,
    fusion: FittedFusion,
    scope_warning: str,
) -> DataFrame:
    """The report as rows ``section, name, value, text``, the same sections at every size.

    ``metrics`` (model.level.measure), ``fusion_weights``, ``selected_checkpoints`` (head.epoch, head.validation_loss),
    ``split_sizes`` and ``scope_warning`` are a few rows. ``split_subjects`` has a row for each subject, with the split as
    name and the id as text; it comes from the membership table and never passes the driver.
    """
    spark = metrics.sparkSession
    schema = "section string, name string, value double, text string"
    weights = fusion.fusion
    few = [
        ("fusion_weights", name, float(weight), None)
        for name, weight in zip(weights.modalities, weights.weights, strict=True)
    ]
    for name, head in heads.heads.items():
        few.append(("selected_checkpoints", f"{name}.epoch", float(head.best_epoch), None))
        few.append(("selected_checkpoints", f"{name}.validation_loss", float(head.best_validation_loss), None))
    few.append(("scope_warning", "scope_warning", None, scope_warning))
    no_text, no_value = F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("value")
    measures = F.explode(F.create_map(*(part for m in METRICS for part in (F.lit(m), F.col(m)))))
    scores = metrics.select("model", "level", measures.alias("measure", "value")).select(
        F.lit("metrics").alias("section"), F.concat_ws(".", "model", "level", "measure").alias("name"), "value", no_text
    )
    sizes = membership.groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("split_sizes").alias("section"), F.col("split").alias("name"), "value", no_text
    )
    subjects = membership.select(
        F.lit("split_subjects").alias("section"),
        F.col("split").alias("name"),
        no_value,
        F.col(membership.columns[0]).cast("string").alias("text"),
    )
    rows = scores.unionByName(spark.createDataFrame(few, schema)).unionByName(sizes).unionByName(subjects)
    return rows.select("section", "name", "value", "text")


def save_study(
    spark: SparkSession,
    result: StudyResult,
    path: str,
    paired: DataFrame | None = None,
    audit: DataFrame | None = None,
) -> None:
    """Write every result table below ``path``: tables as CSV, nested ones as JSON.

    ``paired`` and ``audit``, if given, are the feature table and the session audit that the study came from.
    """
    tables = {
        **({"paired_windows": paired} if paired is not None else {}),
        **({"raw_session_audit": audit} if audit is not None else {}),
        "patient_split": result.membership,
        "eeg_training_curve": result.heads.curve(spark, "eeg"),
        "wearable_training_curve": result.heads.curve(spark, "wearable"),
        "fusion_training_curve": result.fusion.curve(spark),
        "eeg_coefficients": result.heads.heads["eeg"].coefficient_table(spark),
        "wearable_coefficients": result.heads.heads["wearable"].coefficient_table(spark),
        "test_window_predictions": result.test,
        "missing_modality_predictions": result.scenarios,
        "ablation": result.ablation,
    }
    for name, table in tables.items():
        write_csv(table, f"{path}/{name}")
    document = metrics_document(
        result.metrics, result.membership, result.heads, result.fusion, result.settings.scope_warning
    )
    write_json(document, f"{path}/metrics")
    write_json(result.explanations, f"{path}/explanations")

