"""Per-row explanations that restate model values and nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.fusion import LateFusion
from sensorloom.operators.heads import LogisticHead

# What is predicted, and the sentence's wording.
PREDICTION_TARGET = "cognitive_load_during_this_recorded_session"
SENTENCE = (
    "Participant %s / %s: EEG alpha=%.3f, wearable beta=%.3f, "
    "combined cognitive-load probability=%.3f. "
    "Learned fusion weights were EEG=%.3f and wearable=%.3f. "
    "Interpret only as a small-cohort research result, not a diagnosis."
)
LIMITATIONS = ("Research output, not a diagnosis or clinical recommendation.",)
# End of fixed values.


def top_contributions(values: Sequence[tuple[str, Column]], top_k: int = 4) -> Column:
    """The ``top_k`` largest contributions by magnitude: structs with ``feature``, ``contribution``.

    Sorted inside the row by generated code, so there is no shuffle and no lambda; equal
    magnitudes keep feature order and NULL contributions come last.
    """
    entries = F.array(
        *(
            F.struct(
                F.coalesce(-F.abs(value), F.lit(1.0)).alias("rank"),
                F.lit(at).alias("at"),
                F.lit(feature).alias("feature"),
                value.alias("contribution"),
            )
            for at, (feature, value) in enumerate(values)
        )
    )
    return F.slice(F.sort_array(entries), 1, top_k)


def head_contributions(head: LogisticHead, top_k: int = 4) -> Column:
    return top_contributions([(f, head.contribution(f)) for f in head.features], top_k)


def contribution_map(head: LogisticHead, top_k: int = 4) -> Column:
    best = head_contributions(head, top_k)
    return F.map_from_arrays(best["feature"], best["contribution"])


def explanations(
    df: DataFrame,
    eeg_head: LogisticHead,
    wearable_head: LogisticHead,
    fusion: LateFusion,
    *,
    top_k: int = 4,
    limitations: Sequence[str] = LIMITATIONS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One payload per row: ids, probabilities, fusion weights, top contributions, limitations."""
    weights = F.create_map(
        *(F.lit(part) for pair in zip(fusion.modalities, fusion.weights, strict=True) for part in pair)
    )
    return df.select(
        *keep,
        F.col("patient_id").cast("string").alias("patient_id"),
        F.col("condition").cast("string").alias("condition"),
        F.lit(PREDICTION_TARGET).alias("prediction_target"),
        "alpha_eeg",
        "beta_wearable",
        "combined_probability",
        weights.alias("fusion_weights"),
        contribution_map(eeg_head, top_k).alias("eeg_linear_contributions"),
        contribution_map(wearable_head, top_k).alias("wearable_linear_contributions"),
        F.array(*(F.lit(text) for text in limitations)).alias("limitations"),
    )


def explanation_sentence(eeg_weight: str | Column, wearable_weight: str | Column) -> Column:
    """The fixed sentence with three decimals per number."""
    weights = [F.col(w) if isinstance(w, str) else w for w in (eeg_weight, wearable_weight)]
    return F.format_string(
        SENTENCE, "patient_id", "condition", "alpha_eeg", "beta_wearable", "combined_probability", *weights
    )


def with_sentence(payloads: DataFrame) -> DataFrame:
    weights = [F.col("fusion_weights")[name] for name in ("eeg", "wearable")]
    return payloads.withColumn("explanation", explanation_sentence(*weights))
