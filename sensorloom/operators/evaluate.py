"""Classification metrics per group, at window and at session level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import log_loss_term, predicted_class
from sensorloom.operators.ordering import BLOCK_ROWS, running_totals
from sensorloom.schema import SESSION_KEYS, TARGET
from sensorloom.sources.scratch import materialize

# Fixed value: what stands before a scenario's name in the ablation.
MISSING_PREFIX = "missingness: "
# End of fixed values.
METRICS = ("auroc", "log_loss", "accuracy", "balanced_accuracy")


def session_predictions(
    df: DataFrame,
    probability: str,
    *,
    keys: Sequence[str] = SESSION_KEYS,
    target: str = TARGET,
) -> DataFrame:
    """Mean probability and number of windows of each session."""
    return df.groupBy(*keys, target).agg(
        F.avg(probability).alias("probability"), F.count(F.lit(1)).alias("windows")
    )


def base_rate(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.agg(F.avg(target).alias("base_rate"))


def score_counts(
    df: DataFrame, groups: Sequence[str], *, target: str = TARGET, probability: str = "probability"
) -> DataFrame:
    """Positives and negatives per distinct score of each group, as a written table.

    All metrics follow from these counts, so the rows are read once and are combined before the
    shuffle. A row without a score fails the job: metrics of the others would not be those of the model.
    """
    positive = F.col(target).cast("long")
    missing = F.raise_error(F.lit(f"A row has no value in {probability}; metrics need a score for every row."))
    scored = F.coalesce(F.col(probability), missing.cast("double"))
    counts = (
        df.groupBy(*groups, scored.alias("score"))
        .agg(F.sum(positive).alias("positives"), F.sum(1 - positive).alias("negatives"))
    )
    return materialize(counts, "scores")


def _area() -> Column:
    wins = F.sum(F.col("positives") * (F.col("lower_negatives") + F.col("negatives") / 2.0))
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    return F.when(pairs > 0, wins / pairs)


def _rows() -> Column:
    return F.sum(F.col("positives") + F.col("negatives"))


def _log_loss() -> Column:
    loss = F.col("positives") * log_loss_term(F.lit(1.0), "score")
    return F.sum(loss + F.col("negatives") * log_loss_term(F.lit(0.0), "score")) / _rows()


def _accuracy() -> Column:
    right = F.when(predicted_class("score") == 1, F.col("positives")).otherwise(F.col("negatives"))
    return F.sum(right) / _rows()


def _balanced_accuracy() -> Column:
    """Mean recall over the classes that occur."""
    is_one = predicted_class("score") == 1
    recalls = [
        F.try_divide(F.sum(F.when(is_one, F.col("positives")).otherwise(0)), F.sum("positives")),
        F.try_divide(F.sum(F.when(is_one, 0).otherwise(F.col("negatives"))), F.sum("negatives")),
    ]
    known = sum(F.when(r.isNotNull(), 1).otherwise(0) for r in recalls)
    return sum(F.coalesce(r, F.lit(0.0)) for r in recalls) / known


def classification_metrics(
    df: DataFrame,
    groups: Sequence[str],
    *,
    target: str = TARGET,
    probability: str = "probability",
    metrics: Sequence[str] = METRICS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """AUROC, log loss, accuracy and balanced accuracy of every group.

    AUROC ranks the distinct scores with ties counting half; with one class only it is NULL.
    Large groups are ranked in blocks by :func:`running_totals`.
    """
    groups = list(groups)
    counts = score_counts(df, groups, target=target, probability=probability)
    if "auroc" in metrics:
        counts = running_totals(
            counts, groups, ["score"], {"lower_negatives": F.col("negatives")}, block_rows=block_rows
        )
    forms = {
        "auroc": _area,
        "log_loss": _log_loss,
        "accuracy": _accuracy,
        "balanced_accuracy": _balanced_accuracy,
    }
    return counts.groupBy(*groups).agg(*(forms[m]().alias(m) for m in metrics))


def models_long(
    df: DataFrame,
    models: Mapping[str, str],
    *,
    keep: Sequence[str] = (*SESSION_KEYS, TARGET),
    name: str = "model_or_scenario",
) -> DataFrame:
    """One row per table row and model: ``models`` maps a label to its probability column."""
    entries = F.array(
        *(F.struct(F.lit(label).alias(name), F.col(c).alias("probability")) for label, c in models.items())
    )
    return df.select(*keep, F.explode(entries).alias("_m")).select(*keep, "_m.*")


def two_level_metrics(
    df: DataFrame,
    models: Mapping[str, str],
    *,
    keys: Sequence[str] = SESSION_KEYS,
    target: str = TARGET,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Metrics of each model on windows and on session means, in one grouped job."""
    windows = models_long(df, models, keep=[*keys, target], name="model")
    sessions = session_predictions(windows, "probability", keys=["model", *keys], target=target)
    columns = ["model", "level", target, "probability"]
    both = (
        windows.withColumn("level", F.lit("window"))
        .select(columns)
        .unionByName(sessions.withColumn("level", F.lit("session")).select(columns))
    )
    return classification_metrics(both, ["model", "level"], target=target, block_rows=block_rows)


def ablation(
    test: DataFrame,
    scenarios: DataFrame,
    models: Mapping[str, str],
    *,
    keys: Sequence[str] = SESSION_KEYS,
    target: str = TARGET,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Session-level metrics of each model and each missing-modality scenario."""
    label = "model_or_scenario"
    parts = models_long(test, models, keep=[*keys, target]).unionByName(
        scenarios.select(
            *keys,
            target,
            F.concat(F.lit(MISSING_PREFIX), F.col("scenario")).alias(label),
            F.col("combined_probability").alias("probability"),
        )
    )
    sessions = session_predictions(parts, "probability", keys=[label, *keys], target=target)
    return classification_metrics(sessions, [label], target=target, block_rows=block_rows)
