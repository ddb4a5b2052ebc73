"""Logistic heads with train-only standardization and validation checkpoints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import sigmoid
from sensorloom.functions.scalar import LOGIT_BOUND, LOSS_EPSILON
from sensorloom.operators.blocks import pack_blocks, release_blocks, sum_over_blocks
from sensorloom.operators.descent import Step, descend
from sensorloom.operators.ordering import SMALL_ROWS, column_medians
from sensorloom.schema import TARGET

# Fixed value: a spread below this counts as constant and is replaced by one.
SMALLEST_SCALE = 1e-8
CURVE_SCHEMA = "epoch int, train_loss double, validation_loss double"


@dataclass(frozen=True)
class Standardizer:
    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def column(self, feature: str) -> Column:
        """``(x or median - mean) / scale``."""
        at = self.features.index(feature)
        filled = F.coalesce(F.col(feature).cast("double"), F.lit(self.medians[at]))
        return (filled - F.lit(self.means[at])) / F.lit(self.scales[at])

    def transform(self, df: DataFrame, suffix: str = "_standardized") -> DataFrame:
        return df.select("*", *(self.column(f).alias(f"{f}{suffix}") for f in self.features))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(zip(self.features, self.medians, self.means, self.scales, strict=True)),
            "feature string, median double, mean double, scale double",
        )


def fit_standardizer(
    train: DataFrame, features: Sequence[str], *, small_rows: int = SMALL_ROWS
) -> Standardizer:
    """Medians of the known values, then mean and population spread of the filled columns."""
    medians = {
        feature: median if median is not None and np.isfinite(median) else 0.0
        for feature, median in column_medians(train, features, small_rows=small_rows).items()
    }
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(medians[f])) for f in features}
    row = train.agg(
        *(F.avg(column).alias(f"m{i}") for i, column in enumerate(filled.values())),
        *(F.stddev_pop(column).alias(f"s{i}") for i, column in enumerate(filled.values())),
    ).first()
    if row["m0"] is None:
        raise ValueError("A standardizer needs at least one training row.")
    scales = (row[f"s{i}"] for i in range(len(features)))
    return Standardizer(
        tuple(features),
        tuple(medians[f] for f in features),
        tuple(row[f"m{i}"] for i in range(len(features))),
        tuple(1.0 if scale < SMALLEST_SCALE else scale for scale in scales),
    )


@dataclass(frozen=True)
class LogisticHead:
    name: str
    standardizer: Standardizer
    weights: tuple[float, ...]
    bias: float
    best_epoch: int
    best_validation_loss: float

    @property
    def features(self) -> tuple[str, ...]:
        return self.standardizer.features

    def contribution(self, feature: str) -> Column:
        """Standardized value times weight."""
        return self.standardizer.column(feature) * F.lit(self.weights[self.features.index(feature)])

    def probability(self) -> Column:
        logit = reduce(add, [self.contribution(f) for f in self.features]) + F.lit(self.bias)
        return sigmoid(logit)

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        """Coefficients ranked by magnitude; equal magnitudes keep feature order."""
        rows = [(f, w, abs(w), at) for at, (f, w) in enumerate(zip(self.features, self.weights, strict=True))]
        table = spark.createDataFrame(
            rows,
            "feature string, standardized_coefficient double, absolute_coefficient double, at int",
        )
        return table.orderBy(F.desc("absolute_coefficient"), "at").drop("at")


@dataclass(frozen=True)
class FittedHeads:
    heads: dict[str, LogisticHead]
    curves: dict[str, list[tuple[int, float, float]]]

    def curve(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.createDataFrame(self.curves[name], CURVE_SCHEMA)


def score_heads(df: DataFrame, columns: Mapping[str, LogisticHead]) -> DataFrame:
    """Add one probability column per head."""
    return df.withColumns({name: head.probability() for name, head in columns.items()})


def fit_heads(
    df: DataFrame,
    heads: Mapping[str, Sequence[str]],
    *,
    target: str = TARGET,
    split: str = "split",
    learning_rate: float = 0.05,
    epochs: int = 2000,
    l2: float = 0.01,
    small_rows: int = SMALL_ROWS,
) -> FittedHeads:
    """Fit all heads together by full-batch gradient descent from zero.

    Every epoch is one distributed pass that returns, for each head, the gradient and both losses
    at the current weights; the weights with the lowest validation loss (the earliest on ties)
    are kept. The bias is not penalized and the validation loss carries no penalty.
    """
    train = df.where(F.col(split) == "train")
    features = list(dict.fromkeys(f for names in heads.values() for f in names))
    shared = fit_standardizer(train, features, small_rows=small_rows)
    standardizers = {
        name: Standardizer(
            tuple(names),
            *(
                tuple(getattr(shared, part)[features.index(f)] for f in names)
                for part in ("medians", "means", "scales")
            ),
        )
        for name, names in heads.items()
    }
    width = len(features)
    columns = [f"x{i}" for i in range(width)]
    numeric = df.where(F.col(split).isin("train", "validation")).select(
        *(shared.column(f).alias(c) for f, c in zip(features, columns, strict=True)),
        F.col(target).alias("y"),
        (F.col(split) == "train").cast("double").alias("is_train"),
    )
    blocks = pack_blocks(numeric, [*columns, "y", "is_train"])
    inputs = {name: [features.index(f) for f in names] for name, names in heads.items()}
    sizes = [len(chosen) + 3 for chosen in inputs.values()]

    def measure(states: list[np.ndarray]) -> list[Step]:
        """``states`` are weights with the bias last."""

        def of_block(matrix: np.ndarray) -> np.ndarray:
            truth, in_train = matrix[:, width], matrix[:, width + 1] > 0
            sums = [np.array([in_train.sum(), (~in_train).sum()], dtype=float)]
            for chosen, state in zip(inputs.values(), states, strict=True):
                x = matrix[:, chosen]
                logit = (x @ state[:-1] + state[-1]).clip(-LOGIT_BOUND, LOGIT_BOUND)
                p = 1.0 / (1.0 + np.exp(-logit))
                held = p.clip(LOSS_EPSILON, 1.0 - LOSS_EPSILON)
                loss = -np.log(np.where(truth > 0, held, 1.0 - held))
                error = (p - truth) * in_train
                sums.append(np.array([*(error @ x), error.sum(), loss[in_train].sum(), loss[~in_train].sum()]))
            return np.concatenate(sums)

        totals = sum_over_blocks(blocks, width + 2, 2 + sum(sizes), of_block)
        train_rows, validation_rows = totals[:2]
        steps = []
        for part, state in zip(np.split(totals[2:], np.cumsum(sizes)[:-1]), states, strict=True):
            weights = np.append(state[:-1], 0.0)  # the bias is free of the penalty
            train_loss = part[-2] / train_rows + l2 / 2 * (weights @ weights)
            held_out = part[-1] / validation_rows if validation_rows else float("nan")
            steps.append(Step(part[:-2] / train_rows + l2 * weights, held_out, (train_loss, held_out)))
        return steps

    try:
        traces = descend([np.zeros(n - 2) for n in sizes], measure, rate=learning_rate, epochs=epochs)
    finally:
        release_blocks(blocks)
    runs = dict(zip(heads, traces, strict=True))

    return FittedHeads(
        {
            name: LogisticHead(
                name,
                standardizers[name],
                tuple(map(float, run.best[:-1])),
                float(run.best[-1]),
                run.best_epoch,
                run.best_loss,
            )
            for name, run in runs.items()
        },
        {name: run.curve for name, run in runs.items()},
    )
