"""Standardizer, logistic heads, checkpoints, scores, contributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import binary_cross_entropy_term, sigmoid
from sensorloom.operators.explain import head_contributions
from sensorloom.operators.heads import (
    FittedHeads,
    LogisticHead,
    Standardizer,
    fit_heads,
    fit_standardizer,
    score_heads,
)
from sensorloom.operators.split import attach_split
from sensorloom.plans.fixtures import table
from sensorloom.plans.queries.common import r, rounded
from sensorloom.plans.queries.subjects import SPLIT_CTE, membership
from sensorloom.schema import TARGET
from sensorloom.sources.scratch import materialize

# Two heads over order lines: is the line returned? The tax is unknown where it is zero.
HEADS = {"amount": ("l_quantity", "l_extendedprice"), "terms": ("l_discount", "tax")}
FEATURES = tuple(f for names in HEADS.values() for f in names)
LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey")
RATE, EPOCHS, L2 = 0.5, 4, 0.01


def lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        *LINE_KEYS,
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias(TARGET),
    )
    members = membership(spark, folder)  # of the same rows, so every row has one
    return materialize(attach_split(rows, members, subject="l_orderkey", strict=False), "lines")


def fitted(rows: DataFrame) -> FittedHeads:
    return fit_heads(rows, HEADS, learning_rate=RATE, epochs=EPOCHS, l2=L2)


LINES_CTES = f"""{SPLIT_CTE},
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount,
         nullif(l_tax, 0) AS tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS {TARGET}, split
  FROM lineitem JOIN membership USING (l_orderkey))"""


def standard_ctes(source: str, features: tuple[str, ...]) -> str:
    """CTEs ``medians``, ``moments``, ``scales`` of the train rows of ``source``, and ``standard``: its rows with ``<feature>_z``."""
    medians = ", ".join(f"coalesce(median({f}), 0) AS {f}_median" for f in features)
    moments = ", ".join(
        f"avg(coalesce({f}, {f}_median)) AS {f}_mean, stddev_pop(coalesce({f}, {f}_median)) AS {f}_sd" for f in features
    )
    scales = ", ".join(f"CASE WHEN {f}_sd < 1e-8 THEN 1.0 ELSE {f}_sd END AS {f}_scale" for f in features)
    z = ", ".join(f"(coalesce({f}, {f}_median) - {f}_mean) / {f}_scale AS {f}_z" for f in features)
    return f"""medians AS (SELECT {medians} FROM {source} WHERE split = 'train'),
moments AS (SELECT {moments} FROM {source}, medians WHERE split = 'train'),
scales AS (SELECT *, {scales} FROM moments),
standard AS MATERIALIZED (SELECT {source}.*, {z} FROM {source}, medians, scales)"""


STANDARD_CTES = f"{LINES_CTES},\n{standard_ctes('lines', FEATURES)}"


def sigmoid_sql(logit: str) -> str:
    return f"1.0 / (1.0 + exp(-least(greatest({logit}, -30.0), 30.0)))"


def entropy_sql(y: str, p: str, epsilon: str = "1e-7") -> str:
    q = f"least(greatest({p}, {epsilon}), 1.0 - {epsilon})"
    return f"-({y} * ln({q}) + (1.0 - {y}) * ln(1.0 - {q}))"


def head_ctes(
    name: str, features: tuple[str, ...], rate: float = RATE, epochs: int = EPOCHS, l2: float = L2
) -> str:
    """CTEs ``<name>_fit`` (every epoch's weights), ``<name>_losses`` and ``<name>_best`` over ``standard``."""
    weights = [f"w{i}" for i in range(len(features))]
    logit = " + ".join(f"s.{w} * z.{f}_z" for w, f in zip(weights, features, strict=True))
    p = sigmoid_sql(f"s.b + {logit}")
    state = ", ".join(weights)
    steps = ", ".join(
        f"{w} - {rate} * (sum(error * {f}_z) / count(*) + {l2} * {w})"
        for w, f in zip(weights, features, strict=True)
    )
    penalty = " + ".join(f"{w} * {w}" for w in weights)
    loss = entropy_sql(f"z.{TARGET}", p)
    return f"""{name}_fit AS (
  SELECT CAST(0 AS BIGINT) AS epoch, {", ".join(f"CAST(0 AS DOUBLE) AS {w}" for w in weights)}, CAST(0 AS DOUBLE) AS b
  UNION ALL
  SELECT epoch + 1, {steps}, b - {rate} * avg(error)
  FROM (SELECT s.*, {", ".join(f"z.{f}_z" for f in features)}, {p} - z.{TARGET} AS error
        FROM {name}_fit s, standard z WHERE z.split = 'train' AND s.epoch < {epochs})
  GROUP BY epoch, {state}, b),
{name}_losses AS (
  SELECT epoch, {state}, b,
         avg(CASE WHEN split = 'train' THEN loss END) + 0.5 * {l2} * ({penalty}) AS train_loss,
         avg(CASE WHEN split = 'validation' THEN loss END) AS validation_loss
  FROM (SELECT s.*, z.split, {loss} AS loss FROM {name}_fit s, standard z WHERE z.split <> 'test')
  GROUP BY epoch, {state}, b),
{name}_best AS (SELECT * FROM {name}_losses ORDER BY validation_loss, epoch LIMIT 1)"""


FIT_CTES = STANDARD_CTES + ",\n" + ",\n".join(head_ctes(n, fs) for n, fs in HEADS.items())


def head_terms(name: str, features: tuple[str, ...]) -> str:
    return " + ".join(f"{name}_best.w{i} * {f}_z" for i, f in enumerate(features))


SCORED_CTES = f"""{FIT_CTES},
scored AS (
  SELECT standard.*, {", ".join(f"{sigmoid_sql(f'{n}_best.b + {head_terms(n, fs)}')} AS p_{n}" for n, fs in HEADS.items())}
  FROM standard, {", ".join(f"{n}_best" for n in HEADS)})"""


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).where(F.col("split") == "train")


def standardizer(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fit_standardizer(_train(spark, folder), FEATURES).table(spark))


def bracketed_standardizer(spark: SparkSession, folder: str) -> DataFrame:
    """The same values where the medians come from bracketing passes, as on large tables."""
    return rounded(fit_standardizer(_train(spark, folder), FEATURES, small_rows=500).table(spark))


STANDARDIZER = f"WITH {STANDARD_CTES}\n" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, {r(f'{f}_median')} AS median, {r(f'{f}_mean')} AS mean, "
    f"{r(f'{f}_scale')} AS scale FROM medians, scales"
    for f in FEATURES
)


def standardized_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    fitted_on_train = fit_standardizer(rows.where(F.col("split") == "train"), FEATURES)
    z = fitted_on_train.transform(rows)
    return rounded(z.select(*LINE_KEYS, *(f"{f}_standardized" for f in FEATURES)))


STANDARDIZED_ROWS = f"""WITH {STANDARD_CTES}
SELECT {", ".join(LINE_KEYS)}, {", ".join(f"{r(f'{f}_z')} AS {f}_standardized" for f in FEATURES)}
FROM standard"""


def sigmoid_values(spark: SparkSession, folder: str) -> DataFrame:
    logit = (F.col("l_extendedprice") - 50_000.0) / 1_000.0
    return rounded(
        table(spark, folder, "lineitem").select(*LINE_KEYS, sigmoid(logit).alias("probability"))
    )


SIGMOID_VALUES = f"""
SELECT {", ".join(LINE_KEYS)}, {r(sigmoid_sql('(l_extendedprice - 50000.0) / 1000.0'))} AS probability
FROM lineitem"""


def cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Training loss of the discount as a probability, which reaches the clipping bound."""
    target = (F.col("l_returnflag") == "R").cast("double")
    return rounded(
        table(spark, folder, "lineitem")
        .groupBy("l_linestatus")
        .agg(F.avg(binary_cross_entropy_term(target, F.col("l_discount") * 10.0)).alias("loss"))
    )


_RETURNED = "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END"
CROSS_ENTROPY = f"""
SELECT l_linestatus, {r(f"avg({entropy_sql(_RETURNED, 'l_discount * 10.0')})")} AS loss
FROM lineitem GROUP BY l_linestatus"""


def fitted_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the best checkpoint of both heads, fitted together."""
    result = fitted(lines(spark, folder))
    rows = [
        (name, feature, weight, head.bias)
        for name, head in result.heads.items()
        for feature, weight in zip(head.features, head.weights, strict=True)
    ]
    return rounded(spark.createDataFrame(rows, "head string, feature string, weight double, bias double"))


FITTED_HEADS = f"WITH RECURSIVE {FIT_CTES}\n" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS head, '{f}' AS feature, {r(f'w{i}')} AS weight, {r('b')} AS bias FROM {n}_best"
    for n, fs in HEADS.items()
    for i, f in enumerate(fs)
)


def head_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    heads = fitted(lines(spark, folder)).heads.values()
    rows = [(h.name, h.best_epoch, h.best_validation_loss) for h in heads]
    return rounded(spark.createDataFrame(rows, "head string, best_epoch int, best_validation_loss double"))


HEAD_CHECKPOINTS = f"WITH RECURSIVE {FIT_CTES}\n" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS head, CAST(epoch AS INTEGER) AS best_epoch, "
    f"{r('validation_loss')} AS best_validation_loss FROM {n}_best"
    for n in HEADS
)


def training_curve(spark: SparkSession, folder: str) -> DataFrame:
    result = fitted(lines(spark, folder))
    parts = [result.curve(spark, name).withColumn("head", F.lit(name)) for name in HEADS]
    return rounded(reduce(DataFrame.unionByName, parts))


TRAINING_CURVE = f"WITH RECURSIVE {FIT_CTES}\n" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS head, CAST(epoch AS INTEGER) AS epoch, {r('train_loss')} AS train_loss, "
    f"{r('validation_loss')} AS validation_loss FROM {n}_losses"
    for n in HEADS
)


def scored(rows: DataFrame) -> tuple[DataFrame, FittedHeads]:
    result = fitted(rows)
    return score_heads(rows, {f"p_{n}": head for n, head in result.heads.items()}), result


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = scored(lines(spark, folder))
    return rounded(rows.select(*LINE_KEYS, "split", *(f"p_{n}" for n in HEADS)))


SCORED_LINES = f"""WITH RECURSIVE {SCORED_CTES}
SELECT {", ".join(LINE_KEYS)}, split, {", ".join(f"{r(f'p_{n}')} AS p_{n}" for n in HEADS)} FROM scored"""

# A fixed head, for the operators that only use one.
FIXED_HEAD = LogisticHead(
    "fixed",
    Standardizer(
        ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
        (25.0, 50_000.0, 0.05, 0.04),
        (25.0, 50_000.0, 0.05, 0.04),
        (15.0, 28_000.0, 0.03, 0.025),
    ),
    (0.75, -0.5, 0.25, 0.0),
    0.1,
    0,
    0.0,
)


def top_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """The two largest contributions of every line, in order."""
    ranked = table(spark, folder, "lineitem").select(
        *LINE_KEYS, F.posexplode(head_contributions(FIXED_HEAD, 2)).alias("place", "entry")
    )
    return rounded(ranked.select(*LINE_KEYS, "place", "entry.feature", "entry.contribution"))


_FIXED_TERMS = {
    f: f"({f} - {FIXED_HEAD.standardizer.means[at]}) / {FIXED_HEAD.standardizer.scales[at]} * {FIXED_HEAD.weights[at]}"
    for at, f in enumerate(FIXED_HEAD.features)
}
TOP_CONTRIBUTIONS = f"""
WITH numbered_lines AS (SELECT *, row_number() OVER () AS line FROM lineitem),
terms AS ({" UNION ALL ".join(
    f"SELECT {', '.join(LINE_KEYS)}, line, {at} AS nth, '{f}' AS feature, {e} AS contribution FROM numbered_lines"
    for at, (f, e) in enumerate(_FIXED_TERMS.items()))}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY abs(contribution) DESC, nth) - 1 AS place FROM terms)
SELECT {", ".join(LINE_KEYS)}, CAST(place AS INTEGER) AS place, feature, {r('contribution')} AS contribution
FROM ranked WHERE place < 2"""


def linear_contributions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        table(spark, folder, "lineitem").select(
            *LINE_KEYS, *(FIXED_HEAD.contribution(f).alias(f"c_{f}") for f in FIXED_HEAD.features)
        )
    )


LINEAR_CONTRIBUTIONS = f"""
SELECT {", ".join(LINE_KEYS)}, {", ".join(f"{r(e)} AS c_{f}" for f, e in _FIXED_TERMS.items())} FROM lineitem"""


def ranked_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    head = fit_heads(
        lines(spark, folder), {"all": FEATURES}, learning_rate=RATE, epochs=1, l2=L2
    ).heads["all"]
    return rounded(head.coefficient_table(spark))


_ONE_STEP = {
    f: f"-{RATE} * (SELECT sum((0.5 - {TARGET}) * {f}_z) / count(*) FROM standard WHERE split = 'train')"
    for f in FEATURES
}
# After one epoch the better checkpoint is the lower validation loss of zero and one step.
_STEP_LOGIT = " + ".join(f"(SELECT w_{f} FROM step) * {f}_z" for f in FEATURES)
RANKED_COEFFICIENTS = f"""
WITH {STANDARD_CTES},
step AS (SELECT {", ".join(f"{e} AS w_{f}" for f, e in _ONE_STEP.items())},
                -{RATE} * (SELECT avg(0.5 - {TARGET}) FROM standard WHERE split = 'train') AS b),
better AS (
  SELECT avg({entropy_sql(TARGET, sigmoid_sql(f'(SELECT b FROM step) + {_STEP_LOGIT}'))}) < -ln(0.5) AS moved
  FROM standard WHERE split = 'validation'),
weights AS ({" UNION ALL ".join(
    f"SELECT '{f}' AS feature, {at} AS nth, CASE WHEN moved THEN w_{f} ELSE 0.0 END AS w FROM step, better"
    for at, f in enumerate(FEATURES))})
SELECT feature, {r('w')} AS standardized_coefficient, {r('abs(w)')} AS absolute_coefficient
FROM weights ORDER BY abs(w) DESC, nth"""

QUERIES = {
    "standardizer": (standardizer, STANDARDIZER),
    "bracketed_standardizer": (bracketed_standardizer, STANDARDIZER),
    "standardized_rows": (standardized_rows, STANDARDIZED_ROWS),
    "sigmoid": (sigmoid_values, SIGMOID_VALUES),
    "cross_entropy": (cross_entropy, CROSS_ENTROPY),
    "fitted_heads": (fitted_heads, FITTED_HEADS),
    "head_checkpoints": (head_checkpoints, HEAD_CHECKPOINTS),
    "training_curve": (training_curve, TRAINING_CURVE),
    "scored_lines": (scored_lines, SCORED_LINES),
    "top_contributions": (top_contributions, TOP_CONTRIBUTIONS),
    "linear_contributions": (linear_contributions, LINEAR_CONTRIBUTIONS),
    "ranked_coefficients": (ranked_coefficients, RANKED_COEFFICIENTS),
}
