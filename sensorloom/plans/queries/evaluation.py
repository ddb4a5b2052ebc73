"""Metrics, ablation, session predictions, explanations, and the whole study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import predicted_class
from sensorloom.operators.evaluate import (
    ablation,
    base_rate,
    classification_metrics,
    session_predictions,
    two_level_metrics,
)
from sensorloom.operators.explain import explanation_sentence, explanations, with_sentence
from sensorloom.operators.fusion import fit_fusion, missing_modality_scenarios
from sensorloom.operators.heads import score_heads
from sensorloom.operators.split import SPLITS
from sensorloom.plans.fixtures import table
from sensorloom.plans.queries.common import r, rounded
from sensorloom.plans.queries.fusion import WEIGHTED, mix_ctes
from sensorloom.plans.queries.heads import (
    FIXED_HEAD,
    HEADS,
    SCORED_CTES,
    entropy_sql,
    fitted,
    lines,
)
from sensorloom.plans.queries.subjects import membership
from sensorloom.plans.study import MODELS, metrics_document
from sensorloom.schema import SESSION_KEYS, TARGET

# Fixed value: double-precision epsilon, the clipping of the reported log loss.
EPSILON = "2.220446049250313e-16"


def tested_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as scored test windows: a supplier and line status are a session."""
    price = (F.col("l_extendedprice") - 50_000.0) / 20_000.0
    scored = table(spark, folder, "lineitem").select(
        F.format_string("p_%04d", "l_suppkey").alias("patient_id"),
        F.when(F.col("l_linestatus") == "O", "cognitive_load").otherwise("baseline").alias("condition"),
        (F.col("l_linestatus") == "O").cast("int").alias(TARGET),
        F.col("l_orderkey").alias("window_index"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_quantity") / 51.0).alias("alpha_eeg"),
        (1.0 / (1.0 + F.exp(-price))).alias("beta_wearable"),
    )
    return scored.withColumn("combined_probability", WEIGHTED.fuse(["alpha_eeg", "beta_wearable"]))


TESTED_CTES = f"""unfused AS (
  SELECT printf('p_%04d', l_suppkey) AS patient_id,
         CASE WHEN l_linestatus = 'O' THEN 'cognitive_load' ELSE 'baseline' END AS condition,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS {TARGET}, l_orderkey AS window_index,
         l_quantity, l_extendedprice, l_discount, l_tax, l_quantity / 51.0 AS alpha_eeg,
         1.0 / (1.0 + exp(-((l_extendedprice - 50000.0) / 20000.0))) AS beta_wearable
  FROM lineitem),
tested AS (SELECT *, (alpha_eeg * 0.3 + beta_wearable * 0.7) / (0.3 + 0.7) AS combined_probability FROM unfused)"""


def metrics_sql(source: str, groups: str, score: str = "probability") -> str:
    """CTE ``metrics`` with all four measures per group of ``source``."""
    return f"""scores AS (
  SELECT {groups}, {score} AS score, sum({TARGET}) AS pos, sum(1 - {TARGET}) AS neg
  FROM {source} GROUP BY ALL),
ranked_scores AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {groups} ORDER BY score
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM scores),
areas AS (
  SELECT {groups}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
           THEN sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auroc
  FROM ranked_scores GROUP BY ALL),
points AS (
  SELECT {groups}, avg({entropy_sql(TARGET, score, EPSILON)}) AS log_loss,
         avg(CASE WHEN ({score} >= 0.5) = ({TARGET} = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
         avg(CASE WHEN {TARGET} = 1 THEN CASE WHEN {score} >= 0.5 THEN 1.0 ELSE 0.0 END END) AS recall_1,
         avg(CASE WHEN {TARGET} = 0 THEN CASE WHEN {score} < 0.5 THEN 1.0 ELSE 0.0 END END) AS recall_0
  FROM {source} GROUP BY ALL),
metrics AS (
  SELECT {groups}, auroc, log_loss, accuracy,
         CASE WHEN recall_1 IS NULL THEN recall_0 WHEN recall_0 IS NULL THEN recall_1
              ELSE (recall_0 + recall_1) / 2 END AS balanced_accuracy
  FROM areas JOIN points USING ({groups}))"""


METRIC_COLUMNS = ", ".join(
    f"{r(m)} AS {m}" for m in ("auroc", "log_loss", "accuracy", "balanced_accuracy")
)


def class_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return tested_lines(spark, folder).select(
        "patient_id", "window_index", "l_extendedprice", predicted_class("alpha_eeg").alias("decision")
    )


CLASS_DECISIONS = f"""
WITH {TESTED_CTES} SELECT patient_id, window_index, l_extendedprice,
  CASE WHEN alpha_eeg >= 0.5 THEN 1 ELSE 0 END AS decision FROM tested"""


def _one(metric: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """One measure per condition-independent group: the supplier."""
        scored = tested_lines(spark, folder)
        return rounded(
            classification_metrics(scored, ["patient_id"], probability="beta_wearable", metrics=[metric])
        )

    return query


def _one_sql(metric: str) -> str:
    return f"""
WITH {TESTED_CTES}, {metrics_sql('tested', 'patient_id', 'beta_wearable')}
SELECT patient_id, {r(metric)} AS {metric} FROM metrics"""


def metrics_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """All four measures over the whole table, one group per priority of rounding: the tax."""
    scored = tested_lines(spark, folder)
    return rounded(classification_metrics(scored, ["l_tax"], probability="beta_wearable"))


def blocked_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The same measures where groups above a thousand scores are ranked in blocks."""
    scored = tested_lines(spark, folder)
    return rounded(
        classification_metrics(scored, ["l_tax"], probability="beta_wearable", block_rows=1_000)
    )


METRICS_BUNDLE = f"""
WITH {TESTED_CTES}, {metrics_sql('tested', 'l_tax', 'beta_wearable')}
SELECT {r('l_tax')} AS l_tax, {METRIC_COLUMNS} FROM metrics"""


def session_means(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(session_predictions(tested_lines(spark, folder), "combined_probability"))


SESSION_MEANS = f"""
WITH {TESTED_CTES}
SELECT patient_id, condition, {TARGET}, {r('avg(combined_probability)')} AS probability, count(*) AS windows
FROM tested GROUP BY ALL"""


def training_base_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(base_rate(lines(spark, folder).where(F.col("split") == "train")))


TRAINING_BASE_RATE = f"""
WITH RECURSIVE {SCORED_CTES}
SELECT {r(f'avg({TARGET})')} AS base_rate FROM lines WHERE split = 'train'"""

LEVEL_MODELS = {"eeg": "alpha_eeg", "wearable": "beta_wearable", "late_fusion": "combined_probability"}


def metrics_by_level(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(two_level_metrics(tested_lines(spark, folder), LEVEL_MODELS))


METRICS_BY_LEVEL = f"""
WITH {TESTED_CTES},
by_model AS ({" UNION ALL ".join(
    f"SELECT '{m}' AS model, patient_id, condition, {TARGET}, {c} AS probability FROM tested"
    for m, c in LEVEL_MODELS.items())}),
both_levels AS (
  SELECT model, 'window' AS level, {TARGET}, probability FROM by_model
  UNION ALL
  SELECT model, 'session', {TARGET}, probability FROM (
    SELECT model, patient_id, condition, {TARGET}, avg(probability) AS probability FROM by_model GROUP BY ALL)),
{metrics_sql('both_levels', 'model, level')}
SELECT model, level, {METRIC_COLUMNS} FROM metrics"""


def ablation_rows(spark: SparkSession, folder: str) -> DataFrame:
    tested = tested_lines(spark, folder)
    return rounded(ablation(tested, missing_modality_scenarios(tested, WEIGHTED), MODELS))


ABLATION_ROWS = f"""
WITH {TESTED_CTES},
parts AS (
  {" UNION ALL ".join(
    f"SELECT '{m}' AS model_or_scenario, patient_id, condition, {TARGET}, {c} AS probability FROM tested"
    for m, c in MODELS.items())}
  {" ".join(
    f"UNION ALL SELECT 'missingness: {s}', patient_id, condition, {TARGET}, {e} FROM tested"
    for s, e in (
        ("both_available", "combined_probability"),
        ("eeg_missing", "beta_wearable * 0.7 / 0.7"),
        ("wearable_missing", "alpha_eeg * 0.3 / 0.3"),
        ("both_missing", "0.5"),
    ))}),
sessions AS (
  SELECT model_or_scenario, patient_id, condition, {TARGET}, avg(probability) AS probability
  FROM parts GROUP BY ALL),
{metrics_sql('sessions', 'model_or_scenario')}
SELECT model_or_scenario, {METRIC_COLUMNS} FROM metrics"""


def report_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the test report."""
    columns = ["window_index", TARGET, "alpha_eeg", "beta_wearable", "combined_probability"]
    return rounded(tested_lines(spark, folder).select(*SESSION_KEYS, *columns))


REPORT_PROJECTION = f"""
WITH {TESTED_CTES}
SELECT patient_id, condition, window_index, {TARGET}, {r('alpha_eeg')} AS alpha_eeg,
       {r('beta_wearable')} AS beta_wearable, {r('combined_probability')} AS combined_probability FROM tested"""


def fused_test_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Heads fitted on train rows, scored on test rows, fused with fixed weights."""
    rows = lines(spark, folder)
    heads = fitted(rows).heads
    test = score_heads(rows.where(F.col("split") == "test"), {f"p_{n}": h for n, h in heads.items()})
    fused = test.withColumn("combined_probability", WEIGHTED.fuse([f"p_{n}" for n in HEADS]))
    return rounded(fused.select("l_orderkey", "l_linenumber", "l_partkey", "combined_probability"))


_FIRST, _SECOND = HEADS
FUSED_TEST_ROWS = f"""
WITH RECURSIVE {SCORED_CTES}
SELECT l_orderkey, l_linenumber, l_partkey, {r(f'0.3 * p_{_FIRST} + 0.7 * p_{_SECOND}')} AS combined_probability
FROM scored WHERE split = 'test'"""


DOCUMENT_EPOCHS, DOCUMENT_RATE = 25, 0.5
DOCUMENT_WARNING = "A pipeline check on order lines."


def study_document(spark: SparkSession, folder: str) -> DataFrame:
    """Heads, fusion, two-level metrics and splits of the order lines as report rows."""
    rows = lines(spark, folder)
    heads = fitted(rows)
    scored = score_heads(rows, {f"p_{n}": h for n, h in heads.heads.items()})
    fusion = fit_fusion(
        scored.where(F.col("split") == "validation"),
        [f"p_{n}" for n in HEADS],
        modalities=tuple(HEADS),
        learning_rate=DOCUMENT_RATE,
        epochs=DOCUMENT_EPOCHS,
    )
    test = scored.where(F.col("split") == "test").withColumn(
        "combined_probability", fusion.fusion.fuse([f"p_{n}" for n in HEADS])
    )
    metrics = two_level_metrics(test, DOCUMENT_MODELS, keys=["l_orderkey"])
    return rounded(metrics_document(metrics, membership(spark, folder), heads, fusion, DOCUMENT_WARNING))


DOCUMENT_MODELS = {**{n: f"p_{n}" for n in HEADS}, "late_fusion": "combined_probability"}
_ONE, _TWO = (f"p_{n}" for n in HEADS)
STUDY_DOCUMENT = f"""
WITH RECURSIVE {SCORED_CTES},
{mix_ctes("(SELECT * FROM scored WHERE split = 'validation')", _ONE, _TWO, DOCUMENT_RATE, DOCUMENT_EPOCHS)},
fused AS (
  SELECT l_orderkey, {TARGET}, {_ONE}, {_TWO}, w1 * {_ONE} + (1 - w1) * {_TWO} AS combined_probability
  FROM scored, mixed_best WHERE split = 'test'),
by_model AS ({" UNION ALL ".join(
    f"SELECT '{m}' AS model, l_orderkey, {TARGET}, {c} AS probability FROM fused" for m, c in DOCUMENT_MODELS.items())}),
both_levels AS (
  SELECT model, 'window' AS level, {TARGET}, probability FROM by_model
  UNION ALL
  SELECT model, 'session', {TARGET}, probability FROM (
    SELECT model, l_orderkey, {TARGET}, avg(probability) AS probability FROM by_model GROUP BY ALL)),
{metrics_sql('both_levels', 'model, level')}
{" UNION ALL ".join(
    f"SELECT 'metrics' AS section, model || '.' || level || '.{m}' AS name, {r(m)} AS value, CAST(NULL AS VARCHAR) AS text FROM metrics"
    for m in ("auroc", "log_loss", "accuracy", "balanced_accuracy"))}
UNION ALL SELECT 'fusion_weights', '{list(HEADS)[0]}', {r('w1')}, NULL FROM mixed_best
UNION ALL SELECT 'fusion_weights', '{list(HEADS)[1]}', {r('1 - w1')}, NULL FROM mixed_best
{" ".join(
    f"UNION ALL SELECT 'selected_checkpoints', '{n}.epoch', {r('epoch')}, NULL FROM {n}_best "
    f"UNION ALL SELECT 'selected_checkpoints', '{n}.validation_loss', {r('validation_loss')}, NULL FROM {n}_best"
    for n in HEADS)}
UNION ALL SELECT 'split_sizes', split, {r('count(*)')}, NULL FROM membership GROUP BY split
UNION ALL SELECT 'split_subjects', split, NULL, CAST(l_orderkey AS VARCHAR) FROM membership
UNION ALL SELECT 'scope_warning', 'scope_warning', NULL, '{DOCUMENT_WARNING}'"""


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each split, for every split."""
    return lines(spark, folder).where(F.col("split").isin(*SPLITS)).groupBy("split").count()


SPLIT_SIZES = f"""WITH RECURSIVE {SCORED_CTES} SELECT split, count(*) AS count FROM lines GROUP BY split"""


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    return explanations(
        tested_lines(spark, folder), FIXED_HEAD, FIXED_HEAD, WEIGHTED, top_k=2, keep=["window_index", "l_extendedprice"]
    )


def explanation_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The scalar part of every payload, and the sum of the two contributions it shows."""
    shown = F.map_values("eeg_linear_contributions")
    return rounded(
        _payloads(spark, folder).select(
            *SESSION_KEYS,
            "window_index",
            "l_extendedprice",
            "prediction_target",
            "alpha_eeg",
            "beta_wearable",
            "combined_probability",
            F.col("fusion_weights")["eeg"].alias("weight_eeg"),
            F.col("fusion_weights")["wearable"].alias("weight_wearable"),
            F.size("limitations").alias("limitations"),
            (shown[0] + shown[1]).alias("shown_contributions"),
        )
    )


_TERMS = [
    f"({f} - {FIXED_HEAD.standardizer.means[i]}) / {FIXED_HEAD.standardizer.scales[i]} * {FIXED_HEAD.weights[i]}"
    for i, f in enumerate(FIXED_HEAD.features)
]
_SORTED = "list_sort([" + ", ".join(
    f"{{'rank': -abs({t}), 'nth': {i}, 'value': {t}}}" for i, t in enumerate(_TERMS)
) + "])"
EXPLANATION_PAYLOADS = f"""
WITH {TESTED_CTES}, sorted AS (SELECT *, {_SORTED} AS terms FROM tested)
SELECT patient_id, condition, window_index, {r('l_extendedprice')} AS l_extendedprice,
       'cognitive_load_during_this_recorded_session' AS prediction_target,
       {r('alpha_eeg')} AS alpha_eeg, {r('beta_wearable')} AS beta_wearable,
       {r('combined_probability')} AS combined_probability, {r('CAST(0.3 AS DOUBLE)')} AS weight_eeg,
       {r('CAST(0.7 AS DOUBLE)')} AS weight_wearable, 1 AS limitations,
       {r('terms[1].value + terms[2].value')} AS shown_contributions
FROM sorted"""


def explanation_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """The two contributions that every payload shows, as rows of the map."""
    shown = F.explode("eeg_linear_contributions").alias("feature", "value")
    return rounded(_payloads(spark, folder).select(*SESSION_KEYS, "window_index", "l_extendedprice", shown))


_NAMED = "list_sort([" + ", ".join(
    f"{{'rank': -abs({t}), 'nth': {i}, 'value': {t}, 'feature': '{f}'}}"
    for i, (t, f) in enumerate(zip(_TERMS, FIXED_HEAD.features, strict=True))
) + "])"
EXPLANATION_CONTRIBUTIONS = f"""
WITH {TESTED_CTES}, named AS (SELECT *, unnest({_NAMED}[1:2]) AS term FROM tested)
SELECT patient_id, condition, window_index, {r('l_extendedprice')} AS l_extendedprice, term.feature AS feature,
       {r('term.value')} AS value
FROM named"""


def explanation_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence of every tested row."""
    sentence = explanation_sentence(F.lit(0.3), F.lit(0.7))
    return tested_lines(spark, folder).select(*SESSION_KEYS, "window_index", sentence.alias("explanation"))


EXPLANATION_SENTENCES = f"""
WITH {TESTED_CTES}
SELECT patient_id, condition, window_index,
       printf('Participant %s / %s: EEG alpha=%.3f, wearable beta=%.3f, combined cognitive-load probability=%.3f. Learned fusion weights were EEG=0.300 and wearable=0.700. Interpret only as a small-cohort research result, not a diagnosis.',
              patient_id, condition, alpha_eeg, beta_wearable, combined_probability) AS explanation
FROM tested"""


def full_explanations(spark: SparkSession, folder: str) -> DataFrame:
    """Every payload with its sentence, as JSON."""
    payloads = with_sentence(_payloads(spark, folder))
    return payloads.select("patient_id", F.to_json(F.struct("*")).alias("payload"))


def parsed_explanations(spark: SparkSession, folder: str) -> DataFrame:
    """Every JSON payload read back: its scalars and both maps of contributions as rows."""
    payloads = with_sentence(_payloads(spark, folder))
    read = payloads.select(F.from_json(F.to_json(F.struct("*")), payloads.schema).alias("p")).select("p.*")

    def entries(head: str) -> Column:
        named = F.map_entries(f"{head}_linear_contributions")
        return F.transform(
            named, lambda e: F.struct(F.lit(head).alias("head"), e["key"].alias("feature"), e["value"].alias("value"))
        )

    scalars = [*SESSION_KEYS, "window_index", "l_extendedprice", "alpha_eeg", "beta_wearable", "combined_probability"]
    rows = read.select(*scalars, F.col("fusion_weights")["wearable"].alias("weight_wearable"), F.explode(F.concat(entries("eeg"), entries("wearable"))).alias("c"))
    return rounded(rows.select(*scalars, "weight_wearable", "c.head", "c.feature", "c.value"))


PARSED_EXPLANATIONS = f"""
WITH {TESTED_CTES}, named AS (SELECT *, unnest({_NAMED}[1:2]) AS term FROM tested)
SELECT patient_id, condition, window_index, {r('l_extendedprice')} AS l_extendedprice, {r('alpha_eeg')} AS alpha_eeg,
       {r('beta_wearable')} AS beta_wearable, {r('combined_probability')} AS combined_probability,
       {r('CAST(0.7 AS DOUBLE)')} AS weight_wearable, head, term.feature AS feature, {r('term.value')} AS value
FROM named, (VALUES ('eeg'), ('wearable')) AS heads(head)"""


QUERIES = {
    "class_decisions": (class_decisions, CLASS_DECISIONS),
    "auroc": (_one("auroc"), _one_sql("auroc")),
    "log_loss": (_one("log_loss"), _one_sql("log_loss")),
    "accuracy": (_one("accuracy"), _one_sql("accuracy")),
    "balanced_accuracy": (_one("balanced_accuracy"), _one_sql("balanced_accuracy")),
    "metrics_bundle": (metrics_bundle, METRICS_BUNDLE),
    "blocked_metrics": (blocked_metrics, METRICS_BUNDLE),
    "session_predictions": (session_means, SESSION_MEANS),
    "base_rate": (training_base_rate, TRAINING_BASE_RATE),
    "metrics_by_level": (metrics_by_level, METRICS_BY_LEVEL),
    "ablation": (ablation_rows, ABLATION_ROWS),
    "report_projection": (report_projection, REPORT_PROJECTION),
    "fused_test_rows": (fused_test_rows, FUSED_TEST_ROWS),
    "metrics_document": (study_document, STUDY_DOCUMENT),
    "split_sizes": (split_sizes, SPLIT_SIZES),
    "explanation_payloads": (explanation_payloads, EXPLANATION_PAYLOADS),
    "explanation_contributions": (explanation_contributions, EXPLANATION_CONTRIBUTIONS),
    "explanation_sentences": (explanation_sentences, EXPLANATION_SENTENCES),
    "full_explanations": (full_explanations, None),
    "parsed_explanations": (parsed_explanations, PARSED_EXPLANATIONS),
}

