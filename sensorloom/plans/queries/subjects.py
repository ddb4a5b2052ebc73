"""Subject membership: seeded split, checks, lookup, crosstab."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.ordering import with_position
from sensorloom.operators.split import (
    attach_split,
    distinct_subjects,
    overlapping_subjects,
    split_label_counts,
    split_subjects,
)
from sensorloom.plans.fixtures import table
from sensorloom.schema import TARGET
from sensorloom.sources.scratch import materialize


def split_cte(source: str, subject: str) -> str:
    return f"""ranked_subjects AS (
  SELECT {subject}, total,
         row_number() OVER (ORDER BY sha256(concat('42:', {subject})), {subject}) AS place,
         greatest(1, CAST(round_even(total * 0.64, 0) AS BIGINT)) AS wanted,
         greatest(1, CAST(round_even(total * 0.18, 0) AS BIGINT)) AS v
  FROM (SELECT DISTINCT {subject} FROM {source}), (SELECT count(DISTINCT {subject}) AS total FROM {source})),
membership AS (
  SELECT {subject}, CASE WHEN place <= t THEN 'train' WHEN place <= t + v THEN 'validation' ELSE 'test' END
         AS split
  FROM (SELECT *, CASE WHEN wanted + v >= total THEN total - v - 1 ELSE wanted END AS t FROM ranked_subjects))"""


SPLIT_CTE = split_cte("lineitem", "l_orderkey")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_returnflag") == "R").cast("int").alias(TARGET),
    )


def membership(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys are the subjects; their lines follow them."""
    return materialize(split_subjects(_labelled(spark, folder), subject="l_orderkey"), "membership")


def split_membership(spark: SparkSession, folder: str) -> DataFrame:
    """The membership table with each subject's place in its canonical order."""
    return with_position(membership(spark, folder), ["split", "l_orderkey"])


SPLIT_MEMBERSHIP = f"""
WITH {SPLIT_CTE} SELECT *, row_number() OVER (ORDER BY split, l_orderkey) AS position FROM membership"""


def _attached(spark: SparkSession, folder: str) -> DataFrame:
    return attach_split(_labelled(spark, folder), membership(spark, folder), subject="l_orderkey")


def split_disjointness(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects per number of splits their rows fall in; and those in more than one: none."""
    rows = _attached(spark, folder).select("l_orderkey", "split")
    return overlapping_subjects(rows, "l_orderkey").agg(F.count(F.lit(1)).alias("overlapping"))


SPLIT_DISJOINTNESS = f"""
WITH {SPLIT_CTE}
SELECT count(*) AS overlapping FROM (
  SELECT l_orderkey FROM lineitem JOIN membership USING (l_orderkey)
  GROUP BY 1 HAVING count(DISTINCT split) > 1)"""


def attached_split(spark: SparkSession, folder: str) -> DataFrame:
    return _attached(spark, folder)


def salted_attached_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same lookup with the salted join that long memberships get."""
    return attach_split(
        _labelled(spark, folder),
        membership(spark, folder),
        subject="l_orderkey",
        broadcast_rows=0,
        hot_rows=5,
    )


ATTACHED_SPLIT = f"""
WITH {SPLIT_CTE}
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS {TARGET}, split
FROM lineitem JOIN membership USING (l_orderkey)"""


def split_label_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    return split_label_counts(_attached(spark, folder))


SPLIT_LABEL_CROSSTAB = f"""
WITH {SPLIT_CTE}
SELECT split, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS label_0,
       count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS label_1
FROM lineitem JOIN membership USING (l_orderkey) GROUP BY split"""


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_subjects(table(spark, folder, "orders"), "o_custkey").orderBy("o_custkey")


SUBJECTS = "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey"


def validation_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _attached(spark, folder).where(F.col("split") == "validation")


VALIDATION_ROWS = f"{ATTACHED_SPLIT} WHERE split = 'validation'"

QUERIES = {
    "split_membership": (split_membership, SPLIT_MEMBERSHIP),
    "split_disjointness": (split_disjointness, SPLIT_DISJOINTNESS),
    "attached_split": (attached_split, ATTACHED_SPLIT),
    "salted_attached_split": (salted_attached_split, ATTACHED_SPLIT),
    "split_label_crosstab": (split_label_crosstab, SPLIT_LABEL_CROSSTAB),
    "distinct_subjects": (subjects, SUBJECTS),
    "validation_rows": (validation_rows, VALIDATION_ROWS),
}
