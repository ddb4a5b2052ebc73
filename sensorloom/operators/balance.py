"""Equal numbers of windows from both conditions of each subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.schema import SESSION_KEYS

RANK_BLOCK = 4096


def used_window_counts(windows: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    return windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows_used_after_balancing"))


def condition_counts(
    windows: DataFrame, subject: str = "patient_id", condition: str = "condition"
) -> DataFrame:
    """Per subject: number of observed conditions and the smallest window count among them."""
    per_condition = windows.groupBy(subject, condition).agg(F.count(F.lit(1)).alias("windows"))
    return per_condition.groupBy(subject).agg(
        F.count(F.lit(1)).alias("conditions"), F.min("windows").alias("windows_per_condition")
    )


def balance_conditions(
    windows: DataFrame,
    *,
    subject: str = "patient_id",
    condition: str = "condition",
    index: str = "window_index",
    conditions: int = 2,
    block: int = RANK_BLOCK,
) -> DataFrame:
    """First ``m`` windows by index of each condition, ``m`` being the subject's smaller count.

    Subjects without exactly ``conditions`` conditions are dropped. A window index is unique in
    its session, so ranking runs in blocks of ``block`` indexes plus the counts of earlier blocks:
    no task sorts more than ``block`` windows, however long a session is.
    """
    session = [subject, condition]
    blocked = windows.withColumn("_block", F.floor(F.col(index) / block))
    counts = blocked.groupBy(*session, "_block").agg(F.count(F.lit(1)).alias("_windows"))
    earlier = Window.partitionBy(*session).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    of_session = Window.partitionBy(*session)
    offsets = counts.select(
        *session,
        "_block",
        F.coalesce(F.sum("_windows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_windows").over(of_session).alias("_session_windows"),
    )
    limits = (
        offsets.groupBy(subject)
        .agg(
            F.min("_session_windows").alias("_keep"),
            F.count_distinct(condition).alias("_conditions"),
        )
        .where(F.col("_conditions") == conditions)
    )
    allowed = offsets.join(limits.select(subject, "_keep"), subject).select(
        *session, "_block", (F.col("_keep") - F.col("_before")).alias("_room")
    )
    rank = F.row_number().over(Window.partitionBy(*session, "_block").orderBy(index))
    return (
        blocked.join(allowed.where(F.col("_room") > 0), [*session, "_block"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= F.col("_room"))
        .drop("_block", "_room", "_rank")
    )
