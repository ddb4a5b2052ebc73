"""Subject-level train, validation and test membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import half_even_count
from sensorloom.operators.joins import sized_join
from sensorloom.schema import TARGET
from sensorloom.sources.scratch import materialize

SPLITS = ("train", "validation", "test")
# Fewest subjects that can be split; leading hex digits of the hash used as blocks.
MINIMUM_SUBJECTS = 5
HASH_DIGITS = 3


def distinct_subjects(df: DataFrame, subject: str = "patient_id") -> DataFrame:
    return df.select(subject).distinct()


def share_of_test(train_fraction: float, validation_fraction: float) -> float:
    """What the two given shares leave for the test subjects; every split has to get a part of them."""
    shares = dict(zip(SPLITS, (train_fraction, validation_fraction, 1.0 - train_fraction - validation_fraction)))
    empty = [name for name, share in shares.items() if not share > 0]
    if empty:
        raise ValueError(f"The split leaves no subjects for {' and '.join(empty)}: shares are {shares}.")
    return shares["test"]


def split_subjects(
    df: DataFrame,
    *,
    seed: int = 42,
    train_fraction: float = 0.64,
    validation_fraction: float = 0.18,
    subject: str = "patient_id",
) -> DataFrame:
    """Seeded membership, one row per distinct subject.

    Subjects are ordered by SHA-256 of seed and id, so the split does not depend on partitioning
    or retries. The order is ranked in blocks of equal hash prefix plus the counts of earlier
    prefixes; hashes are uniform, so the blocks are even and nothing is sorted in one task.
    """
    share_of_test(train_fraction, validation_fraction)
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(subject).cast("string")), 256)
    hashed = (
        distinct_subjects(df, subject)
        .withColumn("_hash", digest)
        .withColumn("_prefix", F.substring("_hash", 1, HASH_DIGITS))
    )
    hashed = materialize(hashed, "subjects")  # read twice; the rows behind it can be many
    by_prefix = Window.orderBy("_prefix")  # at most 16 ** HASH_DIGITS rows
    counts = hashed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_count"))
    offsets = counts.select(
        "_prefix",
        F.coalesce(
            F.sum("_count").over(by_prefix.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_count").over(Window.partitionBy()).alias("_total"),
    )
    ranked = hashed.join(F.broadcast(offsets), "_prefix").withColumn(
        "_rank",
        F.col("_before")
        + F.row_number().over(Window.partitionBy("_prefix").orderBy("_hash", subject)),
    )
    wanted_train = half_even_count("_total", train_fraction)
    validation = half_even_count("_total", validation_fraction)
    train = F.when(
        wanted_train + validation >= F.col("_total"), F.col("_total") - validation - 1
    ).otherwise(wanted_train)
    return ranked.select(
        subject,
        F.when(F.col("_rank") <= train, "train")
        .when(F.col("_rank") <= train + validation, "validation")
        .otherwise("test")
        .alias("split"),
    )


def require_subjects(df: DataFrame, subject: str = "patient_id") -> None:
    if distinct_subjects(df, subject).limit(MINIMUM_SUBJECTS).count() < MINIMUM_SUBJECTS:
        raise ValueError(f"A split needs at least {MINIMUM_SUBJECTS} subjects.")


def overlapping_subjects(membership: DataFrame, subject: str = "patient_id") -> DataFrame:
    """Subjects found in more than one split; empty for a valid membership."""
    return (
        membership.groupBy(subject)
        .agg(F.count_distinct("split").alias("splits"))
        .where(F.col("splits") > 1)
    )


def attach_split(
    df: DataFrame, membership: DataFrame, *, subject: str = "patient_id", strict: bool = True, **join_options
) -> DataFrame:
    """Add ``split`` to every row; with ``strict`` a subject without membership fails the job that reads the result."""
    members = membership.select(subject, "split")
    spread = [c for c in df.columns if c != subject]
    joined = sized_join(df, members, [subject], "left", spread_by=spread or [subject], **join_options)
    if not strict:
        return joined
    unknown = F.raise_error(F.concat(F.lit("The membership lists no split for subject "), F.col(subject).cast("string")))
    return joined.withColumn("split", F.coalesce(F.col("split"), unknown.cast("string")))


def split_label_counts(df: DataFrame, labels: tuple[int, ...] = (0, 1), target: str = TARGET) -> DataFrame:
    """Rows by split and label, one ``label_<n>`` column each, 0 where there are none."""
    return df.groupBy("split").agg(
        *(F.count(F.when(F.col(target) == label, 1)).alias(f"label_{label}") for label in labels)
    )
