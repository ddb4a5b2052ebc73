"""Lenient numeric CSV scans, one scan per stream over all sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import entity_id, lenient_double
from sensorloom.schema import EEG_CHANNELS
from sensorloom.sources.files import csv_scans, united

# File names and value columns of the raw layout
# <root>/<participant number>/<condition>/<file>.
STREAM_FILES = {
    "eeg": "muse_eeg.csv",
    "bvp": "empatica_bvp.csv",
    "eda": "empatica_eda.csv",
    "temperature": "empatica_temp.csv",
}
STREAM_VALUES = {"bvp": "bvp", "eda": "eda", "temperature": "temp"}
WORN_COLUMN = "HeadBandOn"
# End of fixed values.

SESSION_PATH = r"/([^/]+)/([^/]+)/[^/]+$"


def numeric_columns(raw: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Coerce ``columns`` to doubles and drop rows without a time. A missing column is an error."""
    missing = [column for column in columns if column not in raw.columns]
    if missing:
        raise ValueError(f"Columns not found: {', '.join(missing)}")
    return raw.select(*keep, *(lenient_double(column).alias(column) for column in columns)).where(
        F.col("time").isNotNull()
    )


def scan_numeric_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Read only the named columns of headed CSV files as doubles; each file's own header says where they are."""
    return united([numeric_columns(raw, columns, keep) for raw in csv_scans(spark, path, [*columns, *keep])])


def device_worn(df: DataFrame, flag: str = WORN_COLUMN) -> DataFrame:
    return df.where(F.coalesce(F.col(flag), F.lit(0.0)) > 0)


def _with_session(raw: DataFrame, id_prefix: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    return raw.select(
        entity_id(F.regexp_extract(path, SESSION_PATH, 1), id_prefix).alias("patient_id"),
        F.regexp_extract(path, SESSION_PATH, 2).alias("condition"),
        "*",
    )


def load_eeg(
    spark: SparkSession, root: str, *, id_prefix: str = "p_", files: Mapping[str, str] = STREAM_FILES
) -> DataFrame:
    """Worn EEG rows of all sessions: session keys, time and the twenty band-power channels."""
    columns = ["time", WORN_COLUMN, *EEG_CHANNELS]
    scans = csv_scans(spark, f"{root}/*/*/{files['eeg']}", columns)
    parts = [numeric_columns(_with_session(raw, id_prefix), columns, ["patient_id", "condition"]) for raw in scans]
    return device_worn(united(parts)).drop(WORN_COLUMN)


def load_samples(
    spark: SparkSession,
    root: str,
    *,
    id_prefix: str = "p_",
    streams: Sequence[str] = tuple(STREAM_VALUES),
    files: Mapping[str, str] = STREAM_FILES,
) -> DataFrame:
    """Long samples of the single-value streams of all sessions."""
    parts = []
    for stream in streams:
        column = STREAM_VALUES[stream]
        for raw in csv_scans(spark, f"{root}/*/*/{files[stream]}", ["time", column]):
            numeric = numeric_columns(_with_session(raw, id_prefix), ["time", column], ["patient_id", "condition"])
            parts.append(
                numeric.select(
                    "patient_id", "condition", F.lit(stream).alias("stream"), "time", F.col(column).alias("value")
                )
            )
    return united(parts)


def eeg_marks(eeg: DataFrame) -> DataFrame:
    """EEG rows as valueless samples, for extents and row counts; reads no channel."""
    return eeg.select(
        "patient_id",
        "condition",
        F.lit("eeg").alias("stream"),
        "time",
        F.lit(None).cast("double").alias("value"),
    )
