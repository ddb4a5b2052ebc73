"""Session index, completeness check, previews and file sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import entity_id
from sensorloom.schema import TARGET
from sensorloom.sources.files import listing, local_path
from sensorloom.sources.numeric import STREAM_FILES

# Condition names and their class labels; how many missing files an error shows.
CONDITIONS = {"baseline": 0, "cognitive_load": 1}
MISSING_SHOWN = 8
# End of fixed values.


def literal_rows(rows: Sequence[Mapping[str, object]]) -> Column:
    """A short fixed list as one array column; exploding it pairs every row with every entry."""
    return F.explode(
        F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in row.items())) for row in rows))
    )


def session_grid(
    participants: DataFrame, conditions: Mapping[str, int] = CONDITIONS
) -> DataFrame:
    """Every participant under every condition, with the condition's label."""
    entries = [{"condition": name, TARGET: label} for name, label in conditions.items()]
    return participants.select("*", literal_rows(entries).alias("_condition")).select(
        *participants.columns, "_condition.*"
    )


def session_index(
    participants: DataFrame,
    root: str,
    *,
    conditions: Mapping[str, int] = CONDITIONS,
    id_prefix: str = "p_",
    id_width: int = 2,
    files: Mapping[str, str] = STREAM_FILES,
) -> DataFrame:
    """One row per participant and condition with the expected path of each stream."""
    folder = F.concat_ws("/", F.lit(root), F.col("participant_number").cast("string"), F.col("condition"))
    return session_grid(participants.select("participant_number"), conditions).select(
        entity_id("participant_number", id_prefix, id_width).alias("patient_id"),
        "participant_number",
        "condition",
        TARGET,
        *(F.concat_ws("/", folder, F.lit(name)).alias(f"{stream}_path") for stream, name in files.items()),
    )


def expected_files(index: DataFrame, streams: Sequence[str] = tuple(STREAM_FILES)) -> DataFrame:
    """Session index unpivoted to one row per stream file."""
    keys = [c for c in index.columns if not c.endswith("_path")]
    return index.unpivot(keys, [f"{s}_path" for s in streams], "stream", "path").withColumn(
        "stream", F.regexp_replace("stream", "_path$", "")
    )


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Path and size of every file below ``path``; contents are not read."""
    found = listing(spark, path, pattern, recursive=True)
    return found.select(local_path("uri").alias("path"), "bytes")


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.join(present.select("path"), "path", "left_anti")


def require_complete(expected: DataFrame, present: DataFrame) -> None:
    """Raise with the first missing paths unless every expected file exists."""
    absent = missing_files(expected, present).select("path").orderBy("path").limit(MISSING_SHOWN)
    paths = [row["path"] for row in absent.collect()]
    if paths:
        raise FileNotFoundError("Raw stream files are missing, for example:\n" + "\n".join(paths))


def stream_preview(samples: DataFrame, streams: Sequence[str], rows: int = 5) -> DataFrame:
    """Earliest rows of each stream. One bounded top-k per stream, never a sort of a whole one."""
    order = ["time", *(c for c in samples.columns if c not in ("stream", "time"))]
    return reduce(
        DataFrame.unionByName,
        [samples.where(F.col("stream") == s).orderBy(*order).limit(rows) for s in streams],
    )


def file_sizes(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.join(present, "path").select("stream", "bytes", "path")
