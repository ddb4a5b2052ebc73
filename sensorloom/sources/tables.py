"""Feature-table cache and result sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from sensorloom.sources.files import source_fingerprint


def cached_table(
    spark: SparkSession,
    root: str,
    name: str,
    parameters: Mapping[str, object],
    build: Callable[[], DataFrame],
    *,
    inputs: Sequence[str] = (),
    rebuild: bool = False,
) -> DataFrame:
    """Build a table once per set of parameters and state of its inputs, and read it back afterwards.

    The parameters are part of the path, and so are the files below ``inputs`` with their lengths and times of change:
    neither a changed setting nor a changed file meets a stale table.
    """
    state = {"parameters": parameters, "inputs": source_fingerprint(spark, inputs)}
    key = hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{key}"
    if not rebuild and _is_complete(spark, path):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer finished there: it leaves its mark last, so a folder without it is not a table."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def store_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long samples as Parquet, one folder per stream and condition, sorted inside the files.

    Text scans parse every column of every pass; from here a pass over one stream opens only that
    stream's folder, and session and time ranges skip row groups.
    """
    order = ["stream", "condition", "patient_id", "time"]
    (
        samples.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .partitionBy("stream", "condition")
        .parquet(path)
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    columns = ["patient_id", "condition", "stream", "time", "value"]
    return spark.read.parquet(path).select(*columns)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
