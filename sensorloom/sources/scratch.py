"""Shared scratch tables: lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SCOPES: list[list[DataFrame]] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_ROOTS[application]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def session_path(spark: SparkSession, name: str) -> str:
    """A folder for tables that all plans of this application share."""
    return f"{_application_folder(spark)}/{name}"


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/sensorloom/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; DataFrames that still read them stop working."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once as Parquet in the shared scratch folder and read back.

    Used where a result feeds several passes: later passes read columns from reliable files,
    so a lost executor costs a re-read and never a re-computation of the upstream plan.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    if _SCOPES:
        _SCOPES[-1].append(table)
    return table


@contextmanager
def scratch_scope():
    """Deletes the tables that :func:`materialize` writes inside, at the end: their results have been written elsewhere."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for table in _SCOPES.pop():
            release(table)


def release(table: DataFrame) -> None:
    """Delete the files of a table from :func:`materialize` that no later result reads."""
    path = _PATHS.pop(table, None)
    if path is not None:
        target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
