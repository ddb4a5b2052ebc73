"""Files as Spark lists them, opened in blocks inside tasks."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS_PER_CORE = 2


def listing(spark: SparkSession, path: str | list[str], pattern: str = "*", recursive: bool = False) -> DataFrame:
    """``uri, bytes, modified`` of the files at ``path`` (a folder, file or glob); contents are not read.

    As in any scan of Spark, files without a byte are not listed, nor are hidden ones.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return found.select(
        F.col("path").alias("uri"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")
    )


def local_path(uri: Column | str) -> Column:
    """The address without the scheme of a local file."""
    return F.regexp_replace(uri, "^file:/+", "/")


def opened(uri: str, compressed: bool = False) -> pa.NativeFile:
    """The bytes of a file as a stream. ``compressed`` unpacks by the name's ending.

    Local files and the stores that Arrow knows (HDFS with ViewFS, S3, GCS, Azure) can be opened in a task.
    """
    if uri.startswith("file:"):
        system, path = fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    elif "://" not in uri:
        system, path = fs.LocalFileSystem(), uri
    else:
        system, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return system.open_input_stream(path, compression="detect" if compressed else None)


def per_file(files: DataFrame, kernel: Callable[[str], object], name: str, kind: str) -> DataFrame:
    """``uri`` and what ``kernel`` makes of each, as column ``name`` of the type ``kind``; files are dealt over tasks."""
    tasks = TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"uri": [uri], name: [kernel(uri)]})

    return files.select("uri").repartition(tasks, "uri").mapInArrow(run, f"uri string, {name} {kind}")


def csv_header(uri: str) -> list[str]:
    """The names in the first line of a CSV file; none if the file is empty. Only its first block is read."""
    with opened(uri, compressed=True) as stream:
        text = io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")
        return next(csv.reader(text), [])


def csv_scans(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> list[DataFrame]:
    """One scan for each distinct header of the files at ``path``, all columns as text, found by name.

    Headers are read where the files are, by one small task per share of the files, and only distinct ones reach the
    driver. Files of one header are one scan. Columns that are not in ``columns`` get names of their position, so
    that repeated or oddly spelled ones do no harm. A file without one of the columns is an error, and so is one that
    has it twice.
    """
    headers = per_file(listing(spark, path), csv_header, "header", "array<string>")
    kinds = headers.groupBy("header").agg(F.min("uri").alias("example"), F.sort_array(F.collect_list("uri")).alias("files"))
    found = sorted(kinds.collect(), key=lambda row: row["example"])
    if not found:
        raise FileNotFoundError(f"No file at {path}.")
    scans = []
    for row in found:
        header = list(row["header"])
        missing = [c for c in columns if c not in header]
        if missing:
            raise ValueError(f"Columns not found: {', '.join(missing)} ({row['example']})")
        twice = [c for c in columns if header.count(c) > 1]
        if twice:
            raise ValueError(f"Columns found twice: {', '.join(twice)} ({row['example']})")
        names = [name if name in columns else f"_c{at}" for at, name in enumerate(header)]
        schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
        files = path if len(found) == 1 else list(row["files"])
        scans.append(spark.read.schema(schema).option("header", True).csv(files))
    return scans


def united(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def source_fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A short text that changes if a file below ``paths`` comes, goes, grows or is written again."""
    if not paths:
        return "none"
    file = F.xxhash64("uri", "bytes", "modified")
    row = (
        listing(spark, list(paths), recursive=True)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(file).alias("check"))
        .first()
    )
    return f"{row['n']}-{row['bytes'] or 0}-{row['check'] or 0}"
