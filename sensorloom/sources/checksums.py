"""Checksum manifests: parse, compare contents, and partition a request by what is published."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.sources.files import listing, local_path, opened, per_file

BLOCK_BYTES = 1 << 20


def parse_manifest(lines: DataFrame, line: str = "value") -> DataFrame:
    """``checksum path`` lines, cut at the first run of white space."""
    parts = F.split(F.col(line), r"\s+", 2)
    return lines.select(
        parts.getItem(0).alias("checksum"),
        F.regexp_replace(parts.getItem(1), r"^\s+|\s+$", "").alias("path"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def file_digest(uri: str, block_bytes: int = BLOCK_BYTES) -> str:
    """SHA-256 of a file, read in blocks."""
    digest = hashlib.sha256()
    with opened(uri) as stream:
        while block := stream.read(block_bytes):
            digest.update(block)
    return digest.hexdigest()


def file_checksums(
    spark: SparkSession, path: str, root: str, pattern: str = "*", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """SHA-256 of each file below ``path``, with the path relative to ``root``.

    Files are dealt over tasks and streamed there in blocks, so no row ever holds a file, however large it is.
    """
    files = listing(spark, path, pattern, recursive=True)
    hashed = per_file(files, lambda uri: file_digest(uri, block_bytes), "checksum", "string")
    inside = F.regexp_replace(local_path("uri"), f"^\\Q{root.rstrip('/')}/\\E", "")
    return hashed.select(inside.alias("path"), "checksum")


def verify_checksums(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """``status`` of each path: verified, mismatch, or unlisted."""
    expected = manifest.select("path", F.col("checksum").alias("expected"))
    return actual.join(expected, "path", "left").select(
        "path",
        "checksum",
        "expected",
        F.when(F.col("expected").isNull(), "unlisted")
        .when(F.col("expected") == F.col("checksum"), "verified")
        .otherwise("mismatch")
        .alias("status"),
    )


def available_in(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    return requested.join(manifest.select("path"), "path", "left_semi")


def unavailable_in(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    return requested.join(manifest.select("path"), "path", "left_anti")
