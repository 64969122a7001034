"""File-system steps through Hadoop's API, so that any cluster storage works."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VERSION = "version="


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """Sorted (name, is_folder) below a folder; empty when it does not exist."""
    system, path = _system(spark, folder), _path(spark, folder)
    if not system.exists(path):
        return []
    return sorted((entry.getPath().getName(), entry.isDirectory()) for entry in system.listStatus(path))


def qualified(spark: SparkSession, path: str) -> str:
    """Absolute path without the scheme's repeated slashes."""
    return _system(spark, path).makeQualified(_path(spark, path)).toString().rstrip("/")


def move(spark: SparkSession, source: str, target: str) -> None:
    system = _system(spark, source)
    system.mkdirs(_path(spark, target).getParent())
    if system.exists(_path(spark, target)) or not system.rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"could not move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    _system(spark, path).delete(_path(spark, path), True)


def versions(spark: SparkSession, table: str) -> list[int]:
    names = [name for name, folder in children(spark, table) if folder and name.startswith(VERSION)]
    return sorted(int(name[len(VERSION):]) for name in names)


def current(spark: SparkSession, table: str) -> str | None:
    """Folder of the newest published version."""
    known = versions(spark, table)
    return f"{table}/{VERSION}{known[-1]}" if known else None


def read_current(spark: SparkSession, table: str) -> DataFrame:
    folder = current(spark, table)
    if folder is None:
        raise FileNotFoundError(f"nothing published at {table}")
    return spark.read.option("mergeSchema", "true").parquet(folder)


def publish(
    df: DataFrame, table: str, check: Callable[[DataFrame], list[str]] | None = None, max_rows_per_file: int = 0,
    beside: Callable[[DataFrame, str], None] | None = None,
) -> str:
    """Write to a staging folder, check what was written, then make it the newest version.

    Readers see either the old version or the whole new one. A failed check raises and leaves the
    table as it was. ``beside`` may write more about the checked rows into the staging folder.
    """
    spark = df.sparkSession
    staging = f"{table}/_staging/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(staging)
    written = spark.read.schema(df.schema).parquet(staging)
    errors = check(written) if check else []
    if errors:
        raise ValueError("; ".join(errors))
    if beside:
        beside(written, staging)
    target = f"{table}/{VERSION}{(versions(spark, table) or [0])[-1] + 1}"
    move(spark, staging, target)
    return target
