"""Stored results of queries: write them as snapshots, or hold new results against them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.compare import compare_results
from tidemark.sources.files import current, publish, read_current


def write_snapshots(spark: SparkSession, results: Mapping[str, DataFrame], folder: str) -> None:
    """Publish each result as the newest version of its snapshot."""
    for name, result in results.items():
        publish(result, f"{folder}/{name}")


def compare_snapshots(spark: SparkSession, results: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """(name, equal, reason) per result; one without a snapshot is not equal."""
    report = None
    for name, result in results.items():
        if current(spark, f"{folder}/{name}") is None:
            row = spark.createDataFrame([(name, False, "no snapshot")], "name string, equal boolean, reason string")
        else:
            row = compare_results(read_current(spark, f"{folder}/{name}"), result).select(F.lit(name).alias("name"), "equal", "reason")
        report = row if report is None else report.unionByName(row)
    if report is None:
        raise ValueError("no results to compare")
    return report
