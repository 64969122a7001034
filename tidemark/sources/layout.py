"""Published tables whose files know their ranges, so that a reader picks files before Spark lists or opens them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import files as fs

RANGES = "_ranges"  # below a version's folder; Spark's readers pass over names that begin so
BITS = 8


def _cuts(df: DataFrame, name: str, parts: int) -> list:
    """At most ``parts`` lower ends of ranges of about equal rows, for any type that has an order.

    Spark's own range partitioner samples the column; a value that fills several ranges is one cut.
    """
    column = df.select(name).filter(F.col(name).isNotNull())
    ranged = column.repartitionByRange(parts, name).groupBy(F.spark_partition_id()).agg(F.min(name).alias("low"))
    return sorted(row["low"] for row in ranged.collect())


def _not_above(value: Column) -> Callable[[Column], Column]:
    return lambda end: end <= value


def curve(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """Place on a space-filling curve: the bits of the columns' range numbers in turn, nulls first."""
    place = F.lit(0).cast("long")
    for at, name in enumerate(columns):
        kind = df.schema[name].dataType
        ends = F.array(*[F.lit(cut) for cut in _cuts(df, name, 2**bits - 1)]).cast(f"array<{kind.simpleString()}>")
        number = F.size(F.filter(ends, _not_above(F.col(name))))
        for bit in range(bits):
            moved = F.shiftright(number, bit).bitwiseAND(F.lit(1)).cast("long")
            place = place + F.shiftleft(moved, bit * len(columns) + at)
    return place


def file_ranges(written: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(file, rows, low_*, high_*) per file of a table read from its folder; nulls are outside every range."""
    return written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(name).alias(f"low_{name}") for name in columns],
        *[F.max(name).alias(f"high_{name}") for name in columns],
    )


def publish_along(
    df: DataFrame, table: str, columns: Sequence[str], check: Callable[[DataFrame], list[str]] | None = None,
    max_rows_per_file: int = 0, partitions: int | None = None,
) -> str:
    """Publish ``df`` in the order of a curve over ``columns``, with the range of every file beside the files.

    The ranges are written before the version appears, so a reader finds both or neither.
    """
    place = curve(df, columns)
    parts = [partitions] if partitions else []
    ordered = df.withColumn("__place", place).repartitionByRange(*parts, "__place", *columns)
    laid_out = ordered.sortWithinPartitions("__place", *columns).drop("__place")

    def with_ranges(written: DataFrame, folder: str) -> None:
        file_ranges(written, columns).coalesce(1).write.parquet(f"{folder}/{RANGES}")

    return fs.publish(laid_out, table, check, max_rows_per_file, beside=with_ranges)


def files_within(ranges: DataFrame, wanted: Mapping[str, tuple[object | None, object | None]]) -> DataFrame:
    """Files that may hold a row with every column inside its closed range; None leaves an end open."""
    for name, (low, high) in wanted.items():
        ranges = ranges.filter(F.col(f"low_{name}").isNotNull())
        if low is not None:
            ranges = ranges.filter(F.col(f"high_{name}") >= F.lit(low))
        if high is not None:
            ranges = ranges.filter(F.col(f"low_{name}") <= F.lit(high))
    return ranges


def read_within(spark: SparkSession, table: str, wanted: Mapping[str, tuple[object | None, object | None]]) -> DataFrame:
    """Rows of the newest version with every column inside its closed range, out of the files that may hold some.

    A column without ranges only filters rows. The names of the chosen files pass through the driver,
    as they do in Spark's own listing.
    """
    folder = fs.current(spark, table)
    if folder is None:
        raise FileNotFoundError(f"nothing published at {table}")
    ranges = spark.read.parquet(f"{folder}/{RANGES}")
    known = {name: ends for name, ends in wanted.items() if f"low_{name}" in ranges.columns}
    chosen = [f"{folder}/{row['file']}" for row in files_within(ranges, known).select("file").collect()]
    rows = spark.read.parquet(*chosen) if chosen else spark.read.parquet(folder).filter(F.lit(False))
    for name, (low, high) in wanted.items():
        rows = rows.filter(F.col(name).isNotNull())
        rows = rows if low is None else rows.filter(F.col(name) >= F.lit(low))
        rows = rows if high is None else rows.filter(F.col(name) <= F.lit(high))
    return rows
