"""Result shaping for charts: what each chart type keeps, drops and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default number of items per chart type; a heatmap reads four times as many rows.
BAR_ITEMS = 12
PIE_ITEMS = 8
SERIES_ITEMS = 30
HEATMAP_FACTOR = 4


def _points(df: DataFrame, label: str, value: str) -> DataFrame:
    text = F.col(label).cast("string")
    number = F.col(value).try_cast("double")
    return df.select(F.col(label).alias("__key"), text.alias("label"), number.alias("value")).filter(
        (F.coalesce(F.col("label"), F.lit("")) != "") & F.col("value").isNotNull()
    )


def bar(df: DataFrame, label: str, value: str, items: int = BAR_ITEMS) -> DataFrame:
    """Largest values first."""
    points = _points(df, label, value).drop("__key")
    return points.orderBy(F.col("value").desc(), F.col("label").asc()).limit(items)


def pie(df: DataFrame, label: str, value: str, items: int = PIE_ITEMS) -> DataFrame:
    """Largest slices, negatives as zero, each with its share; nothing if every slice is zero."""
    points = _points(df, label, value).select("label", F.greatest("value", F.lit(0.0)).alias("value"))
    slices = points.orderBy(F.col("value").desc(), F.col("label").asc()).limit(items)
    whole = slices.agg(F.sum("value")).scalar()
    return slices.withColumn("share", F.try_divide("value", whole)).filter(F.col("share").isNotNull())


def line(df: DataFrame, label: str, value: str, items: int = SERIES_ITEMS) -> DataFrame:
    """The last items in label order, ascending; a single point draws no line."""
    last = _points(df, label, value).orderBy(F.col("__key").desc()).limit(items)
    enough = last.agg(F.count(F.lit(1))).scalar() >= 2
    return last.filter(enough).orderBy("__key").select("label", "value")


def scatter(df: DataFrame, x: str, y: str, order: Sequence[str], items: int = SERIES_ITEMS) -> DataFrame:
    """The first pairs with two numbers."""
    pairs = df.select(
        *[F.col(name).alias(f"__o_{name}") for name in order],
        F.col(x).try_cast("double").alias("x"), F.col(y).try_cast("double").alias("y"),
    ).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return pairs.orderBy(*[f"__o_{name}" for name in order]).limit(items).select("x", "y")


def heatmap(df: DataFrame, x: str, y: str, value: str, order: Sequence[str], items: int = SERIES_ITEMS) -> DataFrame:
    """Cells of the first rows with dense ids by first appearance, and the value range."""
    first = df.orderBy(*order).limit(items * HEATMAP_FACTOR)
    # At most items * HEATMAP_FACTOR rows are left, so whole-result windows are small.
    everything = Window.orderBy(*order)
    cells = first.withColumn("__at", F.row_number().over(everything)).select(
        "__at", F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y"),
        F.col(value).try_cast("double").alias("value"),
    ).filter((F.coalesce("x", F.lit("")) != "") & (F.coalesce("y", F.lit("")) != "") & F.col("value").isNotNull())
    seen = cells.withColumns(
        {f"__first_{axis}": F.min("__at").over(Window.partitionBy(axis)) for axis in ("x", "y")}
    )
    return seen.select(
        "x", "y", "value",
        *[(F.dense_rank().over(Window.orderBy(f"__first_{axis}")) - 1).alias(f"{axis}_id") for axis in ("x", "y")],
        F.min("value").over(Window.partitionBy()).alias("low"),
        F.max("value").over(Window.partitionBy()).alias("high"),
    )


def candlestick(df: DataFrame, label: str, ohlc: Sequence[str], items: int = SERIES_ITEMS) -> DataFrame:
    """The last bars with all four prices, ascending."""
    opened, high, low, closed = ohlc
    bars = df.select(
        F.col(label).alias("__key"), F.col(label).cast("string").alias("label"),
        *[
            F.col(source).try_cast("double").alias(name)
            for source, name in ((opened, "open"), (closed, "close"), (low, "low"), (high, "high"))
        ],
    ).filter(F.coalesce(F.col("label"), F.lit("")) != "").dropna(subset=["open", "close", "low", "high"])
    return bars.orderBy(F.col("__key").desc()).limit(items).orderBy("__key").drop("__key")


def bars_from_ticks(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str], value: str) -> DataFrame:
    """Open, high, low and close per group of ticks."""
    at = F.struct(*[F.col(name) for name in order])
    return df.groupBy(*keys).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"),
        F.min(value).alias("low"), F.max_by(value, at).alias("close"),
    )
