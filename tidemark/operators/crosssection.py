"""Row filters and rankings a question asks for: latest day, months, screens, top-N."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import attach

ENTITY_CODE = "^(sh|sz|bj)[0-9]{6}$"  # fixed value: exchange prefix and six digits


def latest_day(df: DataFrame, day: str) -> DataFrame:
    """Rows of the table's one newest day (not each entity's own newest)."""
    return df.filter(F.col(day) == df.agg(F.max(day)).scalar())


def trailing_months(df: DataFrame, day: str, months: int = 1) -> DataFrame:
    """Rows from ``months`` before the table's newest day on."""
    return df.filter(F.col(day) >= F.add_months(df.agg(F.max(day)).scalar(), -months))


def matching(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Equality filters; a list means any of its values, exactly as stored."""
    for name, value in wanted.items():
        several = isinstance(value, list | tuple | set)
        df = df.filter(F.col(name).isin(*value) if several else F.col(name) == F.lit(value))
    return df


def screen(df: DataFrame, *conditions: Column) -> DataFrame:
    """All thresholds have to hold; an unknown value passes none."""
    for condition in conditions:
        df = df.filter(condition)
    return df


def top(df: DataFrame, by: Column, count: int, tie: Sequence[str], ascending: bool = False) -> DataFrame:
    """Top-N with a complete tie-break, so that repeated runs agree."""
    main = by.asc_nulls_last() if ascending else by.desc_nulls_last()
    return df.orderBy(main, *[F.col(name).asc_nulls_last() for name in tie]).limit(count)


def focus_first(df: DataFrame, dimension: str, focus: object, *then: Column) -> list[Column]:
    """Order that puts the focus value on top and keeps every other group."""
    return [F.when(F.col(dimension).eqNullSafe(F.lit(focus)), 0).otherwise(1).asc(), *then]


def resolve_entity(df: DataFrame, code: str, label: str, day: str, name: str, count: int = 10) -> DataFrame:
    """Entities whose label contains ``name``: exact hits, then the newest, then by code.

    ``contains`` takes the name literally, so wildcard characters in it need no escaping.
    """
    wanted = name.strip()
    if not wanted:
        raise ValueError("a name is needed")
    found = df.filter(F.col(label).contains(wanted)).groupBy(code, label).agg(F.max(day).alias("latest_day"))
    exact = F.when(F.col(label) == wanted, 0).otherwise(1)
    return found.orderBy(exact, F.col("latest_day").desc_nulls_last(), F.col(code).asc()).limit(count)


def bounded(df: DataFrame, count: int = 200) -> tuple[DataFrame, Column]:
    """First rows for display and the rule that tells whether there were more."""
    return df.limit(count + 1), F.count(F.lit(1)) > count


def flag_bad_codes(df: DataFrame, code: str, pattern: str = ENTITY_CODE) -> DataFrame:
    return df.withColumn("code_ok", F.coalesce(F.col(code).rlike(pattern), F.lit(False)))


def period_return(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First and last value along ``order`` per key, and the change between them."""
    at = F.struct(*[F.col(name) for name in order])
    ends = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value")
    )
    change = F.when(F.col("first_value") > 0, F.col("last_value") / F.col("first_value") - 1)
    return ends.withColumn("change", change)


def share_of_total(df: DataFrame, value: str, within: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Each row's part of its group's total; the total is an aggregate, not a one-task window."""
    if not within:
        whole = df.agg(F.sum(value)).scalar()
        return df.withColumn(name, F.try_divide(F.col(value), whole))
    totals = df.groupBy(*within).agg(F.sum(value).alias("__total"))
    return attach(df, totals, list(within)).withColumn(
        name, F.try_divide(F.col(value), F.col("__total"))
    ).drop("__total")


def output_order(
    df: DataFrame, dimensions: Sequence[str], quantities: Sequence[str] = (), derived: Sequence[str] = ()
) -> DataFrame:
    """Final columns: dimensions, then base quantities, then what is derived from them."""
    return df.select(*dimensions, *quantities, *derived)
