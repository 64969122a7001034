"""Ordered per-key computations that never put one whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. If one key holds a large
share of the table, that task decides the run time. The operators here cut each key into *segments*
of its order (a month of dates, a block of positions) and run the window per ``(key, segment)``.
What other segments contribute comes from a per-segment aggregate, which combines on the map side
and has one row per key and segment; it enters each window as one extra row, so the large side is
shuffled once and never joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "__segment"
CARRIED = "__carried"


@dataclass(frozen=True)
class Running:
    """A running measure: ``kind`` is max, min, sum, count or last (last non-NULL)."""

    kind: str
    value: Column

    def entry(self) -> Column:
        """What one row adds to the measure."""
        return self.value.isNotNull().cast("long") if self.kind == "count" else self.value

    def partial(self, entry: Column, order: Column) -> Column:
        """The entries of one segment in one value."""
        if self.kind == "last":
            return F.max_by(entry, F.when(entry.isNotNull(), order))
        return self.fold(entry)

    def fold(self, entry: Column) -> Column:
        """Combine entries, or partials, that come in order."""
        if self.kind == "last":
            return F.last(entry, ignorenulls=True)
        return {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}[self.kind](entry)


def attach(df: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join bringing the non-key columns of ``extra``; NULL keys meet NULL keys."""
    renamed = extra.select(
        *[F.col(key).alias(f"__k_{key}") for key in keys],
        *[name for name in extra.columns if name not in keys],
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & df[key].eqNullSafe(renamed[f"__k_{key}"])
    return df.join(renamed, condition, "left").drop(*[f"__k_{key}" for key in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    measures: dict[str, Running],
    peers: bool = False,
    include_current: bool = True,
) -> DataFrame:
    """Add running measures along ascending ``order`` within ``keys``.

    ``segment`` has to be non-decreasing along ``order``. With ``peers`` rows that tie on ``order``
    share a value (RANGE frame); rows that tie then have to fall into one segment.
    """
    entries = {f"__e_{name}": m.entry() for name, m in measures.items()}
    base = df.withColumns({SEGMENT: segment, **entries})
    position = F.struct(*[F.col(name) for name in order])
    per_segment = base.groupBy(*keys, SEGMENT).agg(
        *[m.partial(F.col(f"__e_{name}"), position).alias(f"__e_{name}") for name, m in measures.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(F.col(SEGMENT).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_segment.select(
        *keys, SEGMENT,
        *[m.fold(F.col(f"__e_{name}")).over(earlier).alias(f"__e_{name}") for name, m in measures.items()],
        F.lit(True).alias(CARRIED),
    )
    together = base.withColumn(CARRIED, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    ordered = Window.partitionBy(*keys, SEGMENT).orderBy(
        F.col(CARRIED).desc(), *[F.col(name).asc_nulls_first() for name in order]
    )
    if peers:
        frame = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    measured = together.withColumns(
        {f"__m_{name}": m.fold(F.col(f"__e_{name}")).over(frame) for name, m in measures.items()}
    ).filter(~F.col(CARRIED))
    found = {
        name: F.coalesce(F.col(f"__m_{name}"), F.lit(0)) if m.kind == "count" else F.col(f"__m_{name}")
        for name, m in measures.items()
    }
    return measured.select(*df.columns, *[column.alias(name) for name, column in found.items()])


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    values: dict[str, Column],
    ahead: bool = False,
) -> DataFrame:
    """Previous (or with ``ahead`` next) row's values along ``order`` within ``keys``."""
    payload = F.struct(*[value.alias(name) for name, value in values.items()])
    base = df.withColumns({SEGMENT: segment, "__near": payload})
    position = F.struct(*[F.col(name) for name in order])
    edge = F.min_by("__near", position) if ahead else F.max_by("__near", position)
    per_segment = base.groupBy(*keys, SEGMENT).agg(edge.alias("__near"))
    by_segment = Window.partitionBy(*keys).orderBy(F.col(SEGMENT).asc_nulls_first())
    step = F.lead if ahead else F.lag
    carried = per_segment.select(
        *keys, SEGMENT, step("__near").over(by_segment).alias("__near"), F.lit(True).alias(CARRIED)
    )
    together = base.withColumn(CARRIED, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    # The neighbouring segment's row stands before the first row, or after the last one.
    edge_first = F.col(CARRIED).asc() if ahead else F.col(CARRIED).desc()
    ordered = Window.partitionBy(*keys, SEGMENT).orderBy(
        edge_first, *[F.col(name).asc_nulls_first() for name in order]
    )
    near = together.withColumn("__beside", step("__near").over(ordered)).filter(~F.col(CARRIED))
    return near.select(*df.columns, *[F.col("__beside")[name].alias(name) for name in values])


def row_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, name: str = "position"
) -> DataFrame:
    """1-based position of each row along ``order`` within ``keys``."""
    return running(df, keys, order, segment, {name: Running("count", F.lit(1))})
