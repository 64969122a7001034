"""Set and bag comparison of tables and results."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import any_of, is_finite
from tidemark.operators.scans import Running, attach, neighbour, running
from tidemark.session import cut_lineage

TOLERANCE = 1e-6
ROWS_PER_STRETCH = 50_000
STRETCHES = 1_000  # the cuts between them pass through the driver; beyond it stretches grow


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; a column one of them lacks becomes NULL there."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def recall(expected: Column, found: Column) -> Column:
    """Part of the expected values that were found; 1 when nothing was expected."""
    wanted = F.array_distinct(expected)
    hit = F.size(F.array_intersect(wanted, found))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.try_divide(hit.cast("double"), F.size(wanted)))


def missing_and_extra(required: Column, accepted: Column, present: Column) -> tuple[Column, Column]:
    return (
        F.array_sort(F.array_except(required, present)),
        F.array_sort(F.array_except(present, accepted)),
    )


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows one side has more often than the other, with the side they belong to."""
    names = sorted(left.columns)
    only_left = left.select(*names).exceptAll(right.select(*names)).withColumn("side", F.lit("left"))
    only_right = right.select(*names).exceptAll(left.select(*names)).withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def _canonical(df: DataFrame) -> DataFrame:
    """Numbers as double, booleans kept apart from them, everything else as text."""
    columns = []
    for field in sorted(df.schema.fields, key=lambda field: field.name):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.NumericType):
            column = column.cast("double")
        elif not isinstance(field.dataType, T.BooleanType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _unmatched(left: np.ndarray, have: np.ndarray, right: np.ndarray, need: np.ndarray, tolerance: float) -> int:
    """Rows of ``left`` without a partner in ``right`` when as many as possible are paired (augmenting paths)."""
    order = np.argsort(right[:, 0], kind="stable")
    right, spare = right[order], need[order].copy()
    # One step wider than the tolerance, so that rounding loses no candidate; the rows decide.
    first = np.searchsorted(right[:, 0], left[:, 0] - 2 * tolerance, "left")
    after = np.searchsorted(right[:, 0], left[:, 0] + 2 * tolerance, "right")
    near = [
        lo + np.flatnonzero((np.abs(right[lo:hi] - row) <= tolerance).all(axis=1))
        for row, lo, hi in zip(left, first, after, strict=True)
    ]
    given: list[dict[int, int]] = [{} for _ in right]
    missing = 0
    for start in np.argsort(left[:, 0], kind="stable"):
        open_rows = int(have[start])
        while open_rows:
            reached_from: dict[int, int] = {}
            came_by: dict[int, int] = {int(start): -1}
            queue, end = deque([int(start)]), None
            while queue and end is None:
                at = queue.popleft()
                for other in map(int, near[at]):
                    if other in reached_from:
                        continue
                    reached_from[other] = at
                    if spare[other]:
                        end = other
                        break
                    for holder, amount in given[other].items():
                        if amount and holder not in came_by:
                            came_by[holder] = other
                            queue.append(holder)
            if end is None:
                missing += open_rows
                break
            path, other = [], end
            while other != -1:
                path.append((reached_from[other], other))
                other = came_by[reached_from[other]]
            # A row that gives up a partner on the way has to hold as many as it gives.
            amount = min(open_rows, int(spare[end]), *[given[came_by[row]][row] for row, _ in path[:-1]])
            spare[end] -= amount
            open_rows -= amount
            for row, other in path:
                given[other][row] = given[other].get(row, 0) + amount
                if came_by[row] != -1:
                    given[came_by[row]][row] -= amount
    return missing


def _chain_starts(kinds: DataFrame, keys: Sequence[str], value: str, tolerance: float, stretches: int) -> DataFrame:
    """(keys, value, start): values of a key in chains whose steps are at most the tolerance; a chain goes by its first value.

    Only distinct values are put in order, in stretches of about equal numbers, so neither a frequent
    value nor a single key fills one task.
    """
    values = cut_lineage(kinds.select(*keys, value).distinct(), "values")
    if stretches > 1:
        shares = [at / stretches for at in range(1, stretches)]
        cuts = values.agg(F.percentile_approx(value, shares, 10 * stretches)).first()[0] or []
        stretch = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < F.col(value)))
    else:
        stretch = F.lit(0)
    stepped = neighbour(values, keys, [value], stretch, {"__before": F.col(value)})
    begins = F.coalesce(F.col(value) - F.col("__before") > tolerance, F.lit(True))
    begun = stepped.withColumn("__begun", F.when(begins, F.col(value)))
    chained = running(begun, keys, [value], stretch, {"__start": Running("max", F.col("__begun"))})
    return chained.select(*keys, value, "__start")


def compare_results(expected: DataFrame, actual: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row: equal or not, and why. Row and column order do not matter.

    Two results are equal when their rows can be paired so that numbers agree within the tolerance and
    everything else exactly. Both sides meet as counts per kind of row; where all counts agree, nothing
    else is done. Otherwise each number column in turn is cut into chains whose steps are at most the
    tolerance, as rows of different chains never pair. A group whose values all lie within the tolerance
    only has to have as many rows on both sides, and one whose kinds all agree is paired as it stands;
    any other is paired by augmenting paths over its kinds in one task. Equal rows are not cancelled
    there, because a row may be needed by another than its equal. Such a group holds the different rows
    of one unbroken chain, not all rows that consist of numbers.
    """
    spark = expected.sparkSession
    reason_columns = "equal boolean, reason string"
    if sorted(expected.columns) != sorted(actual.columns):
        return spark.createDataFrame([(False, "columns differ")], reason_columns)
    left, right = _canonical(expected), _canonical(actual)
    types = [type(field.dataType) for field in left.schema.fields]
    if types != [type(field.dataType) for field in right.schema.fields]:
        return spark.createDataFrame([(False, "column kinds differ")], reason_columns)
    names = [f"c{at}" for at in range(len(types))]
    numbers = [name for name, kind in zip(names, types, strict=True) if kind is T.DoubleType]
    keys = [name for name in names if name not in numbers]
    sides = left.toDF(*names).withColumn("ours", F.lit(1)).unionByName(right.toDF(*names).withColumn("ours", F.lit(0)))
    kinds = cut_lineage(
        sides.groupBy(*names).agg(F.sum("ours").alias("have"), F.count_if(F.col("ours") == 0).alias("need")), "kinds"
    )
    if kinds.filter("have <> need").isEmpty():
        return spark.createDataFrame([(True, "")], reason_columns)
    stretches = min(1 + kinds.count() // ROWS_PER_STRETCH, STRETCHES)
    for number in numbers:
        starts = _chain_starts(kinds, keys, number, tolerance, stretches).withColumnRenamed("__start", f"{number}_start")
        kinds = cut_lineage(attach(kinds, starts, [*keys, number]), "kinds")
        keys = [*keys, f"{number}_start"]

    # Unknown and non-finite values stand in groups of their own.
    wide = any_of([F.lit(False), *[F.max(name) - F.min(name) > tolerance for name in numbers]])
    finite = kinds.withColumns({name: F.when(is_finite(F.col(name)), F.col(name)) for name in numbers})
    groups = cut_lineage(
        finite.groupBy(*keys).agg(
            F.sum(F.col("have") - F.col("need")).alias("surplus"),
            (F.coalesce(wide, F.lit(False)) & (F.count_if(F.col("have") != F.col("need")) > 0)).alias("wide"),
        ),
        "groups",
    )
    bad = groups.agg(F.count_if(F.col("surplus") != 0)).scalar()
    if numbers:
        to_pair = groups.filter((F.col("surplus") == 0) & F.col("wide")).select(*keys, F.lit(True).alias("pair"))
        chained = attach(finite, to_pair, keys).filter("pair")

        def pair(group):
            table = group[numbers].fillna(0.0).to_numpy(dtype=float)
            have, need = group["have"].to_numpy(), group["need"].to_numpy()
            missing = _unmatched(table[have > 0], have[have > 0], table[need > 0], need[need > 0], tolerance)
            return pd.DataFrame({"missing": [missing]})

        missing = chained.groupBy(*keys).applyInPandas(pair, "missing long")
        bad = bad + F.coalesce(missing.agg(F.sum("missing")).scalar(), F.lit(0))
    totals = kinds.agg(F.sum(F.col("have") - F.col("need")).alias("more")).withColumn("bad", bad)
    same = F.col("more") == 0
    return totals.select(
        (same & (F.col("bad") == 0)).alias("equal"),
        F.when(~same, "row counts differ").when(F.col("bad") > 0, "values differ").otherwise("").alias("reason"),
    )
