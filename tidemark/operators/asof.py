"""As-of joins and version picks: "what was known at this moment"."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scans import SEGMENT, neighbour

MATCH = "__match"
MOMENT = "__moment"
SIDE = "__side"
SPREAD = "__spread"
#: Matches that a sweep hands on at once.
SWEPT_ROWS = 20_000


def _any_null(keys: Sequence[str]) -> Column:
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return missing


def _spread(keys: Sequence[str], *varying: Column) -> Column:
    """0, but another number for each row with a NULL key: such rows match nothing and need not meet."""
    return F.when(_any_null(keys), F.xxhash64(*varying)).otherwise(F.lit(0).cast("long"))


def _segment_of(moment: Column, unit: str) -> Column:
    return F.date_trunc(unit, moment)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    unit: str | None = "month",
    tie: Sequence[str] = (),
    inclusive: bool = True,
    keep_unmatched: bool = True,
) -> DataFrame:
    """Give every left row the newest right row of its key with right_time <= left_time.

    Both sides are tagged, put together and read once in time order, so no pair of rows is ever
    formed and the work stays near-linear however many right rows a key has. ``unit`` cuts each key
    into calendar segments; the last right row of earlier segments enters a segment as one extra
    row. ``unit=None`` keeps a key whole, for inputs whose keys are known to be small.
    ``payload`` columns travel as one struct so that NULLs inside the matched row survive.
    A row with a NULL among its keys matches nothing.
    """
    segment = (lambda moment: _segment_of(moment, unit)) if unit else (lambda moment: F.lit(0))
    tie_columns = [F.col(name) for name in tie]
    match = F.struct(*[F.col(name) for name in payload])
    match_type = right.select(match.alias("m")).schema["m"].dataType
    order_tie = F.struct(F.lit(0), *tie_columns)
    facts = right.select(
        *on,
        F.col(right_time).alias(MOMENT),
        segment(F.col(right_time)).alias(SEGMENT),
        F.lit(0 if inclusive else 2).alias(SIDE),
        order_tie.alias("__tie"),
        match.alias(MATCH),
        F.lit(0).cast("long").alias(SPREAD),
    ).filter(F.col(MOMENT).isNotNull() & ~_any_null(on))
    tie_type = facts.schema["__tie"].dataType
    asks = left.select(
        "*",
        F.col(left_time).alias(MOMENT),
        segment(F.col(left_time)).alias(SEGMENT),
        F.lit(1).alias(SIDE),
        F.lit(None).cast(tie_type).alias("__tie"),
        F.lit(None).cast(match_type).alias(MATCH),
        _spread(on, *[F.col(name) for name in left.columns]).alias(SPREAD),
    )
    together = asks.unionByName(facts, allowMissingColumns=True)
    if unit:
        last_of_segment = facts.groupBy(*on, SEGMENT).agg(
            F.max_by(MATCH, F.struct(MOMENT, "__tie")).alias(MATCH)
        )
        slots = asks.filter(~_any_null(on)).select(*on, SEGMENT).distinct()
        line = last_of_segment.withColumn("__slot", F.lit(0)).unionByName(
            slots.withColumn("__slot", F.lit(1)), allowMissingColumns=True
        )
        # A slot sorts before the facts of its own segment: it may only see earlier segments.
        earlier = (
            Window.partitionBy(*on).orderBy(F.col(SEGMENT), F.col("__slot").desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = (
            line.withColumn("__carried", F.last(MATCH, ignorenulls=True).over(earlier))
            .filter((F.col("__slot") == 1) & F.col("__carried").isNotNull())
            .select(
                *on, SEGMENT, F.col("__carried").alias(MATCH), F.lit(0).alias(SIDE), F.lit(0).cast("long").alias(SPREAD)
            )
        )
        together = together.unionByName(carried, allowMissingColumns=True)
    in_order = (
        Window.partitionBy(*on, SPREAD, SEGMENT)
        .orderBy(F.col(MOMENT).asc_nulls_first(), F.col(SIDE), F.col("__tie").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = together.withColumn(MATCH, F.last(MATCH, ignorenulls=True).over(in_order)).filter(
        F.col(SIDE) == 1
    )
    if not keep_unmatched:
        seen = seen.filter(F.col(MATCH).isNotNull())
    return seen.select(*left.columns, *[F.col(MATCH)[name].alias(name) for name in payload])


def validity_intervals(
    versions: DataFrame, keys: Sequence[str], start: str, until: str = "valid_until", unit: str = "year",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Turn version rows into half-open [start, next start) intervals; the newest stays open.

    Of versions with one start the last along ``tie`` covers the time; the intervals of the others are empty.
    """
    return neighbour(
        versions, keys, [start, *tie], _segment_of(F.col(start), unit), {until: F.col(start)}, ahead=True
    )


def interval_join(
    left: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    left_time: str,
    start: str,
    until: str,
    payload: Sequence[str],
    unit: str = "month",
    carried: Sequence[str] | None = None,
) -> DataFrame:
    """Match left rows to all half-open intervals [start, until) that cover them; without one the payload is NULL.
    The result has the ``carried`` columns of the left rows (all by default) and the payload.

    A sweep: the intervals and the left rows of a key pass once in the order of time. An interval is open from its start
    to its end (for ever where that is NULL), and a left row meets the intervals open at its time, so no row is compared with
    an interval that does not cover it. A key is cut into calendar units; an interval still open at a border is listed in
    the next unit too, so the unit should not be far shorter than they are. Intervals may overlap. A left row with a NULL key or time matches nothing.
    """
    horizon = left.agg(F.max(left_time)).scalar()
    step = F.expr(f"interval 1 {unit}")
    carried = left.columns if carried is None else list(carried)
    matched, whole = F.struct(*[F.col(name) for name in payload]), F.struct(*[F.col(f"`{name}`") for name in carried])
    # The last instant that an interval covers lies before its end.
    last = F.least(F.coalesce(F.col(until), horizon), horizon)
    listed = (
        intervals.filter((F.col(start) <= horizon) & (F.col(until).isNull() | (F.col(start) < F.col(until))) & ~_any_null(on))
        .withColumn(SEGMENT, F.explode(F.sequence(_segment_of(F.col(start), unit), _segment_of(last, unit), step)))
        .select(*on, SEGMENT, F.lit(0).alias(SIDE), F.col(start).alias(MOMENT), F.col(until).alias("__until"), matched.alias(MATCH))
    )
    unmatchable = _any_null(on) | F.col(left_time).isNull()
    points = left.filter(~unmatchable).select(
        *on, _segment_of(F.col(left_time), unit).alias(SEGMENT), F.lit(1).alias(SIDE), F.col(left_time).alias(MOMENT), whole.alias("__left")
    )
    # Of equal times intervals come first, as they cover their start.
    order = Window.partitionBy(*on, SEGMENT).orderBy(MOMENT, SIDE)
    together = points.unionByName(listed, allowMissingColumns=True).withColumn("__first", F.row_number().over(order) == 1)
    ordered = together.select("__first", SIDE, MOMENT, F.col("__until").cast(together.schema[MOMENT].dataType), "__left", MATCH)
    swept = ordered.mapInArrow(_sweep, T.StructType([ordered.schema["__left"], ordered.schema[MATCH]]))
    alone = left.filter(unmatchable).select(whole.alias("__left"), F.lit(None).cast(ordered.schema[MATCH].dataType).alias(MATCH))
    result = swept.unionByName(alone)
    return result.select(*[F.col(f"__left.`{name}`") for name in carried], *[F.col(MATCH)[name].alias(name) for name in payload])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first of its group, side, time, end, left row, interval's payload) in order -> (left row, payload of each open interval).

    The left rows that an interval covers stand in one stretch: from the interval's own place to the first left row of
    its group that is not before its end. Of each batch only the intervals that are still open are kept for the next.
    """
    held, held_untils = None, np.zeros(0, np.int64)
    held_endless = np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        first, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        moments, untils = _as_numbers(batch.column(2)), _as_numbers(batch.column(3))
        endless = batch.column(3).is_null().to_numpy(zero_copy_only=False)
        # Rows before the first new group go on with the group of the last batch, which is group 0.
        group, is_point = np.cumsum(first), side == 1
        points, opening = np.flatnonzero(is_point), np.flatnonzero(~is_point)
        groups = np.concatenate([np.zeros(len(held_untils), np.int64), group[opening]])
        untils, endless = np.concatenate([held_untils, untils[opening]]), np.concatenate([held_endless, endless[opening]])
        payload = batch.column(5).take(pa.array(opening, pa.int64()))
        payload = payload if held is None else pa.concat_arrays([held, payload])
        # Places of times instead of times, so that group and time make one number.
        times = np.unique(moments[points])
        steps = len(times) + 1
        order = group[points] * steps + np.searchsorted(times, moments[points])
        ends = np.where(endless, steps - 1, np.searchsorted(times, untils))
        low = np.concatenate([np.zeros(len(held_untils), np.int64), np.cumsum(is_point)[opening]])
        high = np.maximum(np.searchsorted(order, groups * steps + ends), low)
        yield from _covered(batch.column(4).take(pa.array(points, pa.int64())), payload, low, high)
        still = np.flatnonzero((groups == group[-1]) & (endless | (untils > moments[-1])))
        held, held_untils, held_endless = payload.take(pa.array(still, pa.int64())), untils[still], endless[still]


def _covered(points: pa.Array, payload: pa.Array, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each interval next to its points ``low`` to ``high``, some at a time; then the points that no interval covers."""
    sizes, count = high - low, len(points)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        upto = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + SWEPT_ROWS, side="right")), at + 1)
        part = sizes[at:upto]
        rows = np.repeat(low[at:upto] - (np.cumsum(part) - part), part) + np.arange(int(part.sum()))
        yield _matched(points, payload, rows, np.repeat(np.arange(at, upto), part))
        at = upto
    open_at = np.cumsum(np.bincount(low, minlength=count + 1) - np.bincount(high, minlength=count + 1))[:count]
    alone = np.flatnonzero(open_at == 0)
    yield _matched(points, payload, alone, None)


def _matched(points: pa.Array, payload: pa.Array, rows: np.ndarray, found: np.ndarray | None) -> pa.RecordBatch:
    intervals = pa.nulls(len(rows), payload.type) if found is None else payload.take(pa.array(found, pa.int64()))
    return pa.RecordBatch.from_arrays([points.take(pa.array(rows, pa.int64())), intervals], names=["__left", MATCH])


def _as_numbers(times: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the times; 0 for NULL."""
    numbers = times.cast(pa.int32() if pa.types.is_date32(times.type) else pa.int64())
    return pc.fill_null(numbers, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _serving(role: str, dates: Column) -> Column:
    return F.transform(dates, lambda day: F.struct(F.lit(role).alias("role"), day.alias("serves")))


def link_visible_versions(
    versions: DataFrame,
    entity: Sequence[str],
    valid_date: str,
    known_date: str,
    roles: dict[str, tuple[Column, Sequence[str]]],
    columns: Sequence[str] | None = None,
    wanted: Column | None = None,
) -> DataFrame:
    """Attach to each version the newest visible versions of related valid dates.

    ``roles`` maps a role name to an ``array<date>`` column, the valid dates for which *this* row
    may serve in that role, and to the fields handed over when it does. The result has ``columns``
    (all by default) plus one struct per role, from the newest such row whose known date is not
    after the row's own. ``wanted`` limits the rows that are answered, not those that may serve.

    Each row is listed once for itself and once per date it serves, and one window over
    (entity, served date) in order of known date answers all roles together: one shuffle instead
    of an inequality join and a re-join per role. A group holds the versions of a handful of valid
    dates, never a whole entity. A listed row carries only what its part in the window needs.
    A row with a NULL among the ``entity`` columns is linked with nothing.
    """
    record = F.struct(*[F.col(name) for name in columns or versions.columns])
    own = F.array(F.struct(F.lit("").alias("role"), F.col(valid_date).alias("serves")))
    if wanted is not None:
        own = F.filter(own, lambda _: wanted)
    links = F.concat(own, *[_serving(role, dates) for role, (dates, _) in roles.items()])
    links = F.when(_any_null(entity), own).otherwise(links)
    role_is = lambda role: F.col("__link.role") == role
    listed = versions.withColumn("__link", F.explode(links)).select(
        *entity, F.col("__link.serves").alias("__serves"), F.col(known_date).alias("__known"),
        role_is("").alias("__own"),
        _spread(entity, record).alias(SPREAD),
        F.when(role_is(""), record).alias("__record"),
        *[
            F.when(role_is(role), F.struct(*[F.col(name) for name in fields])).alias(f"__as_{role}")
            for role, (_, fields) in roles.items()
        ],
    )
    in_order = (
        Window.partitionBy(*entity, SPREAD, "__serves").orderBy(F.col("__known").asc_nulls_first(), "__own")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    linked = listed.withColumns(
        {f"__as_{role}": F.last(f"__as_{role}", ignorenulls=True).over(in_order) for role in roles}
    ).filter("__own")
    return linked.select("__record.*", *[F.col(f"__as_{role}").alias(role) for role in roles])


def newest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int = 1) -> DataFrame:
    """First ``count`` rows per key along ``order``; Spark prunes to ``count`` before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= count).drop("__rank")


def last_periods(
    versions: DataFrame, entity: Sequence[str], valid_date: str, known_date: str, count: int
) -> DataFrame:
    """Newest version of each report, then the last ``count`` reports of each entity."""
    current = newest_per(versions, [*entity, valid_date], [F.col(known_date).desc_nulls_last()])
    return newest_per(current, entity, [F.col(valid_date).desc_nulls_last()], count)
