"""Aggregations with the meaning the analysis rules give them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import is_finite
from tidemark.operators.scans import Running, attach, running

# The aggregations a user may pin to a field.
PINNED = ("auto", "group", "sum", "avg", "count", "max", "min")

#: Size of the distinct sketches: 2 ** 14 registers, a relative error of about 1 %.
SKETCH_BITS = 14
#: Stretches of equal rank in which the values of a quantile bracket are walked.
STRETCHES = 64


def table_stats(df: DataFrame, day: str, identity: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(F.col(identity)).alias("identity_count"),
        F.min(day).alias("min_date"),
        F.max(day).alias("max_date"),
    )


def tuple_distinct(*names: str) -> Column:
    """Distinct key tuples; a tuple with a NULL part still counts."""
    return F.count_distinct(F.struct(*[F.col(name) for name in names]))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def pinned(df: DataFrame, modes: Mapping[str, str], default: Mapping[str, str] | None = None) -> DataFrame:
    """Group and aggregate as pinned per field; "auto" takes the field's catalogued aggregation."""
    resolved = {
        name: (default or {}).get(name, "group") if mode == "auto" else mode for name, mode in modes.items()
    }
    unknown = sorted(set(resolved.values()) - set(PINNED))
    if unknown:
        raise ValueError(f"unknown aggregation {unknown}, expected one of {PINNED}")
    build = {"sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max, "min": F.min}
    groups = [name for name, mode in resolved.items() if mode == "group"]
    measures = [
        build[mode](name).alias(f"{mode}_{name}") for name, mode in resolved.items() if mode != "group"
    ]
    grouped = df.groupBy(*groups)
    return grouped.agg(*measures) if measures else df.select(*groups).distinct()


def incidence(df: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Observed rows and the share of them where ``flag`` holds."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observed"),
        F.round(F.count_if(flag) / F.count(F.lit(1)), 4).alias("rate"),
    )


def cohort_funnel(
    df: DataFrame, entity: str, stage: str, moment: str, stages: Sequence[str], period: Column
) -> DataFrame:
    """Entities entering at the first stage per period, and how many reach each later stage.

    An entity's cohort is the period of its first first-stage row; a later stage counts when it
    happens at or after that moment. One aggregate per entity settles both.
    """
    first = F.min(F.when(F.col(stage) == stages[0], F.col(moment)))
    reached = [
        F.max(F.when(F.col(stage) == name, F.col(moment))).alias(f"last_{at}")
        for at, name in enumerate(stages[1:], 1)
    ]
    people = (
        df.filter(F.col(stage).isin(*stages)).groupBy(entity).agg(first.alias(moment), *reached)
        .filter(F.col(moment).isNotNull())
        .withColumn("cohort", period)
    )
    return people.groupBy("cohort").agg(
        F.count(F.lit(1)).alias(stages[0]),
        *[
            F.count_if(F.col(f"last_{at}") >= F.col(moment)).alias(name)
            for at, name in enumerate(stages[1:], 1)
        ],
    )


def _bring(df: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of one row per key, or of the only row where there are no keys."""
    if keys:
        return attach(df, extra, keys)
    row = extra.select(F.struct(*extra.columns).alias("__row")).agg(F.first("__row")).scalar()
    return df.withColumns({name: row[name] for name in extra.columns})


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, name: str = "median", accuracy: int = 1000
) -> DataFrame:
    """Interpolated quantile per key (of the whole table without keys), exact.

    An approximate quantile, whose rank error is at most 1/accuracy of the rows, brackets the answer from twice that
    distance. Rows beside the bracket are only counted, with the nearest value on either side; the values inside (about
    4/accuracy of the rows) are counted, cut into stretches of equal rank and walked in order, one stretch a task. The
    counts show whether the bracket holds the wanted ranks; a rank right beside it has the nearest value, any other
    outcome raises.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    slack = 2.0 / accuracy
    low, high = max(0.0, q - slack), min(1.0, q + slack)
    bracket = known.groupBy(*keys).agg(
        F.percentile_approx("__v", [low, high], accuracy).alias("__b"), F.count(F.lit(1)).alias("__n")
    )
    located = _bring(known, bracket, keys)
    value_, b = F.col("__v"), F.col("__b")
    counted = located.groupBy(
        *keys, "__n", F.when((value_ >= b[0]) & (value_ <= b[1]), value_).alias("__in")
    ).agg(
        F.count(F.lit(1)).alias("__count"), F.count_if(value_ < b[0]).alias("__under"),
        F.max(F.when(value_ < b[0], value_)).alias("__before"), F.min(F.when(value_ > b[1], value_)).alias("__after"),
    )
    sides = counted.groupBy(*keys).agg(
        F.sum("__under").alias("__below"), F.max("__before").alias("__before"), F.min("__after").alias("__after"),
        F.percentile_approx("__in", [at / STRETCHES for at in range(1, STRETCHES)]).alias("__cuts"),
    )
    inside = _bring(counted.filter(F.col("__in").isNotNull()).select(*keys, "__n", "__in", "__count"), sides, keys)
    steps = running(
        inside, list(keys), ["__in"], F.size(F.filter("__cuts", lambda cut: cut < F.col("__in"))),
        {"__upto": Running("sum", F.col("__count"))},
    )
    last = F.col("__below") + F.col("__upto") - 1
    first = last - F.col("__count") + 1
    rank = (F.col("__n") - 1) * F.lit(q)

    def at(wanted: Column) -> Column:
        return F.max(F.when((first <= wanted) & (last >= wanted), F.col("__in")))

    ends = steps.groupBy(*keys, "__n", "__below", "__before", "__after").agg(
        at(F.floor(rank)).alias("__lo"), at(F.ceil(rank)).alias("__hi"), F.max(last).alias("__last")
    )

    def sure(found: str, wanted: Column) -> Column:
        missed = F.raise_error(F.lit("the bracket of a quantile misses its rank")).cast("double")
        return (
            F.when(F.col(found).isNotNull(), F.col(found)).when(wanted == F.col("__below") - 1, F.col("__before"))
            .when(wanted == F.col("__last") + 1, F.col("__after")).otherwise(missed)
        )

    lower, upper = sure("__lo", F.floor(rank)), sure("__hi", F.ceil(rank))
    return ends.select(*keys, (lower + (upper - lower) * (rank - F.floor(rank))).alias(name))


def without_outliers(df: DataFrame, value: str, upper: float = 0.99) -> DataFrame:
    """Drop rows above the exact upper quantile of the whole table, on request only."""
    return df.filter(F.col(value) <= exact_quantile(df, [], value, upper, "__limit").scalar())


def metric_profile(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric: known values, share of NULLs, range and non-finite values, in one pass."""
    parts = []
    for name in metrics:
        value = F.col(name).cast("double")
        parts += [
            F.count(value).alias(f"n|{name}"), F.min(value).alias(f"lo|{name}"), F.max(value).alias(f"hi|{name}"),
            F.count_if(~is_finite(value)).alias(f"bad|{name}"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *parts)
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(f"n|{name}").alias("non_null_count"),
            F.round(1 - F.try_divide(F.col(f"n|{name}"), F.col("__rows")), 6).alias("null_ratio"),
            F.col(f"lo|{name}").alias("min"),
            F.col(f"hi|{name}").alias("max"),
            F.col(f"bad|{name}").alias("non_finite_count"),
        )
        for name in metrics
    ]
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, T.NumericType):
        return "number"
    return "date" if isinstance(field.dataType, T.DateType | T.TimestampType | T.TimestampNTZType) else "other"


def _profile_row(name: str, kind: str, rows: Column, known: Column, distinct: Column, low: Column, high: Column, total: Column) -> Column:
    shown = {"number": lambda c: c.cast("double").cast("string"), "date": lambda c: F.to_date(c).cast("string")}.get(kind, lambda c: F.lit(None).cast("string"))
    return F.struct(
        F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.round(1 - F.try_divide(known, rows), 6).alias("null_ratio"),
        distinct.alias("distinct_count"), shown(low).alias("min"), shown(high).alias("max"),
        (F.round(F.try_divide(total, known), 2) if kind == "number" else F.lit(None).cast("double")).alias("mean"),
    )


def field_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column, by type: numbers get range and mean, dates a range, others a distinct count.

    Distinct counts are exact, from a long table of (column, value) whose repeats go in every task before the shuffle, so
    that each value is moved once; or approximate, from the sketches of :func:`profile_parts`, in one pass.
    """
    if approximate:
        return merged_profile(profile_parts(df))
    kinds = {field.name: _kind(field) for field in df.schema.fields}
    parts = [F.count(F.lit(1)).alias("__rows")]
    for name, kind in kinds.items():
        column = F.col(f"`{name}`")
        parts.append(F.count(column).alias(f"n|{name}"))
        if kind != "other":
            parts += [F.min(column).alias(f"lo|{name}"), F.max(column).alias(f"hi|{name}")]
        if kind == "number":
            parts.append(F.sum(column.cast("double")).alias(f"sum|{name}"))
    none = F.lit(None)
    value = lambda mark, name, there: F.col(f"`{mark}|{name}`") if there else none
    wide = df.agg(*parts).select(
        F.explode(
            F.array(
                *[
                    _profile_row(name, kind, F.col("__rows"), F.col(f"`n|{name}`"), none.cast("long"), *[value(m, name, kind != "other") for m in ("lo", "hi")], value("sum", name, kind == "number"))
                    for name, kind in kinds.items()
                ]
            )
        ).alias("p")
    )
    distinct = long_values(df).distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return wide.select("p.*").join(distinct, "field", "left").withColumn("distinct_count", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


def long_values(df: DataFrame) -> DataFrame:
    """(field, value): the known values of all columns as text, one text for equal values."""
    def text(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType | T.FloatType):
            column = column + F.lit(0.0)  # -0.0 equals 0.0
        if isinstance(field.dataType, T.BinaryType):
            return F.hex(column)
        return F.to_json(F.struct(column)) if isinstance(field.dataType, T.ArrayType | T.StructType | T.MapType) else column.cast("string")

    cells = F.array(*[F.struct(F.lit(f.name).alias("field"), F.when(F.col(f"`{f.name}`").isNotNull(), text(f)).alias("value")) for f in df.schema.fields])
    return df.select(F.explode(cells).alias("c")).select("c.field", "c.value").filter(F.col("value").isNotNull())


def profile_parts(df: DataFrame, shard: Column | None = None) -> DataFrame:
    """Mergeable profile: one row per shard and column, with counts, range, sum, a distinct sketch and a quantile sketch.

    Rows of new shards are appended to the stored ones; ``merged_profile`` reads them all without the data.
    """
    kinds = {field.name: _kind(field) for field in df.schema.fields}
    structs = []
    for name, kind in kinds.items():
        column = F.col(f"`{name}`")
        number = F.when(~F.isnan(column.cast("double")), column.cast("double")) if kind == "number" else F.lit(None).cast("double")
        day = F.to_date(column) if kind == "date" else F.lit(None).cast("date")
        cell = F.to_json(F.struct(column)) if kind == "other" else column.cast("string")
        structs.append(
            F.struct(
                F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.count(column).alias("known"),
                F.min(number).alias("low"), F.max(number).alias("high"), F.sum(number).alias("total"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                F.hll_sketch_agg(F.when(column.isNotNull(), cell), F.lit(SKETCH_BITS)).alias("distinct_sketch"),
                F.kll_sketch_agg_double(number).alias("quantile_sketch"),
            )
        )
    grouped = df.groupBy((shard if shard is not None else F.lit("")).cast("string").alias("shard"))
    return grouped.agg(F.array(*structs).alias("parts")).select("shard", F.inline("parts"))


def merged_profile(parts: DataFrame, quantiles: Sequence[float] = ()) -> DataFrame:
    """The profile of all shards together; with ``quantiles`` also the column ``quantiles`` of numeric fields (array<double>)."""
    merged = parts.groupBy("field", "kind").agg(
        F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch", F.lit(False))).alias("distinct_count"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )
    number, day = F.col("kind") == "number", F.col("kind") == "date"
    shown = lambda value, of_day: F.when(number, F.col(value).cast("string")).when(day, F.col(of_day).cast("string"))
    found = merged.select(
        "field", "kind", F.round(1 - F.try_divide("known", "rows"), 6).alias("null_ratio"), "distinct_count", shown("low", "first_day").alias("min"),
        shown("high", "last_day").alias("max"), F.when(number, F.round(F.try_divide("total", "known"), 2)).alias("mean"),
        *([F.when(number & (F.col("known") > 0), F.array(*[F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(q))) for q in quantiles])).alias("quantiles")] if quantiles else []),
    )
    return found


def sample_values(df: DataFrame, column: str, count: int = 5) -> DataFrame:
    """The first distinct known values in order."""
    return (
        df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
        .orderBy("value").limit(count)
    )


def first_rows_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """Rank rows 1..count per key, keeping the rank; pruned before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= count)
