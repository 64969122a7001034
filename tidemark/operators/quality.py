"""Data checks: each returns one row of counts plus an ``errors`` array, empty when all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import any_of, is_finite
from tidemark.operators.aggregates import duplicate_groups
from tidemark.operators.scans import neighbour
from tidemark.plans.metrics import ENTERPRISE_METRIC_IDS, GENERAL_ENTERPRISE, Metric


def errors_of(rules: Sequence[tuple[Column, Column]]) -> Column:
    """Messages of the rules that are broken."""
    found = F.array(*[F.when(broken, message) for broken, message in rules])
    return F.filter(found, lambda message: message.isNotNull())


def _said(count: str, text: str) -> tuple[Column, Column]:
    return F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(f" {text}"))


def null_key(keys: Sequence[str]) -> Column:
    return any_of([F.col(key).isNull() for key in keys])


def check_table(
    df: DataFrame, keys: Sequence[str], identity: str, day: str | None,
    expected_rows: int | None = None, expected_identities: int | None = None,
) -> DataFrame:
    """Keys complete and unique, coverage, and agreement with what the manifest promised."""
    when = F.col(day) if day else F.lit(None).cast("date")
    summary = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(F.col(identity)).alias("identity_count"),
        F.min(when).alias("min_date"),
        F.max(when).alias("max_date"),
        F.count_if(null_key(keys)).alias("null_key_rows"),
    ).withColumn("duplicate_key_groups", duplicate_groups(df, keys).agg(F.count(F.lit(1))).scalar())
    rules = [_said("null_key_rows", "rows have null keys"), _said("duplicate_key_groups", "duplicate key groups")]
    if expected_rows is not None:
        rules.append((F.col("row_count") != expected_rows, F.lit("row count does not match the manifest")))
    if expected_identities is not None:
        rules.append(
            (F.col("identity_count") != expected_identities, F.lit("identity count does not match the manifest"))
        )
    return summary.withColumn("errors", errors_of(rules))


def check_columns(df: DataFrame, contract: Sequence[str]) -> list[str]:
    """Contract check of names and order."""
    return [] if list(df.columns) == list(contract) else ["columns differ from the contract"]


def check_metrics(df: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Per metric: rows set where the invalid rule holds, and rows that differ from the formula.

    Every metric is checked in the same pass over the table.
    """
    parts, rows = [], []
    for metric in metrics:
        stored = F.col(metric.metric_id)
        parts += [
            F.count_if(stored.isNotNull() & F.coalesce(F.expr(metric.invalid_when), F.lit(False))).alias(
                f"invalid|{metric.metric_id}"
            ),
            F.count_if(~stored.eqNullSafe(F.expr(metric.sql))).alias(f"differs|{metric.metric_id}"),
        ]
        rows.append(
            F.struct(
                F.lit(metric.metric_id).alias("metric"),
                F.col(f"invalid|{metric.metric_id}").alias("invalid_rows"),
                F.col(f"differs|{metric.metric_id}").alias("mismatch_rows"),
            )
        )
    return df.agg(*parts).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def check_periods(periods: DataFrame) -> DataFrame:
    """No period may use a component published after itself."""
    own = F.col("publish_date")
    late = any_of(
        F.col(name) > own
        for name in ("quarter_predecessor_publish_date", "ttm_annual_publish_date", "ttm_prior_publish_date")
    )
    keys = ("symbol", "statement_format", "report_date", "publish_date")
    summary = periods.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(null_key(keys)).alias("null_key_rows"),
        F.count_if(late).alias("future_component_rows"),
        F.count_if("quarter_components_complete").alias("quarter_complete_rows"),
        F.count_if("ttm_components_complete").alias("ttm_complete_rows"),
    ).withColumn("duplicate_key_groups", duplicate_groups(periods, keys).agg(F.count(F.lit(1))).scalar())
    return summary.withColumn(
        "errors",
        errors_of(
            [
                _said("null_key_rows", "rows have null keys"),
                _said("duplicate_key_groups", "duplicate key groups"),
                _said("future_component_rows", "rows use components published later"),
            ]
        ),
    )


def decreases(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, segment: Column) -> DataFrame:
    """Rows whose value is below the previous row's."""
    stepped = neighbour(df, keys, order, segment, {"previous_value": F.col(value)})
    return stepped.filter(F.col(value) < F.col("previous_value"))


def check_daily(daily: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Look-ahead, regressions, formulas, scope and finiteness of the daily table in few passes."""
    ids = [metric.metric_id for metric in metrics]
    published = F.col("financial_publish_date")
    late_base = any_of(F.col(f"{role}_base_publish_date") > published for role in ("yoy", "qoq", "cagr"))
    enterprise = [name for name in ENTERPRISE_METRIC_IDS if name in ids]
    out_of_scope = (F.col("statement_format") != GENERAL_ENTERPRISE) & any_of(
        F.col(name).isNotNull() for name in enterprise
    )
    # Per row one count of differing and one of non-finite values: two sums instead of 64.
    differing = sum(
        ((~F.col(metric.metric_id).eqNullSafe(F.expr(metric.sql))).cast("int") for metric in metrics), F.lit(0)
    )
    infinite = sum((F.coalesce((~is_finite(F.col(name))).cast("int"), F.lit(0)) for name in ids), F.lit(0))
    mismatch, non_finite = F.sum(differing), F.sum(infinite)
    back = decreases(
        daily.select("symbol", "trade_date", "financial_report_date"), ["symbol"], ["trade_date"],
        "financial_report_date", F.trunc("trade_date", "year"),
    )
    summary = daily.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(null_key(("symbol", "trade_date"))).alias("null_key_rows"),
        F.count_if(published > F.col("trade_date")).alias("future_financial_rows"),
        F.count_if(late_base).alias("future_comparison_rows"),
        F.coalesce(mismatch, F.lit(0)).alias("formula_mismatch_rows"),
        F.count_if(out_of_scope).alias("non_general_metric_rows"),
        F.coalesce(non_finite, F.lit(0)).alias("non_finite_values"),
    ).withColumns(
        {
            "duplicate_key_groups": duplicate_groups(daily, ("symbol", "trade_date")).agg(F.count(F.lit(1))).scalar(),
            "report_date_regressions": back.agg(F.count(F.lit(1))).scalar(),
        }
    )
    return summary.withColumn(
        "errors",
        errors_of(
            [
                _said("null_key_rows", "rows have null keys"),
                _said("duplicate_key_groups", "duplicate key groups"),
                _said("future_financial_rows", "rows use reports published later"),
                _said("future_comparison_rows", "rows use comparison bases published later"),
                _said("report_date_regressions", "report date regressions"),
                _said("formula_mismatch_rows", "values differ from their formula"),
                _said("non_general_metric_rows", "rows of other formats carry enterprise metrics"),
                _said("non_finite_values", "values are not finite"),
            ]
        ),
    )


def dupont_breaks(daily: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows where margin x turnover x multiplier is not the return on equity."""
    multiplier = F.when(F.col("avg_parent_equity") > 0, F.col("avg_total_assets") / F.col("avg_parent_equity"))
    product = F.col("net_margin_ttm") * F.col("asset_turnover_ttm") * multiplier
    gap = F.abs(product - F.col("roe_ttm"))
    return daily.agg(
        F.count(product).alias("checked_rows"),
        F.count_if(gap > tolerance * F.greatest(F.abs(F.col("roe_ttm")), F.lit(1.0))).alias("broken_rows"),
    )
