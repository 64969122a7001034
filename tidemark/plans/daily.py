"""Daily facts joined as-of disclosure date to the report in force, with all metrics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.scans import Running, running
from tidemark.plans.metrics import DAILY_METRIC_IDS, GENERAL_ENTERPRISE, pick, with_metrics
from tidemark.plans.periods import KEYS, add_comparison_bases
from tidemark.session import cut_lineage

# Column names of the daily table, in the order of its contract.
STOCK_COLUMNS = (
    "symbol", "trade_date", "stock_name", "industry_level_1", "industry_level_2",
    "industry_level_3", "total_market_cap",
)
REPORT_COLUMNS = (
    "total_assets", "parent_equity", "avg_total_assets", "avg_parent_equity",
    "total_owner_equity", "total_current_assets", "inventory", "prepayments",
    "total_current_liabilities", "preferred_shares_equity", "minority_interest",
    "cash_and_equivalents", "cash_and_equivalents_source", "receivables_for_turnover",
    "payables_for_turnover", "interest_bearing_debt", "operating_working_capital",
    "prior_year_operating_working_capital", "invested_capital", "avg_invested_capital",
    "avg_receivables_for_turnover", "avg_payables_for_turnover", "avg_inventory",
    "operating_revenue_ttm", "operating_cost_ttm", "operating_profit_ttm", "total_profit_ttm",
    "net_profit_ttm", "parent_net_profit_ttm", "operating_cash_flow_ttm",
    "interest_expense_ttm", "income_tax_expense_ttm", "depreciation_and_amortization_ttm",
    "capital_expenditure_cash_ttm", "net_debt_issuance_ttm", "operating_revenue_ytd",
    "parent_net_profit_ytd", "operating_revenue_quarter", "parent_net_profit_quarter",
    "yoy_base_report_date", "yoy_base_publish_date", "operating_revenue_yoy_base",
    "parent_net_profit_yoy_base", "operating_revenue_yoy_change", "parent_net_profit_yoy_change",
    "qoq_base_report_date", "qoq_base_publish_date", "operating_revenue_qoq_base",
    "parent_net_profit_qoq_base", "operating_revenue_qoq_change", "parent_net_profit_qoq_change",
    "cagr_base_report_date", "cagr_base_publish_date", "operating_revenue_cagr_3y_base",
    "parent_net_profit_cagr_3y_base",
)
BASE_COLUMNS = (
    *STOCK_COLUMNS, "financial_report_date", "financial_publish_date", "statement_format",
    "period_type", "financial_data_available", *REPORT_COLUMNS,
)
DAILY_COLUMNS = (*BASE_COLUMNS, *DAILY_METRIC_IDS)
CORE_TTM = (
    "operating_revenue_ttm", "net_profit_ttm", "parent_net_profit_ttm", "operating_cash_flow_ttm",
)


def newest_report_so_far(periods: DataFrame) -> DataFrame:
    """(symbol, publish_date, current_report_date): the newest report date disclosed so far.

    Only the newest report of each publish date matters, so a narrow aggregate is scanned and
    disclosures of one day see each other.
    """
    disclosed = periods.groupBy("symbol", "publish_date").agg(F.max("report_date").alias("report_date"))
    return running(
        disclosed, ["symbol"], ["publish_date"], F.trunc("publish_date", "year"),
        {"current_report_date": Running("max", F.col("report_date"))},
    ).drop("report_date")


def report_snapshots(periods: DataFrame) -> DataFrame:
    """Keys of the one report in force from each publish date on, with what decided the choice.

    Revisions of a report older than the newest one are left out, and among formats published on
    the same day the most complete one is chosen. Only the columns that decide are read.
    """
    known = sum((F.col(name).isNotNull().cast("int") for name in CORE_TTM), F.lit(0))
    deciding = periods.select(*KEYS, "ttm_components_complete", known.alias("__known"))
    in_force = deciding.join(newest_report_so_far(periods), ["symbol", "publish_date"]).filter(
        F.col("report_date") == F.col("current_report_date")
    )
    preference = Window.partitionBy("symbol", "publish_date").orderBy(
        F.col("ttm_components_complete").desc_nulls_last(),
        F.col("__known").desc(),
        (F.col("statement_format") != GENERAL_ENTERPRISE).desc_nulls_last(),
        F.col("statement_format").asc_nulls_last(),
    )
    ranked = in_force.withColumn("__choice", F.row_number().over(preference))
    return ranked.filter(F.col("__choice") == 1).select(*KEYS, "ttm_components_complete")


PERIOD_INPUTS = (
    "symbol", "statement_format", "report_date", "publish_date", "period_type", "ttm_components_complete",
    *(name for name in REPORT_COLUMNS if not name.endswith(("_base", "_change")) and "_base_" not in name),
)


def is_base(name: str) -> bool:
    """Whether a report column comes from a comparison base."""
    return name.endswith(("_base", "_change")) or "_base_" in name


def reports_for(columns: Sequence[str]) -> list[str]:
    """Report columns that the given columns of the daily table are, or are computed from."""
    formulas = " ".join(metric.sql for metric in pick([name for name in columns if name in DAILY_METRIC_IDS]))
    named = {*columns, *re.findall(r"[a-z_0-9]+", formulas)}
    return [name for name in REPORT_COLUMNS if name in named]


def period_inputs(reports: Sequence[str] = REPORT_COLUMNS) -> list[str]:
    """Columns of the period table from which snapshots with these report columns are built."""
    if any(map(is_base, reports)):
        return list(PERIOD_INPUTS)
    return [name for name in PERIOD_INPUTS if name not in REPORT_COLUMNS or name in CORE_TTM or name in reports]


def build_snapshots(periods: DataFrame, reports: Sequence[str] = REPORT_COLUMNS) -> DataFrame:
    """Reports in force, with their comparison bases where ``reports`` has columns of them, under the names of the daily table."""
    chosen = report_snapshots(periods).select(*KEYS, F.lit(True).alias("__in_force"))
    inputs = periods.select(*period_inputs(reports))
    if any(map(is_base, reports)):
        marked = inputs.join(chosen, list(KEYS), "left")
        found = add_comparison_bases(marked, F.col("__in_force").isNotNull())
    else:
        found = inputs.join(chosen, list(KEYS), "left_semi")
    return found.select(
        "symbol",
        F.col("report_date").alias("financial_report_date"),
        F.col("publish_date").alias("financial_publish_date"),
        "statement_format", "period_type", *reports,
    )


def build_daily(stocks: DataFrame, periods: DataFrame, unit: str | None = "year", columns: Sequence[str] = DAILY_COLUMNS) -> DataFrame:
    """Every stock-day with the report in force, its comparison bases and 32 metrics, or the ``columns`` of these.

    The snapshots are read twice by the as-of join, so they are written to the shared folder once.
    A company has one row per day, so a yearly segment holds at most 366 rows however large the table.
    A report travels through the as-of join as one value; only what ``columns`` need is in it.
    """
    reports = reports_for(columns)
    snapshots = cut_lineage(build_snapshots(periods, reports), "snapshots")
    kept = [name for name in STOCK_COLUMNS if name in columns or name in ("symbol", "trade_date", "total_market_cap")]
    joined = asof_join(
        stocks.select(*kept), snapshots, ["symbol"], "trade_date", "financial_publish_date",
        [name for name in snapshots.columns if name != "symbol"], unit=unit,
    ).withColumn("financial_data_available", F.col("financial_publish_date").isNotNull())
    metrics = pick([name for name in DAILY_METRIC_IDS if name in columns])
    return with_metrics(joined, metrics).select(*[name for name in DAILY_COLUMNS if name in columns])
