"""Registry of guarded metrics; one entry drives the column, its check and its description."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Format label of ordinary companies, and the order of the metric columns.
GENERAL_ENTERPRISE = "一般企业"
TAX_RATE_FLOOR = 0.0
TAX_RATE_CEILING = 1.0
LOSS_YEAR_TAX_RATE = 0.0
MARKET_METRIC_IDS = (
    "pe_ttm", "pb", "pcf_ttm", "earnings_yield_ttm", "liabilities_to_assets",
    "liabilities_to_equity",
)
REPORT_METRIC_IDS = (
    "pe_parent_ttm", "pb_parent", "ps_ttm", "net_margin_ttm", "roe_ttm", "roa_ttm",
    "asset_turnover_ttm", "cfo_to_net_profit", "cfo_margin", "revenue_yoy",
    "parent_net_profit_yoy", "revenue_qoq", "profit_qoq", "revenue_cagr_3y", "profit_cagr_3y",
)
ENTERPRISE_METRIC_IDS = (
    "gross_margin_ttm", "ebitda_margin_ttm", "ev_sales_ttm", "ev_ebit_ttm", "ev_ebitda_ttm",
    "current_ratio", "quick_ratio", "debt_to_equity", "net_debt_to_ebitda", "interest_coverage",
    "dso", "dio", "dpo", "cash_conversion_cycle", "fcff_ttm", "fcfe_ttm", "roic_ttm",
)
DAILY_METRIC_IDS = (*REPORT_METRIC_IDS, *ENTERPRISE_METRIC_IDS)

EBIT = "(total_profit_ttm + interest_expense_ttm)"
EBITDA = f"({EBIT} + depreciation_and_amortization_ttm)"
ENTERPRISE_VALUE = (
    "(total_market_cap + interest_bearing_debt + coalesce(preferred_shares_equity, 0)"
    " + coalesce(minority_interest, 0) - cash_and_equivalents)"
)
TAX_RATE = (
    f"(case when total_profit_ttm > 0 then least(greatest(income_tax_expense_ttm / total_profit_ttm,"
    f" {TAX_RATE_FLOOR}D), {TAX_RATE_CEILING}D) else {LOSS_YEAR_TAX_RATE}D end)"
)
NOPAT = f"({EBIT} * (1 - {TAX_RATE}))"
WORKING_CAPITAL_CHANGE = "(operating_working_capital - prior_year_operating_working_capital)"
DAYS = 365


@dataclass(frozen=True)
class Metric:
    """``sql`` may only be evaluated where ``invalid_when`` does not hold."""

    metric_id: str
    formula: str
    invalid_when: str
    unit: str = "ratio"
    status: str = "active"
    version: int = 1

    @property
    def sql(self) -> str:
        return f"case when {self.invalid_when} then null else {self.formula} end"


def _ratio(metric_id: str, above: str, below: str, general_only: bool = False, **kwargs) -> Metric:
    guard = f"{below} is null or {below} <= 0"
    if general_only:
        guard = f"statement_format is distinct from '{GENERAL_ENTERPRISE}' or {guard}"
    return Metric(metric_id, f"{above} / {below}", guard, **kwargs)


def _growth(metric_id: str, now: str, base: str) -> Metric:
    return Metric(metric_id, f"{now} / {base} - 1", f"{base} is null or {base} <= 0")


def _cagr(metric_id: str, now: str, base: str, years: int = 3) -> Metric:
    guard = f"{base} is null or {base} <= 0 or {now} is null or {now} <= 0"
    return Metric(metric_id, f"power({now} / {base}, 1D / {years}) - 1", guard)


def _days(metric_id: str, stock: str, flow: str) -> Metric:
    metric = _ratio(metric_id, stock, flow, general_only=True, unit="days")
    return Metric(metric_id, f"{metric.formula} * {DAYS}", metric.invalid_when, unit="days")


def _amount(metric_id: str, formula: str) -> Metric:
    guard = f"statement_format is distinct from '{GENERAL_ENTERPRISE}'"
    return Metric(metric_id, formula, guard, unit="amount")


def _registry() -> dict[str, Metric]:
    cap = "total_market_cap"
    dso, dio, dpo = (
        _days("dso", "avg_receivables_for_turnover", "operating_revenue_ttm"),
        _days("dio", "avg_inventory", "operating_cost_ttm"),
        _days("dpo", "avg_payables_for_turnover", "operating_cost_ttm"),
    )
    entries = (
        _ratio("pe_ttm", cap, "net_profit_ttm"),
        _ratio("pb", cap, "net_assets"),
        _ratio("pcf_ttm", cap, "cash_flow_ttm"),
        _ratio("earnings_yield_ttm", "net_profit_ttm", cap),
        _ratio("liabilities_to_assets", "total_liabilities", "total_assets"),
        _ratio("liabilities_to_equity", "total_liabilities", "net_assets"),
        _ratio("pe_parent_ttm", cap, "parent_net_profit_ttm"),
        _ratio("pb_parent", cap, "parent_equity"),
        _ratio("ps_ttm", cap, "operating_revenue_ttm"),
        _ratio("net_margin_ttm", "parent_net_profit_ttm", "operating_revenue_ttm"),
        _ratio("roe_ttm", "parent_net_profit_ttm", "avg_parent_equity"),
        _ratio("roa_ttm", "net_profit_ttm", "avg_total_assets"),
        _ratio("asset_turnover_ttm", "operating_revenue_ttm", "avg_total_assets"),
        _ratio("cfo_to_net_profit", "operating_cash_flow_ttm", "net_profit_ttm"),
        _ratio("cfo_margin", "operating_cash_flow_ttm", "operating_revenue_ttm"),
        _growth("revenue_yoy", "operating_revenue_ytd", "operating_revenue_yoy_base"),
        _growth("parent_net_profit_yoy", "parent_net_profit_ytd", "parent_net_profit_yoy_base"),
        _growth("revenue_qoq", "operating_revenue_quarter", "operating_revenue_qoq_base"),
        _growth("profit_qoq", "parent_net_profit_quarter", "parent_net_profit_qoq_base"),
        _cagr("revenue_cagr_3y", "operating_revenue_ttm", "operating_revenue_cagr_3y_base"),
        _cagr("profit_cagr_3y", "parent_net_profit_ttm", "parent_net_profit_cagr_3y_base"),
        _ratio("gross_margin_ttm", "(operating_revenue_ttm - operating_cost_ttm)", "operating_revenue_ttm", True),
        _ratio("ebitda_margin_ttm", EBITDA, "operating_revenue_ttm", True),
        _ratio("ev_sales_ttm", ENTERPRISE_VALUE, "operating_revenue_ttm", True),
        _ratio("ev_ebit_ttm", ENTERPRISE_VALUE, EBIT, True),
        _ratio("ev_ebitda_ttm", ENTERPRISE_VALUE, EBITDA, True),
        _ratio("current_ratio", "total_current_assets", "total_current_liabilities", True),
        _ratio("quick_ratio", "(total_current_assets - inventory)", "total_current_liabilities", True),
        _ratio("debt_to_equity", "interest_bearing_debt", "parent_equity", True),
        _ratio("net_debt_to_ebitda", "(interest_bearing_debt - cash_and_equivalents)", EBITDA, True),
        _ratio("interest_coverage", EBIT, "interest_expense_ttm", True),
        dso, dio, dpo,
        _amount("cash_conversion_cycle", f"({dso.sql}) + ({dio.sql}) - ({dpo.sql})"),
        _amount(
            "fcff_ttm",
            f"{NOPAT} + depreciation_and_amortization_ttm - capital_expenditure_cash_ttm"
            f" - {WORKING_CAPITAL_CHANGE}",
        ),
        _amount(
            "fcfe_ttm",
            "net_profit_ttm + depreciation_and_amortization_ttm - capital_expenditure_cash_ttm"
            f" - {WORKING_CAPITAL_CHANGE} + net_debt_issuance_ttm",
        ),
        _ratio("roic_ttm", NOPAT, "avg_invested_capital", True),
    )
    return {metric.metric_id: metric for metric in entries}


REGISTRY = _registry()


def pick(ids: Sequence[str], registry: dict[str, Metric] | None = None) -> list[Metric]:
    """Entries for ``ids``; a missing, inactive or incomplete entry is an error."""
    source = REGISTRY if registry is None else registry
    chosen = []
    for metric_id in ids:
        metric = source.get(metric_id)
        if metric is None or metric.status != "active":
            raise ValueError(f"metric {metric_id} is not registered as active")
        if not metric.formula or not metric.invalid_when:
            raise ValueError(f"metric {metric_id} lacks a formula or an invalid rule")
        chosen.append(metric)
    return chosen


def with_metrics(df: DataFrame, metrics: Iterable[Metric]) -> DataFrame:
    """One projection with every metric column appended."""
    return df.select("*", *[F.expr(metric.sql).alias(metric.metric_id) for metric in metrics])
