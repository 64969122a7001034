"""Fiscal periods: year-to-date reports to single quarters, trailing twelve months, averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions.numeric import mean_of_positives, mean_of_two, sum_if_any
from tidemark.operators.asof import link_visible_versions

# Column names of the period table, in the order of its contract.
KEYS = ("symbol", "statement_format", "report_date", "publish_date")
BALANCES = (
    "total_assets", "total_liabilities", "parent_equity", "total_owner_equity",
    "monetary_funds", "notes_receivable", "accounts_receivable", "notes_and_accounts_receivable",
    "receivables_financing", "other_receivables_total", "prepayments", "inventory",
    "total_current_assets", "fixed_assets", "intangible_assets", "goodwill",
    "short_term_borrowings", "notes_payable", "accounts_payable", "notes_and_accounts_payable",
    "contract_liabilities", "employee_benefits_payable", "taxes_payable", "other_payables_total",
    "current_portion_noncurrent_liabilities", "short_term_bonds_payable",
    "total_current_liabilities", "long_term_borrowings", "bonds_payable", "lease_liabilities",
    "total_noncurrent_liabilities", "preferred_shares_equity", "minority_interest",
    "ending_cash_balance",
)
FLOWS = (
    "operating_revenue", "operating_cost", "operating_profit", "total_profit", "net_profit",
    "parent_net_profit", "operating_cash_flow", "interest_expense", "income_tax_expense",
    "depreciation_fixed_assets", "amortization_intangible_assets",
    "amortization_long_term_deferred_expenses", "capital_expenditure_cash",
    "cash_proceeds_from_borrowings", "cash_proceeds_from_bond_issuance", "cash_repayment_of_debt",
)
BASES = ("ytd", "quarter", "ttm")
CLASSIFICATION = ("fiscal_year", "fiscal_quarter", "period_type", "months_in_period")
STANDARDISED = (
    "cash_and_equivalents", "cash_and_equivalents_source", "receivables_for_turnover",
    "payables_for_turnover", "interest_bearing_debt", "operating_working_capital",
    "invested_capital",
)
PRIOR_YEAR = (
    "cash_and_equivalents", "receivables_for_turnover", "payables_for_turnover", "inventory",
    "operating_working_capital", "invested_capital",
)
AVERAGED = (
    "receivables_for_turnover", "payables_for_turnover", "inventory",
    "operating_working_capital", "invested_capital",
)
DEBT_ITEMS = (
    "short_term_borrowings", "short_term_bonds_payable", "current_portion_noncurrent_liabilities",
    "long_term_borrowings", "bonds_payable", "lease_liabilities",
)
OTHER_OPERATING_ASSETS = ("inventory", "prepayments", "other_receivables_total")
OTHER_OPERATING_LIABILITIES = (
    "contract_liabilities", "employee_benefits_payable", "taxes_payable", "other_payables_total",
)
DEPRECIATION_ITEMS = (
    "depreciation_fixed_assets", "amortization_intangible_assets",
    "amortization_long_term_deferred_expenses",
)
PERIOD_COLUMNS = (
    *KEYS, *CLASSIFICATION, *BALANCES,
    "prior_year_total_assets", "prior_year_parent_equity", "avg_total_assets", "avg_parent_equity",
    *(f"{flow}_{basis}" for flow in FLOWS for basis in BASES),
    *STANDARDISED,
    *(f"prior_year_{name}" for name in PRIOR_YEAR),
    *(f"avg_{name}" for name in AVERAGED),
    *(f"depreciation_and_amortization_{basis}" for basis in BASES),
    *(f"net_debt_issuance_{basis}" for basis in BASES),
    *(
        f"{part}_{which}"
        for part in ("quarter_predecessor", "ttm_annual", "ttm_prior")
        for which in ("report_date", "publish_date")
    ),
    "quarter_components_complete", "ttm_components_complete",
)


def served_dates() -> dict[str, Column]:
    """Report dates for which a row is the previous quarter, last annual or year-ago report.

    They are looked up in the columns ``__this_year`` and ``__next_year`` of :func:`with_calendar`.
    """
    day = F.col("report_date")
    none = F.array().cast("array<date>")
    code = dates.month_day(day)
    next_quarter_month = (
        F.when(code == 331, 6).when(code == 630, 9).when(code == 930, 12).otherwise(0)
    )
    return {
        "before": F.filter("__this_year", lambda other: F.month(other) == next_quarter_month),
        "annual": F.when(code == 1231, F.col("__next_year")).otherwise(none),
        "year_ago": F.filter(
            dates.same_day_years_later(day, 1), lambda later: dates.month_day(later) == code
        ),
    }


def with_calendar(statements: DataFrame) -> DataFrame:
    """Add the report dates that occur in the row's year and the year after.

    The dates are gathered in one map of year -> dates; a year has at most 366 of them.
    """
    by_year = statements.select("report_date").distinct().groupBy(F.year("report_date").alias("y")).agg(
        F.collect_set("report_date").alias("days")
    )
    calendar = by_year.agg(F.map_from_entries(F.collect_list(F.struct("y", "days")))).scalar()
    none = F.array().cast("array<date>")
    year = F.year("report_date")
    return statements.withColumns(
        {
            "__this_year": F.coalesce(F.try_element_at(calendar, year), none),
            "__next_year": F.coalesce(F.try_element_at(calendar, year + 1), none),
        }
    )


def _balance(record: Column | None):
    """Standardised balance items of the row itself (``None``) or of a linked record."""
    item = (lambda name: F.col(name)) if record is None else (lambda name: record[name])
    cash = F.coalesce(item("ending_cash_balance"), item("monetary_funds"))
    # The combined line wins over the split lines; financing comes on top of either.
    trade_receivables = F.coalesce(
        item("notes_and_accounts_receivable"),
        sum_if_any(item("notes_receivable"), item("accounts_receivable")),
    )
    receivables = sum_if_any(trade_receivables, item("receivables_financing"))
    payables = F.coalesce(
        item("notes_and_accounts_payable"),
        sum_if_any(item("notes_payable"), item("accounts_payable")),
    )
    debt = sum_if_any(*[item(name) for name in DEBT_ITEMS])
    owed = sum_if_any(payables, sum_if_any(*[item(name) for name in OTHER_OPERATING_LIABILITIES]))
    held = sum_if_any(receivables, sum_if_any(*[item(name) for name in OTHER_OPERATING_ASSETS]))
    capital = sum_if_any(item("total_owner_equity"), debt)
    return {
        "cash_and_equivalents": cash,
        "receivables_for_turnover": receivables,
        "payables_for_turnover": payables,
        "inventory": item("inventory"),
        "interest_bearing_debt": debt,
        "operating_working_capital": sum_if_any(held, -owed),
        "invested_capital": capital - F.coalesce(cash, F.lit(0.0)),
    }


def _flow(name: str, basis: str) -> Column:
    value = F.col(name)
    kind = F.col("period_type")
    if basis == "ytd":
        return value
    if basis == "quarter":
        return F.when(kind == "Q1", value).when(
            kind.isin("H1", "Q3", "FY"), value - F.col("before")[name]
        )
    bridge = F.col("annual")[name] + value - F.col("year_ago")[name]
    return F.when(kind == "FY", value).when(kind.isin("Q1", "H1", "Q3"), bridge)


def classify(statements: DataFrame) -> DataFrame:
    day = F.col("report_date")
    return statements.withColumns(
        {
            "fiscal_year": F.year(day),
            "fiscal_quarter": dates.fiscal_quarter(day),
            "period_type": dates.period_type(day),
            "months_in_period": dates.months_in_period(day),
        }
    )


def link_components(statements: DataFrame) -> DataFrame:
    """Each statement version with the component versions visible at its own publish date."""
    columns = (*KEYS, *BALANCES, *FLOWS)
    narrow = statements.select(*columns)
    flows = ("report_date", "publish_date", *FLOWS)
    handed = {"before": flows, "annual": flows, "year_ago": (*flows, *BALANCES)}
    return link_visible_versions(
        with_calendar(narrow),
        ("symbol", "statement_format"), "report_date", "publish_date",
        {role: (dates_, handed[role]) for role, dates_ in served_dates().items()}, columns,
    )


def build_periods(statements: DataFrame) -> DataFrame:
    """One row per statement version: 126 columns of year-to-date, quarter and trailing values.

    Report dates may be any day.
    """
    linked = classify(link_components(statements))
    own = _balance(None)
    ago = _balance(F.col("year_ago"))
    standard = linked.withColumns(
        {
            **{name: column for name, column in own.items() if name != "inventory"},
            **{f"prior_year_{name}": ago[name] for name in PRIOR_YEAR},
            "cash_and_equivalents_source": F.when(
                F.col("ending_cash_balance").isNotNull(), "ending_cash_balance"
            ).when(F.col("monetary_funds").isNotNull(), "monetary_funds_fallback"),
            **{f"{flow}_{basis}": _flow(flow, basis) for flow in FLOWS for basis in BASES},
            "prior_year_total_assets": F.col("year_ago")["total_assets"],
            "prior_year_parent_equity": F.col("year_ago")["parent_equity"],
        }
    )
    kind = F.col("period_type")
    derived = standard.withColumns(
        {
            **{
                f"avg_{name}": mean_of_two(F.col(f"prior_year_{name}"), F.col(name))
                for name in AVERAGED
            },
            **{
                f"avg_{name}": mean_of_positives(F.col(f"prior_year_{name}"), F.col(name))
                for name in ("total_assets", "parent_equity")
            },
            **{
                f"depreciation_and_amortization_{basis}": sum_if_any(
                    *[F.col(f"{item}_{basis}") for item in DEPRECIATION_ITEMS]
                )
                for basis in BASES
            },
            **{
                f"net_debt_issuance_{basis}": sum_if_any(
                    F.col(f"cash_proceeds_from_borrowings_{basis}"),
                    F.col(f"cash_proceeds_from_bond_issuance_{basis}"),
                    -F.col(f"cash_repayment_of_debt_{basis}"),
                )
                for basis in BASES
            },
            **{
                f"{part}_{which}": F.col(role)[which]
                for part, role in (
                    ("quarter_predecessor", "before"), ("ttm_annual", "annual"), ("ttm_prior", "year_ago"),
                )
                for which in ("report_date", "publish_date")
            },
            "quarter_components_complete": F.coalesce(
                (kind == "Q1") | (kind.isin("H1", "Q3", "FY") & F.col("before").isNotNull()), F.lit(False)
            ),
            "ttm_components_complete": F.coalesce(
                (kind == "FY")
                | (kind.isin("Q1", "H1", "Q3") & F.col("annual").isNotNull() & F.col("year_ago").isNotNull()),
                F.lit(False),
            ),
        }
    )
    return derived.select(*PERIOD_COLUMNS)


def _compared_fields(basis: str) -> tuple[str, ...]:
    return ("report_date", "publish_date", f"operating_revenue_{basis}", f"parent_net_profit_{basis}")


def add_comparison_bases(periods: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Year-ago, previous-quarter and three-year-ago bases visible at each row's publish date.

    ``wanted`` limits the rows returned; every row may be a base.
    """
    day = F.col("report_date")
    code = dates.month_day(day)
    next_quarter = F.when(
        code.isin(*dates.QUARTER_ENDS), F.array(F.last_day(F.add_months(day, 3)))
    ).otherwise(F.array().cast("array<date>"))
    served = {
        "yoy": (dates.same_day_years_later(day, 1), "ytd", "yoy"),
        "qoq": (next_quarter, "quarter", "qoq"),
        "cagr": (dates.same_day_years_later(day, 3), "ttm", "cagr_3y"),
    }
    linked = link_visible_versions(
        periods, ("symbol", "statement_format"), "report_date", "publish_date",
        {role: (days, _compared_fields(basis)) for role, (days, basis, _) in served.items()}, wanted=wanted,
    )
    added: dict[str, Column] = {}
    for role, (_, basis, label) in served.items():
        added[f"{role}_base_report_date"] = F.col(role)["report_date"]
        added[f"{role}_base_publish_date"] = F.col(role)["publish_date"]
        for field in ("operating_revenue", "parent_net_profit"):
            base = F.col(role)[f"{field}_{basis}"]
            added[f"{field}_{label}_base"] = base
            if role != "cagr":
                added[f"{field}_{label}_change"] = F.col(f"{field}_{basis}") - base
    return linked.withColumns(added).drop(*served)
