"""Daily bars and report versions read out of the star-schema tables.

Suppliers play the part of listed companies: their order lines add up to daily bars and to
cumulative quarterly reports. Every report is published twice, first with all lines and later
restated without the returned ones, so that versions, late restatements and look-ahead matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import quarter_end
from tidemark.functions.numeric import exact_sum
from tidemark.plans.metrics import GENERAL_ENTERPRISE
from tidemark.plans.periods import BALANCES, FLOWS, KEYS
from tidemark.session import table

BANK = "商业银行"
FIRST_PUBLISHED_AFTER = 30
RESTATED_AFTER = 150


def statements(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    kept = F.when(F.col("l_returnflag") != "R", F.lit(1.0)).otherwise(F.lit(0.0))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    quarters = (
        lines.select(
            F.col("l_suppkey"), quarter_end(F.to_date("l_shipdate")).alias("report_date"), kept.alias("kept"),
            net.alias("net"), (F.col("l_extendedprice") * 0.5).alias("cost"),
            (net * F.col("l_tax")).alias("tax"), F.col("l_quantity").alias("qty"),
            (F.col("l_linestatus") == "O").alias("open_line"),
        )
        .groupBy("l_suppkey", "report_date")
        .agg(
            *[
                exact_sum(F.col(name) * weight, scale).alias(f"{name}_{label}")
                for label, weight in (("all", F.lit(1.0)), ("kept", F.col("kept")))
                for name, scale in (("net", 4), ("cost", 4), ("tax", 6), ("qty", 2))
            ],
            F.count_if("open_line").cast("double").alias("open_lines"),
        )
    )
    # Four quarters per company and year at most, so the cumulation below stays small.
    so_far = (
        Window.partitionBy("l_suppkey", F.year("report_date")).orderBy("report_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cumulated = quarters.select(
        "l_suppkey", "report_date", "open_lines",
        *[
            F.round(F.sum(f"{name}_{label}").over(so_far), 6).alias(f"{name}_{label}")
            for label in ("all", "kept") for name in ("net", "cost", "tax", "qty")
        ],
    )
    versions = cumulated.select(
        "*", F.explode(F.array(F.lit("all"), F.lit("kept"))).alias("version")
    ).select(
        "l_suppkey", "report_date", "open_lines", "version",
        F.date_add(
            "report_date",
            F.when(F.col("version") == "all", FIRST_PUBLISHED_AFTER).otherwise(RESTATED_AFTER),
        ).alias("publish_date"),
        *[
            F.when(F.col("version") == "all", F.col(f"{name}_all")).otherwise(F.col(f"{name}_kept")).alias(name)
            for name in ("net", "cost", "tax", "qty")
        ],
    )
    companies = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("symbol"),
        F.when(F.col("s_acctbal") < 0, BANK).otherwise(GENERAL_ENTERPRISE).alias("statement_format"),
        F.col("s_acctbal").alias("balance"),
    )
    named = versions.join(companies, "l_suppkey")
    net_, cost, tax, qty = F.col("net"), F.col("cost"), F.col("tax"), F.col("qty")
    open_lines = F.col("open_lines")
    restated = F.col("version") == "kept"
    values = {
        "total_assets": net_ * 4,
        "total_liabilities": cost * 3,
        "parent_equity": net_ * 2 - cost * 3,
        "total_owner_equity": net_ * 4 - cost * 3,
        "monetary_funds": tax * 2,
        "notes_receivable": F.nullif(open_lines, F.lit(3.0)),
        "accounts_receivable": tax,
        "notes_and_accounts_receivable": F.when(restated, net_ * 0.25),
        "receivables_financing": F.when(open_lines > 5, qty),
        "prepayments": F.when(open_lines > 8, qty * 3),
        "inventory": F.nullif(cost * 0.5, F.lit(0.0)),
        "total_current_assets": net_,
        "short_term_borrowings": F.when(F.col("balance") > 3000, F.col("balance")),
        "notes_payable": F.when(restated, open_lines),
        "accounts_payable": F.when(open_lines > 2, cost * 0.25),
        "contract_liabilities": F.when(restated, qty * 2),
        "taxes_payable": tax,
        "total_current_liabilities": cost,
        "long_term_borrowings": F.when(open_lines > 4, cost * 0.125),
        "preferred_shares_equity": F.when(restated, open_lines * 10),
        "minority_interest": net_ * 0.0625,
        "ending_cash_balance": F.when(open_lines > 6, tax * 4),
        "operating_revenue": net_,
        "operating_cost": cost,
        "operating_profit": net_ - cost,
        "total_profit": net_ - cost - tax,
        "net_profit": (net_ - cost - tax) * 0.75,
        "parent_net_profit": (net_ - cost - tax) * 0.5,
        "operating_cash_flow": net_ - cost * 1.5,
        "interest_expense": F.nullif(tax * 0.5, F.lit(0.0)),
        "income_tax_expense": (net_ - cost - tax) * 0.25,
        "depreciation_fixed_assets": qty,
        "amortization_intangible_assets": F.when(open_lines > 3, qty * 0.5),
        "capital_expenditure_cash": qty * 2,
        "cash_proceeds_from_borrowings": F.when(open_lines > 2, open_lines * 100),
        "cash_repayment_of_debt": F.when(restated, open_lines * 50),
    }
    nothing = F.lit(None).cast("double")
    return named.select(
        *KEYS, *[values.get(name, nothing).cast("double").alias(name) for name in (*BALANCES, *FLOWS)]
    )


def stock_days(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per company and day with lines shipped, with the columns the daily table needs."""
    lines = table(spark, folder, "lineitem")
    bars = lines.groupBy("l_suppkey", F.to_date("l_shipdate").alias("trade_date")).agg(
        exact_sum(F.col("l_extendedprice") * F.lit(1000.0), 2).alias("total_market_cap"),
        exact_sum(F.col("l_quantity"), 2).alias("volume"),
        exact_sum(F.col("l_extendedprice"), 2).alias("turnover"),
    )
    places = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    companies = table(spark, folder, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return bars.join(companies, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("symbol"), "trade_date", F.col("s_name").alias("stock_name"),
        F.col("r_name").alias("industry_level_1"), F.col("n_name").alias("industry_level_2"),
        F.lit(None).cast("string").alias("industry_level_3"), "total_market_cap", "volume", "turnover",
    )
