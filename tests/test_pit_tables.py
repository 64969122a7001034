"""Periods and daily metrics on small literal inputs with known results."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import quality
from tidemark.functions.numeric import exact_sum
from tidemark.plans import daily, metrics, periods
from tidemark.plans.build import publish_daily, publish_periods
from tidemark.sources.files import read_current

BANK, GENERAL = "商业银行", metrics.GENERAL_ENTERPRISE
day = dt.date.fromisoformat

STATEMENT_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()), T.StructField("statement_format", T.StringType()),
        T.StructField("report_date", T.DateType()), T.StructField("publish_date", T.DateType()),
        *[T.StructField(name, T.DoubleType()) for name in (*periods.BALANCES, *periods.FLOWS)],
    ]
)


def statements(spark, rows):
    filled = []
    for row in rows:
        values = {"symbol": "sz300777", "statement_format": BANK} | row
        filled.append(
            tuple(
                day(values[f.name]) if f.name.endswith("_date")
                else values.get(f.name) if f.dataType == T.StringType()
                else None if values.get(f.name) is None else float(values[f.name])
                for f in STATEMENT_SCHEMA.fields
            )
        )
    return spark.createDataFrame(filled, STATEMENT_SCHEMA)


def version(report, publish, flow, **extra):
    same = ("operating_revenue", "net_profit", "parent_net_profit", "operating_cash_flow")
    ones = ("total_assets", "total_liabilities", "parent_equity", "total_owner_equity")
    return {"report_date": report, "publish_date": publish} | dict.fromkeys(same, flow) | dict.fromkeys(ones, 1) | extra


# A half year with its quarter before, its last year and its year-ago half, and two later restatements.
RESTATED = [
    version(
        "2021-06-30", "2021-08-20", 70, ending_cash_balance=9, monetary_funds=11, notes_and_accounts_receivable=24,
        accounts_receivable=444, receivables_financing=0, notes_and_accounts_payable=12, inventory=10,
        short_term_borrowings=6, long_term_borrowings=13, depreciation_fixed_assets=6,
        amortization_intangible_assets=1, amortization_long_term_deferred_expenses=0.25,
        cash_proceeds_from_borrowings=9, cash_proceeds_from_bond_issuance=3, cash_repayment_of_debt=5,
    ),
    version(
        "2021-12-31", "2022-03-18", 190, depreciation_fixed_assets=17, amortization_intangible_assets=3,
        amortization_long_term_deferred_expenses=1, cash_proceeds_from_borrowings=26,
        cash_proceeds_from_bond_issuance=4, cash_repayment_of_debt=12,
    ),
    version("2022-03-31", "2022-04-22", 55),
    version(
        "2022-06-30", "2022-08-19", 130, ending_cash_balance=14, monetary_funds=19, notes_and_accounts_receivable=36,
        accounts_receivable=500, receivables_financing=4, notes_and_accounts_payable=18, notes_payable=6,
        accounts_payable=9, inventory=16, prepayments=3, other_receivables_total=2, contract_liabilities=5,
        employee_benefits_payable=2, taxes_payable=1, other_payables_total=4, short_term_borrowings=7,
        short_term_bonds_payable=2, current_portion_noncurrent_liabilities=3, long_term_borrowings=11, bonds_payable=6,
        lease_liabilities=4, depreciation_fixed_assets=9, amortization_intangible_assets=2,
        amortization_long_term_deferred_expenses=0.5, cash_proceeds_from_borrowings=14,
        cash_proceeds_from_bond_issuance=5, cash_repayment_of_debt=8,
    ),
    version("2021-06-30", "2022-08-25", 900),
    version("2021-12-31", "2022-08-25", 5000),
]


def test_restatements_stay_invisible(spark):
    built = periods.build_periods(statements(spark, RESTATED))
    assert built.columns == list(periods.PERIOD_COLUMNS) and len(built.columns) == 126
    assert quality.check_periods(built).first()["errors"] == []
    assert built.count() == 6
    row = built.filter("report_date = date '2022-06-30'").first()
    expected = {
        "fiscal_year": 2022, "fiscal_quarter": 2, "period_type": "H1", "months_in_period": 6,
        "operating_revenue_ytd": 130,
        "operating_revenue_quarter": 130 - 55,
        "operating_revenue_ttm": 130 + 190 - 70,
        "avg_total_assets": 1, "avg_parent_equity": 1, "quarter_predecessor_publish_date": day("2022-04-22"),
        "ttm_annual_publish_date": day("2022-03-18"), "ttm_prior_publish_date": day("2021-08-20"),
        "cash_and_equivalents": 14, "cash_and_equivalents_source": "ending_cash_balance",
        "receivables_for_turnover": 36 + 4,
        "payables_for_turnover": 18,
        "interest_bearing_debt": 7 + 2 + 3 + 11 + 6 + 4,
        "operating_working_capital": (40 + 16 + 3 + 2) - (18 + 5 + 2 + 1 + 4),
        "invested_capital": 1 + 33 - 14,
        "avg_receivables_for_turnover": (40 + 24) / 2,
        "avg_payables_for_turnover": (18 + 12) / 2,
        "avg_inventory": (16 + 10) / 2,
        "avg_invested_capital": (20 + (1 + 19 - 9)) / 2,
        "net_debt_issuance_ttm": (14 + 5 - 8) + (26 + 4 - 12) - (9 + 3 - 5),
        "quarter_components_complete": True, "ttm_components_complete": True,
    }
    assert {name: row[name] for name in expected} == expected
    assert row["depreciation_and_amortization_ttm"] == pytest.approx((9 + 2 + 0.5) + (17 + 3 + 1) - (6 + 1 + 0.25))


def test_formats_are_never_mixed_and_gaps_stay_null(spark):
    rows = [
        version("2024-03-31", "2024-04-30", 10),
        version("2024-06-30", "2024-08-30", 25, statement_format=GENERAL, monetary_funds=7),
    ]
    built = periods.build_periods(statements(spark, rows)).filter(F.col("statement_format") == GENERAL).first()
    assert built["operating_revenue_quarter"] is None and built["operating_revenue_ttm"] is None
    assert built["quarter_components_complete"] is False and built["ttm_components_complete"] is False
    assert built["cash_and_equivalents_source"] == "monetary_funds_fallback"
    assert built["interest_bearing_debt"] is None and built["operating_working_capital"] is None


def test_irregular_report_dates(spark):
    rows = [
        version("2023-06-15", "2023-07-01", 3), version("2023-12-31", "2024-03-01", 9),
        version("2024-03-31", "2024-04-01", 2), version("2024-06-15", "2024-07-01", 5),
    ]
    built = periods.build_periods(statements(spark, rows)).filter("report_date = date '2024-06-15'").first()
    assert built["period_type"] == "OTHER" and built["fiscal_quarter"] is None and built["months_in_period"] == 6
    assert built["operating_revenue_ytd"] == 5 and built["operating_revenue_quarter"] is None
    assert built["quarter_predecessor_report_date"] == day("2024-03-31")
    assert built["ttm_annual_report_date"] == day("2023-12-31")
    assert built["ttm_prior_report_date"] == day("2023-06-15")
    assert built["quarter_components_complete"] is False and built["ttm_components_complete"] is False


PERIOD_VALUES = (
    "total_assets", "parent_equity", "avg_total_assets", "avg_parent_equity", "operating_revenue_ttm", "net_profit_ttm",
    "parent_net_profit_ttm", "operating_cash_flow_ttm", "operating_revenue_ytd", "parent_net_profit_ytd",
    "operating_revenue_quarter", "parent_net_profit_quarter",
)
# symbol, format, report date, publish date, period type, values in the order above
BANK_PERIODS = [
    ("sz000555", BANK, "2019-09-30", "2019-10-25", "Q3", 400, 150, 390, 145, 216, 20, 16, 30, 150, 12, 50, 4),
    ("sz000555", BANK, "2021-09-30", "2021-10-22", "Q3", 480, 170, 470, 165, 300, 30, 24, 40, 200, 16, 70, 5),
    ("sz000555", BANK, "2022-06-30", "2022-08-12", "H1", 500, 180, 490, 175, 320, 36, 30, 44, 160, 15, 64, 6),
    ("sz000555", BANK, "2022-09-30", "2022-10-28", "Q3", 520, 190, 505, 184, 343, 50, 46, 48, 250, 20, 80, 9),
    # Told again after the next report: neither the report in force nor the bases of that report change.
    ("sz000555", BANK, "2022-06-30", "2022-11-20", "H1", 5000, 1800, 4900, 1750, 3200, 360, 300, 440, 1600, 150, 640, 60),
]
COMPANY_PERIOD = ("sh688321", GENERAL, "2021-12-31", "2022-03-25", "FY", 640, 250, 600, 230, 500, 40, 36, 52, 500, 36, 140, 11)
COMPANY_INPUTS = {
    "total_owner_equity": 256, "total_current_assets": 180, "inventory": 45, "prepayments": 9,
    "total_current_liabilities": 120, "preferred_shares_equity": 4, "minority_interest": 6, "cash_and_equivalents": 35,
    "receivables_for_turnover": 54, "payables_for_turnover": 28, "interest_bearing_debt": 75,
    "operating_working_capital": 33, "prior_year_operating_working_capital": 27, "invested_capital": 300,
    "avg_invested_capital": 290, "avg_receivables_for_turnover": 50, "avg_payables_for_turnover": 26, "avg_inventory": 39,
    "operating_cost_ttm": 325, "operating_profit_ttm": 47, "total_profit_ttm": 50, "interest_expense_ttm": 8,
    "income_tax_expense_ttm": 10, "depreciation_and_amortization_ttm": 22, "capital_expenditure_cash_ttm": 30,
    "net_debt_issuance_ttm": 7,
}


def period_table(spark, lines=(*BANK_PERIODS, COMPANY_PERIOD)):
    rows = []
    for symbol, form, report, publish, kind, *numbers in lines:
        values = dict(zip(PERIOD_VALUES, map(float, numbers), strict=True))
        if symbol == COMPANY_PERIOD[0]:
            values |= {name: float(value) for name, value in COMPANY_INPUTS.items()}
        rows.append(
            (symbol, form, day(report), day(publish), kind, True, "ending_cash_balance",
             *[values.get(name) for name in (*PERIOD_VALUES, *COMPANY_INPUTS)])
        )
    names = ", ".join(f"{name} double" for name in (*PERIOD_VALUES, *COMPANY_INPUTS))
    return spark.createDataFrame(
        rows,
        "symbol string, statement_format string, report_date date, publish_date date, period_type string,"
        f" ttm_components_complete boolean, cash_and_equivalents_source string, {names}",
    )


def stock_table(spark):
    rows = [
        ("sz000555", day("2022-08-11"), "江口银行", "银行", "城商行", "城商行", 900.0),
        ("sz000555", day("2022-08-12"), "江口银行", "银行", "城商行", "城商行", 930.0),
        ("sz000555", day("2022-10-31"), "江口银行", "银行", "城商行", "城商行", 950.0),
        ("sz000555", day("2022-11-21"), "江口银行", "银行", "城商行", "城商行", 1150.0),
        ("sh688321", day("2022-08-12"), "远山机电", "电力设备", "电机", "微特电机", 2000.0),
    ]
    return spark.createDataFrame(
        rows,
        "symbol string, trade_date date, stock_name string, industry_level_1 string, industry_level_2 string,"
        " industry_level_3 string, total_market_cap double",
    )


@pytest.mark.parametrize("unit", [None, "month", "year"])
def test_daily_is_point_in_time_and_does_not_regress(spark, unit):
    built = daily.build_daily(stock_table(spark), period_table(spark), unit).cache()
    assert built.columns == list(daily.DAILY_COLUMNS) and len(built.columns) == 99
    report = quality.check_daily(built, metrics.pick(metrics.DAILY_METRIC_IDS)).first()
    assert report["errors"] == [] and report["row_count"] == 5
    rows = built.filter("symbol = 'sz000555'").orderBy("trade_date").collect()
    assert [str(r["financial_report_date"]) for r in rows] == ["2021-09-30", "2022-06-30", "2022-09-30", "2022-09-30"]
    expected = {
        "pe_parent_ttm": 1150 / 46, "roe_ttm": 46 / 184, "revenue_qoq": 80 / 64 - 1, "profit_qoq": 9 / 6 - 1,
        "revenue_yoy": 250 / 200 - 1, "parent_net_profit_yoy": 20 / 16 - 1,
        "revenue_cagr_3y": 7 / 6 - 1,  # 343 / 216 is the cube of 7 / 6
        "profit_cagr_3y": (46 / 16) ** (1 / 3) - 1,
    }
    for name, value in expected.items():
        assert rows[-1][name] == pytest.approx(value), name
    assert all(rows[-1][name] is None for name in metrics.ENTERPRISE_METRIC_IDS)
    company = built.filter("symbol = 'sh688321'").first()
    value, ebit, tax = 2000 + 75 - 35 + 4 + 6, 50 + 8, 10 / 50
    dso, dio, dpo = 50 / 500 * 365, 39 / 325 * 365, 26 / 325 * 365
    expected = {
        "gross_margin_ttm": (500 - 325) / 500, "ebitda_margin_ttm": (ebit + 22) / 500, "ev_sales_ttm": value / 500,
        "ev_ebit_ttm": value / ebit, "ev_ebitda_ttm": value / (ebit + 22), "current_ratio": 180 / 120,
        "quick_ratio": (180 - 45) / 120, "debt_to_equity": 75 / 250, "net_debt_to_ebitda": (75 - 35) / (ebit + 22),
        "interest_coverage": ebit / 8, "dso": dso, "dio": dio, "dpo": dpo, "cash_conversion_cycle": dso + dio - dpo,
        "fcff_ttm": ebit * (1 - tax) + 22 - 30 - (33 - 27), "fcfe_ttm": 40 + 22 - 30 - (33 - 27) + 7, "roic_ttm": ebit * (1 - tax) / 290,
    }
    for name, value in expected.items():
        assert math.isclose(company[name], value), name
    built.unpersist()


def test_one_format_is_chosen_per_publish_date(spark):
    rows = [("s", form, "2023-12-31", "2024-03-31", "FY", *[1] * 12) for form in (GENERAL, BANK)]
    chosen = daily.report_snapshots(period_table(spark, rows)).collect()
    assert [row["statement_format"] for row in chosen] == [BANK]
    incomplete = period_table(spark, rows).withColumn(
        "ttm_components_complete", F.col("statement_format") == GENERAL
    )
    assert [r["statement_format"] for r in daily.report_snapshots(incomplete).collect()] == [GENERAL]


def test_checks_report_look_ahead_and_wrong_values(spark):
    built = daily.build_daily(stock_table(spark), period_table(spark))
    broken = built.withColumns(
        {
            "financial_publish_date": F.date_add("trade_date", 1), "roe_ttm": F.col("roe_ttm") + 1,
            "dso": F.lit(float("inf")),
        }
    )
    report = quality.check_daily(broken, metrics.pick(metrics.DAILY_METRIC_IDS)).first()
    assert report["future_financial_rows"] == 5 and report["non_finite_values"] == 5
    assert report["non_general_metric_rows"] == 4 and report["formula_mismatch_rows"] >= 10
    assert len(report["errors"]) == 4


def test_publish_builds_both_tables(spark, tmp_path):
    output = str(tmp_path)
    publish_periods(statements(spark, RESTATED), output)
    days = spark.createDataFrame(
        [("sz300777", day("2022-08-19"), "n", "a", "b", "c", 10.0), ("sz300777", day("2022-08-29"), "n", "a", "b", "c", 11.0)],
        stock_table(spark).schema,
    )
    publish_daily(spark, days, output)
    rows = read_current(spark, f"{output}/stock_financial_daily").orderBy("trade_date").collect()
    assert [str(r["financial_report_date"]) for r in rows] == ["2022-06-30", "2022-06-30"]
    assert rows[0]["operating_revenue_ttm"] == 250.0


MARKET = "total_market_cap double, net_profit_ttm double, cash_flow_ttm double, net_assets double, total_assets double, total_liabilities double"


def test_market_ratios_and_guards(spark):
    rows = [(1200.0, 80.0, 150.0, 600.0, 2400.0, 900.0), (700.0, -35.0, 0.0, -14.0, 0.0, 630.0)]
    built = metrics.with_metrics(spark.createDataFrame(rows, MARKET), metrics.pick(metrics.MARKET_METRIC_IDS)).collect()
    assert [built[0][name] for name in metrics.MARKET_METRIC_IDS] == [15, 2, 8, 80 / 1200, 0.375, 1.5]
    assert [built[1][name] for name in metrics.MARKET_METRIC_IDS] == [None, None, None, -0.05, None, None]


def test_registry_rejects_incomplete_entries():
    good = metrics.REGISTRY["pb"]
    with pytest.raises(ValueError):
        metrics.pick(["nope"])
    with pytest.raises(ValueError):
        metrics.pick(["pb"], {"pb": metrics.Metric("pb", "", good.invalid_when)})
    with pytest.raises(ValueError):
        metrics.pick(["pb"], {"pb": metrics.Metric("pb", good.formula, good.invalid_when, status="planned")})
    assert len(metrics.MARKET_METRIC_IDS) + len(metrics.DAILY_METRIC_IDS) == len(metrics.REGISTRY) == 38


def test_loss_year_keeps_operating_profit_untaxed(spark):
    company = period_table(spark, [COMPANY_PERIOD]).withColumns(
        {"total_profit_ttm": F.lit(-12.0), "interest_expense_ttm": F.lit(41.0), "income_tax_expense_ttm": F.lit(5.0)}
    )
    row = daily.build_daily(stock_table(spark), company).filter("symbol = 'sh688321'").first()
    assert row["roic_ttm"] == pytest.approx((41 - 12) / 290)


def test_planted_faults_are_found(spark, tiny):
    """Every count of the checks is above zero, and the unusual tables do hold what they are there for."""
    from tidemark.plans import registry

    registry.load_all()
    days = registry.QUERIES["daily_check_of_faulty_rows"](spark, tiny).first().asDict()
    assert all(count > 0 for name, count in days.items() if name != "errors"), days
    assert len(days["errors"].split("; ")) == 8
    built = registry.QUERIES["period_check_of_faulty_rows"](spark, tiny).first().asDict()
    assert all(count > 0 for name, count in built.items() if name != "errors"), built
    assert len(built["errors"].split("; ")) == 3
    kinds = registry.QUERIES["unusual_financial_periods"](spark, tiny)
    assert {row[0] for row in kinds.select("period_type").distinct().collect()} == {"Q1", "H1", "Q3", "FY", "OTHER"}
    twice = kinds.groupBy("symbol", "publish_date", "report_date").agg(F.count_distinct("statement_format").alias("n"))
    chosen = registry.QUERIES["format_in_force"](spark, tiny).join(twice.filter("n > 1"), ["symbol", "publish_date", "report_date"])
    assert {row[0] for row in chosen.select("statement_format").distinct().collect()} == {GENERAL, BANK}


def test_refresh_builds_only_what_changed(spark, tmp_path):
    """New, restated and vanished companies; the result equals a full build, and the second run holds the changed ones alone."""
    from tidemark.plans import build

    def company(name, rows):
        return statements(spark, rows).withColumn("symbol", F.lit(name))

    first = company("a", RESTATED[:4]).unionByName(company("b", RESTATED)).unionByName(company("gone", RESTATED))
    second = company("a", RESTATED).unionByName(company("b", RESTATED)).unionByName(company("new", RESTATED[:3]))
    output = str(tmp_path)
    assert build.refresh_periods(spark, first, build.digests_of(first), output) == {"companies_built": 3, "companies_gone": 0}
    assert build.refresh_periods(spark, first, build.digests_of(first), output) == {"companies_built": 0, "companies_gone": 0}
    assert build.refresh_periods(spark, second, build.digests_of(second), output) == {"companies_built": 2, "companies_gone": 1}
    found, wanted = build.read_periods(spark, output), periods.build_periods(second)
    assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()
    runs = spark.read.parquet(f"{output}/financial_period_runs").groupBy("run").agg(F.sort_array(F.collect_set("symbol")).alias("s"))
    assert sorted(row["s"] for row in runs.collect()) == [["a", "b", "gone"], ["a", "new"]]


def test_daily_build_needs_periods_of_the_rules_in_force(spark, tmp_path, monkeypatch):
    from tidemark.plans import build

    output = str(tmp_path)
    publish_periods(statements(spark, RESTATED), output)
    assert build.check_version(spark, f"{output}/financial_period") == []
    monkeypatch.setattr(build, "PIPELINE_VERSION", 2)
    with pytest.raises(ValueError, match="pipeline version 1 is not 2"):
        publish_daily(spark, stock_table(spark), output)


def test_digests_of_files_change_with_their_files(spark):
    from tidemark.plans import build

    schema = "file string, identity string, length long, modified timestamp, signature string"
    at = dt.datetime(2024, 1, 1)
    known = lambda rows: spark.createDataFrame(rows, schema)
    digests = lambda *tables: {row["symbol"]: row["digest"] for row in build.digests_of_files(*tables).collect()}
    one, two = known([("a.csv", "a", 1, at, "s"), ("b.csv", "b", 1, at, "s")]), known([("a.csv", "a", 2, at, "s")])
    before = digests(one, two)
    assert set(before) == {"a", "b"} and digests(one, two) == before
    after = digests(one, known([("a.csv", "a", 2, dt.datetime(2024, 1, 2), "s")]))
    assert after["b"] == before["b"] and after["a"] != before["a"]


@pytest.mark.parametrize("columns", [("symbol", "trade_date", "dso", "roic_ttm"), ("symbol", "trade_date", "revenue_yoy", "stock_name")])
def test_daily_of_some_columns_is_part_of_the_whole(spark, columns):
    """Only what the columns need travels through the as-of join; the values are those of the whole build."""
    whole = daily.build_daily(stock_table(spark), period_table(spark)).select(*columns)
    inputs = daily.period_inputs(daily.reports_for(columns))
    part = daily.build_daily(stock_table(spark), period_table(spark).select(*inputs), columns=columns)
    assert sorted(part.columns) == sorted(columns)
    assert sorted(map(str, part.select(*columns).collect())) == sorted(map(str, whole.collect()))
    assert len(daily.reports_for(columns)) < len(daily.REPORT_COLUMNS) / 2


def test_exact_sum_beyond_a_long(spark):
    """Totals of more units than a long holds, added without decimal objects."""
    rows = spark.range(200).select((F.col("id") % 2).alias("g"), F.lit(9e13).alias("v"))
    grouped = rows.groupBy("g").agg(exact_sum(F.when(F.col("g") == 0, F.col("v")).otherwise(-F.col("v"))).alias("s"))
    assert {r["g"]: r["s"] for r in grouped.collect()} == {0: 9e15, 1: -9e15}
    many = spark.range(200_000).agg(exact_sum(F.lit(9e13)).alias("s"))
    assert many.first()["s"] == 1.8e19
