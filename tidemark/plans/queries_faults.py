"""Registered queries over tables in which something is wrong or unusual: the checks and choices have to find it.

The rows come from the given tables; rules on dates and company numbers plant the faults, in the
plan and in its SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans import daily, market, metrics, oracles, periods
from tidemark.plans.queries_market import CHECKED, build_all_days, build_all_periods
from tidemark.plans.registry import query
from tidemark.session import cut_lineage


def _company() -> Column:
    return F.substring("symbol", -6, 6).cast("int")


COMPANY = "cast(right(symbol, 6) as integer)"


def _changed(df: DataFrame, faults: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Columns replaced where their rule holds; all rules see the table as it was."""
    return df.withColumns({name: F.when(rule, value).otherwise(F.col(name)) for name, (rule, value) in faults.items()})


def unusual_statements(statements: DataFrame) -> DataFrame:
    """Reports on any day, gaps before regular ones, and companies that report in two formats on one day."""
    company, day = _company(), F.col("report_date")
    moved = F.when((company % 4 == 1) | ((company % 8 == 0) & (F.month(day) == 3)), F.date_sub(day, 16)).when(
        company % 4 == 2, F.date_add(day, 31)
    )
    dated = statements.withColumn("report_date", F.coalesce(moved, day))
    other = F.when(F.col("statement_format") == market.BANK, metrics.GENERAL_ENTERPRISE).otherwise(market.BANK)
    second = dated.filter(company % 4 == 3).withColumns(
        {
            "statement_format": other,
            "operating_revenue": F.when(F.quarter("report_date") != 2, F.col("operating_revenue")),
            "net_profit": F.when(F.year("report_date") % 2 == 0, F.col("net_profit")),
        }
    )
    # The second format skips some reports, so either format is the complete one now and then.
    return dated.unionByName(second.filter(F.quarter("report_date") != 1 + company % 3))


UNUSUAL = f"""{oracles.STATEMENTS.replace("statements as (", "regular_statements as (")},
dated_statements as (
 select * replace (cast(case when {COMPANY} % 4 = 1 or ({COMPANY} % 8 = 0 and month(report_date) = 3) then report_date - 16
   when {COMPANY} % 4 = 2 then report_date + 31 else report_date end as date) as report_date) from regular_statements),
statements as (
 select * from dated_statements union all
 select * replace (case when statement_format = '一般企业' then '商业银行' else '一般企业' end as statement_format,
   case when quarter(report_date) <> 2 then operating_revenue end as operating_revenue,
   case when year(report_date) % 2 = 0 then net_profit end as net_profit)
 from dated_statements where {COMPANY} % 4 = 3 and quarter(report_date) <> 1 + {COMPANY} % 3)"""


def _unusual_periods(spark, sf) -> DataFrame:
    return periods.build_periods(unusual_statements(market.statements(spark, sf)))


@query("unusual_financial_periods", f"with {UNUSUAL}, {oracles.PERIODS} select * from periods")
def unusual_financial_periods(spark, sf):
    return _unusual_periods(spark, sf)


@query(
    "unusual_comparison_bases",
    f"with {UNUSUAL}, {oracles.PERIODS}, {oracles.COMPARED} select symbol, statement_format, report_date, publish_date,"
    " yoy_base_report_date, qoq_base_report_date, cagr_base_report_date, operating_revenue_yoy_base,"
    " parent_net_profit_qoq_base, operating_revenue_cagr_3y_base from compared",
)
def unusual_comparison_bases(spark, sf):
    compared = periods.add_comparison_bases(_unusual_periods(spark, sf))
    return compared.select(
        *periods.KEYS, "yoy_base_report_date", "qoq_base_report_date", "cagr_base_report_date",
        "operating_revenue_yoy_base", "parent_net_profit_qoq_base", "operating_revenue_cagr_3y_base",
    )


@query(
    "format_in_force",
    f"with {UNUSUAL}, {oracles.PERIODS}, {oracles.COMPARED}, {oracles.SNAPSHOTS}"
    " select symbol, publish_date, report_date, statement_format, ttm_components_complete from snapshots",
)
def format_in_force(spark, sf):
    """One format per publish date, among companies that publish two on the same day."""
    snapshots = daily.report_snapshots(_unusual_periods(spark, sf))
    return snapshots.select("symbol", "publish_date", "report_date", "statement_format", "ttm_components_complete")


def faulty_periods(built: DataFrame) -> DataFrame:
    company, month, day = _company(), F.month("report_date"), F.col("publish_date")
    faults = {
        "symbol": ((company == 3) & (month == 9), F.lit(None).cast("string")),
        "quarter_predecessor_publish_date": ((company % 5 == 1) & (month == 6), F.date_add(day, 1)),
        "ttm_annual_publish_date": ((company % 7 == 2) & (month == 9), F.date_add(day, 2)),
        "ttm_prior_publish_date": ((company % 9 == 4) & (month == 12), F.date_add(day, 3)),
    }
    return _changed(built, faults).unionByName(built.filter((company % 11 == 5) & (month == 3)))


@query(
    "period_check_of_faulty_rows",
    f"""with {oracles.STATEMENTS}, {oracles.PERIODS}, faulty as (
 select * replace (case when {COMPANY} = 3 and month(report_date) = 9 then null else symbol end as symbol,
  case when {COMPANY} % 5 = 1 and month(report_date) = 6 then publish_date + 1 else quarter_predecessor_publish_date end
   as quarter_predecessor_publish_date,
  case when {COMPANY} % 7 = 2 and month(report_date) = 9 then publish_date + 2 else ttm_annual_publish_date end as ttm_annual_publish_date,
  case when {COMPANY} % 9 = 4 and month(report_date) = 12 then publish_date + 3 else ttm_prior_publish_date end as ttm_prior_publish_date)
 from periods union all select * from periods where {COMPANY} % 11 = 5 and month(report_date) = 3),
counted as (
 select count(*) as row_count, count(*) filter (symbol is null) as null_key_rows,
  count(*) filter (greatest(quarter_predecessor_publish_date, ttm_annual_publish_date, ttm_prior_publish_date) > publish_date)
   as future_component_rows,
  count(*) filter (quarter_components_complete) as quarter_complete_rows,
  count(*) filter (ttm_components_complete) as ttm_complete_rows,
  (select count(*) from (select 1 from faulty group by symbol, statement_format, report_date, publish_date having count(*) > 1))
   as duplicate_key_groups from faulty)
select *, concat_ws('; ', case when null_key_rows > 0 then null_key_rows || ' rows have null keys' end,
 case when duplicate_key_groups > 0 then duplicate_key_groups || ' duplicate key groups' end,
 case when future_component_rows > 0 then future_component_rows || ' rows use components published later' end) as errors from counted""",
)
def period_check_of_faulty_rows(spark, sf):
    built = cut_lineage(build_all_periods(spark, sf), "periods")
    return quality.check_periods(faulty_periods(built)).withColumn("errors", F.array_join("errors", "; "))


def faulty_days(days: DataFrame) -> DataFrame:
    """Each rule of the daily check is broken on some days of the year; one company loses its name on some."""
    of_year, published = F.dayofyear("trade_date"), F.col("financial_publish_date")
    faults = {
        "symbol": ((_company() == 3) & (of_year % 13 == 7), F.lit(None).cast("string")),
        "financial_publish_date": ((of_year % 37 == 5) & published.isNotNull(), F.date_add("trade_date", 3)),
        "financial_report_date": (of_year % 61 == 8, F.date_sub("financial_report_date", 400)),
        "yoy_base_publish_date": (of_year % 41 == 6, F.date_add(published, 1)),
        "qoq_base_publish_date": (of_year % 43 == 6, F.date_add(published, 1)),
        "cagr_base_publish_date": (of_year % 47 == 6, F.date_add(published, 1)),
        "roe_ttm": (of_year % 29 == 3, F.col("roe_ttm") + 0.5),
        "pe_parent_ttm": (of_year % 53 == 9, F.lit(float("inf"))),
        "dio": (of_year % 59 == 2, F.lit(float("nan"))),
        "statement_format": ((of_year % 31 == 4) & published.isNotNull(), F.lit(market.BANK)),
    }
    changed = _changed(days, faults)
    return changed.unionByName(changed.filter((of_year % 67 == 10) & F.col("symbol").isNotNull()))


@query(
    "daily_check_of_faulty_rows",
    f"""with {oracles.ALL_TABLES}, changed as (
 select * replace (case when {COMPANY} = 3 and dayofyear(trade_date) % 13 = 7 then null else symbol end as symbol,
  case when dayofyear(trade_date) % 37 = 5 and financial_publish_date is not null then trade_date + 3 else financial_publish_date end
   as financial_publish_date,
  case when dayofyear(trade_date) % 61 = 8 then financial_report_date - 400 else financial_report_date end as financial_report_date,
  case when dayofyear(trade_date) % 41 = 6 then financial_publish_date + 1 else yoy_base_publish_date end as yoy_base_publish_date,
  case when dayofyear(trade_date) % 43 = 6 then financial_publish_date + 1 else qoq_base_publish_date end as qoq_base_publish_date,
  case when dayofyear(trade_date) % 47 = 6 then financial_publish_date + 1 else cagr_base_publish_date end as cagr_base_publish_date,
  case when dayofyear(trade_date) % 29 = 3 then roe_ttm + 0.5::double else roe_ttm end as roe_ttm,
  case when dayofyear(trade_date) % 53 = 9 then 'infinity'::double else pe_parent_ttm end as pe_parent_ttm,
  case when dayofyear(trade_date) % 59 = 2 then 'nan'::double else dio end as dio,
  case when dayofyear(trade_date) % 31 = 4 and financial_publish_date is not null then '商业银行' else statement_format end
   as statement_format)
 from daily),
faulty as (select * from changed union all
 select * from changed where dayofyear(trade_date) % 67 = 10 and symbol is not null)
{oracles.daily_check_sql("faulty")}""",
)
def daily_check_of_faulty_rows(spark, sf):
    days = cut_lineage(faulty_days(build_all_days(spark, sf, CHECKED)), "days")
    report = quality.check_daily(days, metrics.pick(metrics.DAILY_METRIC_IDS))
    return report.withColumn("errors", F.array_join("errors", "; "))
