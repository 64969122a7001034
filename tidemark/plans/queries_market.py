"""Registered queries: as-of joins, versions, periods, metrics, data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import exact_sum
from tidemark.operators import asof, crosssection, quality, scans
from tidemark.operators.aggregates import metric_profile
from tidemark.plans import daily, market, metrics, oracles, periods
from tidemark.plans.registry import query
from tidemark.session import cut_lineage, table, tune


def build_all_periods(spark, sf) -> DataFrame:
    return periods.build_periods(market.statements(spark, sf))


def build_all_days(spark, sf, columns=daily.DAILY_COLUMNS) -> DataFrame:
    """Bars and periods are tables of their own; each is written once before the daily build, with what ``columns`` need."""
    tune(spark)
    stocks = cut_lineage(market.stock_days(spark, sf).select(*daily.STOCK_COLUMNS), "bars")
    return daily.build_daily(stocks, _periods_for(spark, sf, columns), columns=columns)


def _periods_for(spark, sf, columns) -> DataFrame:
    inputs = daily.period_inputs(daily.reports_for(columns))
    return cut_lineage(build_all_periods(spark, sf).select(*inputs), "periods")


ASOF_SQL = """
with p as (select event_id, user_id, ts from events where event_type = 'purchase'),
 v as (select event_id as view_id, user_id, ts as view_ts, value as view_value from events where event_type = 'view')
select p.event_id, p.user_id, p.ts, v.view_id, v.view_ts, v.view_value
from p asof left join v on p.user_id = v.user_id and p.ts >= v.view_ts
"""


def _purchases_and_views(spark, sf) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf, "events")
    purchases = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    views = events.filter(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("value").alias("view_value")
    )
    return purchases, views


@query("asof_last_view_before_purchase", ASOF_SQL)
def asof_last_view(spark, sf):
    purchases, views = _purchases_and_views(spark, sf)
    return asof.asof_join(
        purchases, views, ["user_id"], "ts", "view_ts", ["view_id", "view_ts", "view_value"], unit="day",
        tie=["view_id"],
    )


@query(
    "asof_with_unknown_users",
    ASOF_SQL.replace("from events where", "from (select * replace (case when event_id % 7 = 0 then null else user_id end as user_id) from events) where"),
)
def asof_with_unknown_users(spark, sf):
    """A key that is not known matches nothing, however many rows lack it."""
    purchases, views = _purchases_and_views(spark, sf)
    known = lambda df, name: df.withColumn("user_id", F.when(F.col(name) % 7 != 0, F.col("user_id")))
    return asof.asof_join(
        known(purchases, "event_id"), known(views, "view_id"), ["user_id"], "ts", "view_ts",
        ["view_id", "view_ts", "view_value"], unit="day", tie=["view_id"],
    )


@query("asof_by_validity_interval", ASOF_SQL)
def asof_by_interval(spark, sf):
    purchases, views = _purchases_and_views(spark, sf)
    intervals = asof.validity_intervals(views, ["user_id"], "view_ts", unit="day", tie=["view_id"])
    return asof.interval_join(
        purchases, intervals, ["user_id"], "ts", "view_ts", "valid_until",
        ["view_id", "view_ts", "view_value"], unit="day",
    )


@query(
    "orders_open_at_shipping",
    """with spans as (select o_orderkey, o_custkey, o_orderdate as opened, max(l_shipdate) as closed, o_totalprice
  from orders join lineitem on o_orderkey = l_orderkey group by all),
 ships as (select l_orderkey, l_linenumber, o_custkey, l_shipdate from lineitem join orders on l_orderkey = o_orderkey)
 select l_orderkey, l_linenumber, count(p.o_orderkey) as open_orders, max(p.o_totalprice) as largest from ships s left join spans p
  on s.o_custkey = p.o_custkey and s.l_shipdate >= p.opened and s.l_shipdate < p.closed group by 1, 2""",
)
def orders_open_at_shipping(spark, sf):
    """Overlapping intervals: the orders of a customer that are not fully shipped when a line leaves."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    shipped = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    spans = orders.join(shipped, orders["o_orderkey"] == shipped["l_orderkey"]).select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("opened"), "closed", "o_totalprice"
    )
    ships = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey", "l_shipdate")
    # Spans last for years: cut into months, each would be listed some thirty times.
    found = asof.interval_join(
        ships, spans, ["o_custkey"], "l_shipdate", "opened", "closed", ["o_orderkey", "o_totalprice"],
        unit="year", carried=["l_orderkey", "l_linenumber"],
    )
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count("o_orderkey").alias("open_orders"), F.max("o_totalprice").alias("largest"))


@query(
    "visible_statement_components",
    f"with {oracles.STATEMENTS}, {oracles.PERIODS} select symbol, report_date, publish_date,"
    " quarter_predecessor_publish_date as predecessor_published, ttm_annual_publish_date as annual_published,"
    " ttm_prior_publish_date as year_ago_published from periods",
)
def visible_components(spark, sf):
    linked = periods.link_components(market.statements(spark, sf))
    return linked.select(
        "symbol", "report_date", "publish_date",
        F.col("before.publish_date").alias("predecessor_published"),
        F.col("annual.publish_date").alias("annual_published"),
        F.col("year_ago.publish_date").alias("year_ago_published"),
    )


@query("financial_periods", oracles.PERIODS_SQL)
def financial_periods(spark, sf):
    return build_all_periods(spark, sf)


BASE_NAMES = [
    name for name in daily.REPORT_COLUMNS if any(part in name for part in ("_base", "_change"))
]


@query(
    "comparison_bases",
    f"with {oracles.STATEMENTS}, {oracles.PERIODS}, {oracles.COMPARED}"
    f" select symbol, report_date, publish_date, {', '.join(BASE_NAMES)} from compared",
)
def comparison_bases(spark, sf):
    compared = periods.add_comparison_bases(build_all_periods(spark, sf))
    return compared.select("symbol", "report_date", "publish_date", *BASE_NAMES)


@query(
    "report_snapshots",
    f"with {oracles.STATEMENTS}, {oracles.PERIODS}, {oracles.COMPARED}, {oracles.SNAPSHOTS}"
    " select symbol, publish_date, report_date, statement_format, ttm_components_complete from snapshots",
)
def report_snapshots(spark, sf):
    snapshots = daily.report_snapshots(build_all_periods(spark, sf))
    return snapshots.select("symbol", "publish_date", "report_date", "statement_format", "ttm_components_complete")


@query("stock_financial_daily", oracles.DAILY_SQL)
def stock_financial_daily(spark, sf):
    rounded = {name: F.round(name, 9) for name in ("revenue_cagr_3y", "profit_cagr_3y")}
    return build_all_days(spark, sf).withColumns(rounded)


MARKET_INPUTS = """
 select s_name as symbol, trade_date, total_market_cap, s_acctbal * 10 as net_profit_ttm, s_acctbal - 1000 as cash_flow_ttm,
  turnover - 20000 as net_assets, turnover as total_assets, turnover * 0.5::double as total_liabilities
 from stock_days join supplier on s_name = symbol
"""


def _market_inputs(spark, sf) -> DataFrame:
    bars = market.stock_days(spark, sf).select("symbol", "trade_date", "total_market_cap", "turnover")
    balance = table(spark, sf, "supplier").select(F.col("s_name").alias("symbol"), "s_acctbal")
    return bars.join(balance, "symbol").select(
        "symbol", "trade_date", "total_market_cap", (F.col("s_acctbal") * 10).alias("net_profit_ttm"),
        (F.col("s_acctbal") - 1000).alias("cash_flow_ttm"), (F.col("turnover") - 20000).alias("net_assets"),
        F.col("turnover").alias("total_assets"), (F.col("turnover") * 0.5).alias("total_liabilities"),
    )


MARKET_FORMULAS = {
    "pe_ttm": ("total_market_cap", "net_profit_ttm"), "pb": ("total_market_cap", "net_assets"),
    "pcf_ttm": ("total_market_cap", "cash_flow_ttm"), "earnings_yield_ttm": ("net_profit_ttm", "total_market_cap"),
    "liabilities_to_assets": ("total_liabilities", "total_assets"),
    "liabilities_to_equity": ("total_liabilities", "net_assets"),
}
MARKET_SQL = f"""with {oracles.STOCK_DAYS}, inputs as ({MARKET_INPUTS})
 select *, {", ".join(f"case when {d} > 0 then {n} / {d} end as {m}" for m, (n, d) in MARKET_FORMULAS.items())}
 from inputs"""


@query("market_ratios", MARKET_SQL)
def market_ratios(spark, sf):
    return metrics.with_metrics(_market_inputs(spark, sf), metrics.pick(metrics.MARKET_METRIC_IDS))


@query(
    "metric_recheck",
    f"with exact as ({MARKET_SQL}) "
    + " union all ".join(
        f"select '{m}' as metric, count(*) filter (round({m}, 3) is not null and {d} <= 0) as invalid_rows,"
        f" count(*) filter (round({m}, 3) is distinct from {m}) as mismatch_rows from exact"
        for m, (_, d) in MARKET_FORMULAS.items()
    ),
)
def metric_recheck(spark, sf):
    """Values stored with three decimals against their formulas: every rounded one is reported."""
    stored = market_ratios(spark, sf).withColumns({name: F.round(name, 3) for name in metrics.MARKET_METRIC_IDS})
    return quality.check_metrics(stored, metrics.pick(metrics.MARKET_METRIC_IDS))


def _flat_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", F.array_join("errors", "; "))


@query(
    "period_check",
    f"""with {oracles.STATEMENTS}, {oracles.PERIODS}
 select count(*) as row_count, count(*) filter (symbol is null or report_date is null) as null_key_rows,
  count(*) filter (quarter_predecessor_publish_date > publish_date or ttm_annual_publish_date > publish_date
   or ttm_prior_publish_date > publish_date) as future_component_rows,
  count(*) filter (quarter_components_complete) as quarter_complete_rows,
  count(*) filter (ttm_components_complete) as ttm_complete_rows,
  count(*) - count(distinct (symbol, statement_format, report_date, publish_date)) as duplicate_key_groups,
  '' as errors from periods""",
)
def period_check(spark, sf):
    # Written once: the check reads its table several times.
    return _flat_errors(quality.check_periods(cut_lineage(build_all_periods(spark, sf), "periods")))


#: What the daily check reads.
CHECKED = (
    "symbol", "trade_date", "financial_report_date", "financial_publish_date", "statement_format", "yoy_base_publish_date",
    "qoq_base_publish_date", "cagr_base_publish_date", "total_market_cap", *daily.reports_for(metrics.DAILY_METRIC_IDS), *metrics.DAILY_METRIC_IDS,
)


@query("daily_check", f"with {oracles.ALL_TABLES} {oracles.daily_check_sql('daily')}")
def daily_check(spark, sf):
    days = cut_lineage(build_all_days(spark, sf, CHECKED), "days")
    return _flat_errors(quality.check_daily(days, metrics.pick(metrics.DAILY_METRIC_IDS)))


@query(
    "dupont_check",
    f"""with {oracles.ALL_TABLES}
 select count(net_margin_ttm * asset_turnover_ttm * m) as checked_rows,
  count(*) filter (abs(net_margin_ttm * asset_turnover_ttm * m - roe_ttm) > 1e-9 * greatest(abs(roe_ttm), 1)) as broken_rows
 from (select *, case when avg_parent_equity > 0 then avg_total_assets / avg_parent_equity end as m from daily)""",
)
def dupont_check(spark, sf):
    days = build_all_days(spark, sf, ("net_margin_ttm", "asset_turnover_ttm", "roe_ttm", "avg_total_assets", "avg_parent_equity"))
    return quality.dupont_breaks(days)


PROFILED = ("roe_ttm", "pe_parent_ttm", "dso", "roic_ttm", "revenue_yoy")


@query(
    "metric_profile",
    f"with {oracles.ALL_TABLES} "
    + " union all ".join(
        f"select '{m}' as metric, count({m}) as non_null_count, round(1 - count({m}) / count(*), 6) as null_ratio,"
        f" round(min({m}), 6) as min, round(max({m}), 6) as max, count(*) filter (not isfinite({m})) as non_finite_count from daily"
        for m in PROFILED
    ),
)
def profile_of_metrics(spark, sf):
    profile = metric_profile(build_all_days(spark, sf, PROFILED), PROFILED)
    return profile.withColumns({name: F.round(name, 6) for name in ("min", "max")})


@query(
    "running_order_high",
    """select o_orderkey, o_custkey, o_orderdate, max(o_totalprice) over (partition by o_custkey order by o_orderdate
 range between unbounded preceding and current row) as high_so_far from orders""",
)
def running_order_high(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    high = scans.running(
        orders, ["o_custkey"], ["o_orderdate"], F.date_trunc("quarter", "o_orderdate"),
        {"high_so_far": scans.Running("max", F.col("o_totalprice"))}, peers=True,
    )
    return high.drop("o_totalprice")


@query(
    "price_decreases",
    """select o_custkey, o_orderkey, o_totalprice, previous_value from (select *, lag(o_totalprice) over
 (partition by o_custkey order by o_orderdate, o_orderkey) as previous_value from orders)
 where o_totalprice < previous_value""",
)
def price_decreases(spark, sf):
    orders = table(spark, sf, "orders")
    fallen = quality.decreases(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", F.date_trunc("quarter", "o_orderdate")
    )
    return fallen.select("o_custkey", "o_orderkey", "o_totalprice", "previous_value")


@query(
    "last_four_reports",
    f"""with {oracles.STATEMENTS}
 select symbol, report_date, publish_date, operating_revenue from (
  select * from statements qualify row_number() over (partition by symbol, report_date order by publish_date desc) = 1)
 qualify row_number() over (partition by symbol order by report_date desc) <= 4
 order by symbol, report_date""",
)
def last_four_reports(spark, sf):
    statements = market.statements(spark, sf).select("symbol", "report_date", "publish_date", "operating_revenue")
    recent = asof.last_periods(statements, ["symbol"], "report_date", "publish_date", 4)
    return recent.orderBy("symbol", "report_date")


@query(
    "newest_order_per_customer",
    """select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders
 qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
)
def newest_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return asof.newest_per(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query(
    "table_check",
    """select count(*) as row_count, count(distinct l_suppkey) as identity_count, cast(min(l_shipdate) as date) as min_date,
 cast(max(l_shipdate) as date) as max_date,
 count(*) filter (l_orderkey is null or l_linenumber is null) as null_key_rows,
 (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)) as duplicate_key_groups,
 concat((select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)),
  ' duplicate key groups') as errors from lineitem""",
)
def table_check(spark, sf):
    lines = table(spark, sf, "lineitem")
    checked = quality.check_table(lines, ("l_orderkey", "l_linenumber"), "l_suppkey", "l_shipdate")
    return _flat_errors(checked).withColumns({name: F.to_date(name) for name in ("min_date", "max_date")})


@query(
    "disclosed_ratio_by_region",
    f"""with {oracles.STATEMENTS}, {oracles.STOCK_DAYS},
 newest as (select * from stock_days where trade_date = (select max(trade_date) from stock_days)),
 seen as (select s.symbol, s.industry_level_1, f.total_liabilities, f.total_assets
  from newest s asof join statements f on s.symbol = f.symbol and s.trade_date >= f.publish_date)
 select industry_level_1, count(*) as companies, round(sum(total_liabilities) / nullif(sum(total_assets), 0), 6)
  as liabilities_to_assets from seen group by 1""",
)
def disclosed_ratio_by_region(spark, sf):
    """Companies of the latest day with the newest statement disclosed by then, as ratio of sums."""
    days = market.stock_days(spark, sf).select("symbol", "trade_date", "industry_level_1")
    newest = days.filter(F.col("trade_date") == days.agg(F.max("trade_date")).scalar())
    statements = market.statements(spark, sf).select("symbol", "publish_date", "report_date", "total_liabilities", "total_assets")
    seen = asof.asof_join(
        newest, statements, ["symbol"], "trade_date", "publish_date", ["total_liabilities", "total_assets"],
        unit="year", tie=["report_date"], keep_unmatched=False,
    )
    return seen.groupBy("industry_level_1").agg(
        F.count(F.lit(1)).alias("companies"),
        F.round(F.try_divide(F.sum("total_liabilities"), F.sum("total_assets")), 6).alias("liabilities_to_assets"),
    )


@query(
    "screen_value_and_return",
    f"""with {oracles.ALL_TABLES}
 select stock_name, trade_date, total_market_cap, parent_net_profit_ttm, avg_parent_equity, pe_parent_ttm, roe_ttm
 from daily where trade_date = (select max(trade_date) from daily) and pe_parent_ttm < 90 and roe_ttm > 0.10""",
)
def screen_value_and_return(spark, sf):
    # A day of the result needs only its own bars, so the others do not enter the build.
    bars = market.stock_days(spark, sf)
    newest = cut_lineage(bars.filter(F.col("trade_date") == bars.agg(F.max("trade_date")).scalar()), "bars")
    columns = ("stock_name", "trade_date", "total_market_cap", "parent_net_profit_ttm", "avg_parent_equity", "pe_parent_ttm", "roe_ttm")
    days = daily.build_daily(newest, _periods_for(spark, sf, columns), columns=columns)
    return crosssection.screen(days, F.col("pe_parent_ttm") < 90, F.col("roe_ttm") > 0.10).select(*columns)


@query(
    "lowest_enterprise_multiple",
    f"""with {oracles.ALL_TABLES}
 select stock_name, trade_date, statement_format, total_market_cap, ev_ebitda_ttm, roic_ttm
 from daily where statement_format = '一般企业' and roic_ttm > 0 and ev_ebitda_ttm is not null
 order by ev_ebitda_ttm, stock_name, trade_date limit 20""",
)
def lowest_enterprise_multiple(spark, sf):
    columns = ("stock_name", "trade_date", "statement_format", "total_market_cap", "ev_ebitda_ttm", "roic_ttm")
    days = build_all_days(spark, sf, columns)
    chosen = days.filter(
        (F.col("statement_format") == metrics.GENERAL_ENTERPRISE) & (F.col("roic_ttm") > 0) & F.col("ev_ebitda_ttm").isNotNull()
    ).select(*columns)
    return chosen.orderBy(F.col("ev_ebitda_ttm").asc_nulls_last(), "stock_name", "trade_date").limit(20)


@query(
    "price_and_metric_table_join",
    f"""with {oracles.ALL_TABLES}
 select d.industry_level_1, count(*) as days, cast(sum(cast(s.turnover as decimal(18, 2))) as double) as turnover,
  count(d.roe_ttm) as days_with_roe
 from stock_days s join daily d on s.symbol = d.symbol and s.trade_date = d.trade_date group by 1""",
)
def price_and_metric_join(spark, sf):
    """One-to-one daily join of prices and metrics on (symbol, trade_date)."""
    prices = market.stock_days(spark, sf).select("symbol", "trade_date", "turnover")
    days = build_all_days(spark, sf, ("symbol", "trade_date", "industry_level_1", "roe_ttm"))
    return prices.join(days, ["symbol", "trade_date"]).groupBy("industry_level_1").agg(
        F.count(F.lit(1)).alias("days"), exact_sum(F.col("turnover"), 2).alias("turnover"),
        F.count("roe_ttm").alias("days_with_roe"),
    )
