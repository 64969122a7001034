"""Registered queries: reading folders, converting vendor files, publishing tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import exact_sum
from tidemark.plans import build, market, oracles
from tidemark.plans.golden import compare_snapshots, write_snapshots
from tidemark.plans.registry import query
from tidemark.session import cut_lineage, scratch_path, table
from tidemark.sources import catalog, ingest, vendor_csv
from tidemark.sources.contracts import ColumnSpec, DatasetSpec
from tidemark.sources.files import publish, read_current
from tidemark.sources.layout import publish_along, read_within

SEGMENT_SQL = """select c_mktsegment, count(*) as orders, max(o_totalprice) as highest,
 count(*) filter (where o_orderstatus = 'F') as finished from orders join customer on c_custkey = o_custkey group by all"""


@query("folder_query", SEGMENT_SQL)
def folder_query(spark, sf):
    """The same text on the folder's own tables: FILTER and GROUP BY ALL need no translation."""
    catalog.register(spark, sf)
    return catalog.select_only(spark, f"```sql\n{SEGMENT_SQL};\n```")


EVENT_FILES = DatasetSpec(
    table="event_files",
    encoding="GB18030",
    preamble_lines=0,
    columns=(
        ColumnSpec("类型", "kind", "text"),
        ColumnSpec("编号", "event_id", "number"),
        ColumnSpec("日期", "day", "date"),
        ColumnSpec("数值", "value", "number"),
        ColumnSpec("备注", "note", "text", required=False),
    ),
    keys=("kind", "event_id"),
    identity="kind",
    recursive=True,
    identity_from_folder=True,
)


def _written_files(spark, sf, changes: dict[str, Column] | None = None) -> str:
    """The events as vendor-style files: one folder per event type, legacy encoding; ``changes`` replace columns of the files."""
    source = scratch_path(spark, "vendor")
    folder = F.concat(F.lit("folder="), F.col("event_type"))
    files = table(spark, sf, "events").select(
        folder.alias("类型"), F.col("event_id").alias("编号"), F.to_date("ts").alias("日期"),
        F.col("value").alias("数值"), F.col("event_type").alias("folder"),
    ).withColumns(changes or {})
    # Spark's CSV writer knows this encoding only under a setting, which is put back.
    setting = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        files.write.partitionBy("folder").option("header", "true").option("encoding", "GB18030").csv(source)
    finally:
        spark.conf.set(setting, before)
    return source


@query(
    "vendor_file_conversion",
    """select concat('folder=', event_type) as kind, count(*) as row_count, cast(min(ts) as date) as min_date, cast(max(ts) as date) as max_date,
 cast(sum(cast(value as decimal(18, 2))) as double) as value, 0 as notes from events group by 1""",
)
def vendor_file_conversion(spark, sf):
    """Inventory, decode, type, check and append the files; then convert again, which skips all."""
    source, output = _written_files(spark, sf), scratch_path(spark, "curated")
    first = ingest.convert(spark, EVENT_FILES, source, output)
    again = ingest.convert(spark, EVENT_FILES, source, output)
    if again["converted_this_run"] or again["row_count"] != first["row_count"]:
        raise ValueError("the second run should have skipped every file")
    ingest.compact(spark, EVENT_FILES, output)
    rows = read_current(spark, f"{output}/{EVENT_FILES.table}_compact")
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("day").alias("min_date"), F.max("day").alias("max_date"),
        exact_sum(F.col("value"), 2).alias("value"), F.count("note").alias("notes"),
    )


@query(
    "vendor_faulty_lines",
    """with e as (select concat('folder=', event_type) as kind, event_id, value, event_id % 17 = 0 as is_foreign,
  event_id % 11 = 0 as bad_number, event_id % 13 = 0 as bad_day, event_id % 19 = 0 as blank from events)
 select kind, count(*) as lines, count(*) filter (is_foreign) as problem_lines,
  count(*) filter (not is_foreign and (bad_number or bad_day)) as malformed_lines,
  count(*) filter (not is_foreign and not bad_day) as days,
  count(*) filter (not is_foreign and not bad_number and not blank) as numbers,
  coalesce(cast(sum(cast(value as decimal(18, 2))) filter (not is_foreign and not bad_number and not blank) as double), 0) as value
 from e group by 1""",
)
def vendor_faulty_lines(spark, sf):
    """Lines of another identity are set aside with their problem; values that do not fit their type become unknown and are listed."""
    number = F.col("编号")
    changes = {
        "类型": F.when(number % 17 == 0, "folder=elsewhere").otherwise(F.col("类型")),
        "数值": F.when(number % 11 == 0, "n/a").when(number % 19 == 0, None).otherwise(F.col("数值").cast("string")),
        "日期": F.when(number % 13 == 0, "2020-13-45").otherwise(F.col("日期").cast("string")),
    }
    source = _written_files(spark, sf, changes)
    paths = [row[0] for row in vendor_csv.list_files(spark, EVENT_FILES, source).select("path").collect()]
    scanned = cut_lineage(vendor_csv.scan(spark, EVENT_FILES, paths), "scanned")
    lines = scanned.groupBy("identity").agg(F.count(F.lit(1)).alias("lines"), F.count("problem").alias("problem_lines"))
    bad = vendor_csv.malformed(EVENT_FILES, scanned).groupBy("identity").agg(F.count(F.lit(1)).alias("malformed_lines"))
    good = vendor_csv.typed_rows(EVENT_FILES, scanned, strict=False).groupBy(F.col("kind").alias("identity")).agg(
        F.count("day").alias("days"), F.count("value").alias("numbers"),
        F.coalesce(exact_sum(F.col("value"), 2), F.lit(0.0)).alias("value"),
    )
    return lines.join(bad, "identity", "left").join(good, "identity", "left").select(
        F.col("identity").alias("kind"), "lines", "problem_lines", F.coalesce("malformed_lines", F.lit(0)).alias("malformed_lines"),
        "days", "numbers", "value",
    )


@query(
    "vendor_limited_conversion",
    "select concat('folder=', event_type) as kind, count(*) as row_count from events group by 1",
)
def vendor_limited_conversion(spark, sf):
    """All files, then one of them again: the rows of the others stay."""
    source, output = _written_files(spark, sf), scratch_path(spark, "curated")
    ingest.convert(spark, EVENT_FILES, source, output)
    ingest.convert(spark, EVENT_FILES, source, output, force=True, limit_files=1)
    return ingest.read_table(spark, EVENT_FILES, output).groupBy("kind").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "vendor_file_inventory",
    """select 'event_files' as table_name, count(distinct event_type) as identity_count, 5 as expected_column_count,
 0 as invalid_header_count, 0 as reordered_header_count from events""",
)
def vendor_file_inventory(spark, sf):
    files = vendor_csv.list_files(spark, EVENT_FILES, _written_files(spark, sf))
    paths = [row[0] for row in files.select("path").collect()]
    headers = vendor_csv.read_headers(spark, EVENT_FILES, paths)
    return vendor_csv.inventory(files, headers, EVENT_FILES).select(
        F.col("table").alias("table_name"), "identity_count", "expected_column_count", "invalid_header_count",
        "reordered_header_count",
    )


@query("published_orders", "select o_orderstatus, count(*) as orders, max(o_totalprice) as highest from orders group by 1")
def published_orders(spark, sf):
    """Write, check and publish a table, then read the newest version."""
    orders = table(spark, sf, "orders")
    output = scratch_path(spark, "published")
    expected = orders.count()
    publish(
        orders.repartitionByRange("o_custkey", "o_orderdate").sortWithinPartitions("o_custkey", "o_orderdate"), output,
        lambda written: [] if written.count() == expected else ["row count changed"],
    )
    return read_current(spark, output).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("highest")
    )


@query(
    "orders_by_file_ranges",
    """select o_orderkey, o_custkey, o_orderdate, o_totalprice from orders
 where o_custkey between 10 and 400 and o_orderdate >= timestamp '1995-03-01' and o_orderdate <= timestamp '1996-02-01'""",
)
def orders_by_file_ranges(spark, sf):
    """A table laid out along customer and date; the files of one rectangle are read."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    output = scratch_path(spark, "laid_out")
    publish_along(orders, output, ["o_custkey", "o_orderdate"], partitions=32)
    wanted = {"o_custkey": (10, 400), "o_orderdate": (dt.date(1995, 3, 1), dt.date(1996, 2, 1))}
    return read_within(spark, output, wanted)


@query(
    "periods_after_restatements",
    f"""with {oracles.STATEMENTS}, {oracles.PERIODS} select symbol, statement_format, report_date, publish_date,
 operating_revenue_quarter, net_profit_ttm, avg_total_assets, ttm_prior_publish_date from periods""",
)
def periods_after_restatements(spark, sf):
    """Built once without the later restatements of every third company, then refreshed with them."""
    statements = cut_lineage(market.statements(spark, sf), "statements")
    late = (F.substring("symbol", -6, 6).cast("int") % 3 == 0) & (F.col("publish_date") > "1996-01-01")
    output = scratch_path(spark, "refreshed")
    for known in (statements.filter(~late), statements):
        build.refresh_periods(spark, known, build.digests_of(known), output)
    return build.read_periods(spark, output).select(
        "symbol", "statement_format", "report_date", "publish_date", "operating_revenue_quarter", "net_profit_ttm",
        "avg_total_assets", "ttm_prior_publish_date",
    )


@query(
    "golden_snapshots",
    """select 'orders_by_status' as name, true as equal, '' as reason
 union all select 'parts_by_brand', false, 'values differ' union all select 'customers', false, 'no snapshot'""",
)
def golden_snapshots(spark, sf):
    """Two results are stored; one of them changes in one value afterwards, a third was never stored."""
    orders = table(spark, sf, "orders").groupBy("o_orderstatus").agg(exact_sum(F.col("o_totalprice"), 2).alias("total"))
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))
    changed = table(spark, sf, "part").groupBy("p_brand").agg((F.count(F.lit(1)) + F.max(F.when(F.col("p_partkey") == 1, 1).otherwise(0))).alias("parts"))
    folder = scratch_path(spark, "golden")
    write_snapshots(spark, {"orders_by_status": orders, "parts_by_brand": brands}, folder)
    customers = table(spark, sf, "customer").groupBy("c_mktsegment").count()
    return compare_snapshots(spark, {"orders_by_status": orders, "parts_by_brand": changed, "customers": customers}, folder)
