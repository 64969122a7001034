"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores. Every
query runs over the whole tables and is written to the no-op sink, so all rows are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.operators import quality  # noqa: E402
from tidemark.plans import daily, market, metrics, periods, registry  # noqa: E402
from tidemark.session import clear_stages, cut_lineage, local_session, tune  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "latest_day_top_orders", "trailing_month_top_parts", "monthly_revenue_trend", "asof_last_view_before_purchase",
    "running_order_high", "last_four_reports", "market_ratios", "duplicate_line_keys", "median_price_by_flag",
    "signup_funnel", "daily_quota", "summary_batches", "keyword_search", "rank_fusion",
)


SCALE = 4


def repeated(df, factor):
    """The same rows under ``factor`` times as many company names."""
    copies = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    return copies.withColumn("symbol", F.concat("symbol", F.lit("_"), F.col("__copy").cast("string"))).drop("__copy")


def main() -> None:
    registry.load_all()
    spark = tune(local_session(CPUS, "bench"))
    spark.conf.set("spark.sql.shuffle.partitions", CPUS)
    # The tables are single small files; smaller splits let every core read.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run, into=times):
        started = time.perf_counter()
        result = run()
        into[name] = round(time.perf_counter() - started, 3)
        return result

    registry.QUERIES["monthly_revenue_trend"](spark, FOLDER).collect()
    for name in HEADLINE:
        timed(name, lambda name=name: registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save())
    statements = timed("statements", lambda: cut_lineage(market.statements(spark, FOLDER)))
    bars = timed("bars", lambda: cut_lineage(market.stock_days(spark, FOLDER)))
    # The builds run twice; the second run shows the plan rather than the JVM warming up.
    for run in ("first", "warm"):
        label = "" if run == "warm" else "_first"
        built = timed(f"period_build{label}", lambda: cut_lineage(periods.build_periods(statements)))
        days = timed(f"daily_build{label}", lambda built=built: cut_lineage(daily.build_daily(bars, built)))
        timed(
            f"daily_validate{label}",
            lambda days=days: quality.check_daily(days, metrics.pick(metrics.DAILY_METRIC_IDS)).collect(),
        )
    # The same builds over more companies: at sf0.1 planning and code generation are a good part of the time.
    larger: dict[str, float] = {}
    statements, bars = (cut_lineage(repeated(df, SCALE)) for df in (statements, bars))
    many = timed("period_build", lambda: cut_lineage(periods.build_periods(statements)), larger)
    more = timed("daily_build", lambda: cut_lineage(daily.build_daily(bars, many)), larger)
    timed("daily_validate", lambda: quality.check_daily(more, metrics.pick(metrics.DAILY_METRIC_IDS)).collect(), larger)
    sizes = {"period_build": many.count(), "daily_build": more.count(), "daily_validate": more.count()}
    counts = {"period_build": built.count(), "daily_build": days.count(), "daily_validate": days.count()}
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": CPUS,
                "rows": counts, "rows_per_sec": {name: round(n / times[name]) for name, n in counts.items()},
                "larger": {"factor": SCALE, "seconds": larger, "rows": sizes, "rows_per_sec": {name: round(n / larger[name]) for name, n in sizes.items()}},
            }
        )
    )
    clear_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
